"""Registered queries over the given tables, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from . import call_queries, caption_queries, judge_queries, reply_queries, task_queries

QUERIES = call_queries.QUERIES | reply_queries.QUERIES | caption_queries.QUERIES | judge_queries.QUERIES | task_queries.QUERIES
ORACLES = call_queries.ORACLES | reply_queries.ORACLES | caption_queries.ORACLES | judge_queries.ORACLES | task_queries.ORACLES
FLAGSHIP = "agg_6_rule_score_report"
