"""The hook for model calls (INF-1) and rounds of calls (INF-2)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RuleBook, Settings
from ..sources.shared import checkpointed
from .judging import failing, feedback, keep_best
from .text_rules import bad_output, score_reason

REPLY = T.StructType([T.StructField("raw", T.StringType()), T.StructField("finish_reason", T.StringType()), T.StructField("error", T.StringType()), T.StructField("elapsed_s", T.DoubleType())])
# Temperatures by style and of others, how much warmer later candidates are, the reasons after which a retry stays cool, and the tokens that a retry gets on top.
TEMPERATURE = {"formal": 0.5, "sarcastic": 0.70, "humorous_tech": 0.70, "humorous_non_tech": 0.64}
OTHER_TEMPERATURE, POOL_DELTA, WARMEST, COOL, COOLING, LEAST = 0.75, 0.15, 0.97, 0.25, 0.08, 0.2
COOL_REASONS = ("MetaLeak", "SceneMismatch", "TooLong")
MORE_TOKENS = {"Truncated": 220, "TooLong": 40}
OTHER_TOKENS = 60


def called(prompts: DataFrame, call: Callable[[list[dict]], list[tuple[str, str]]], batch: int = 16, hidden: list[str] = ()) -> DataFrame:
    """``prompts`` with REPLY, called where the rows are, one batch after the other; ``call`` doesn't see the ``hidden`` columns."""
    names, unseen = prompts.columns, list(hidden)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part, began = rows.iloc[at : at + batch], time.monotonic()
                try:
                    replies, error = call(part.drop(columns=unseen).to_dict("records")), None
                except Exception as failed:  # noqa: BLE001  the class name is the result
                    replies, error = [(None, None)] * len(part), type(failed).__name__
                took = (time.monotonic() - began) / max(1, len(part))
                yield part.assign(raw=[r for r, _ in replies], finish_reason=[f for _, f in replies], error=error, elapsed_s=took)[[*names, "raw", "finish_reason", "error", "elapsed_s"]]

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, *REPLY.fields]))


def call_model(prompts: DataFrame, call: Callable[[list[dict]], list[tuple[str, str]]], tasks: int, batch: int = 16) -> DataFrame:
    """INF-1: ``prompts`` with raw, finish_reason, error, elapsed_s. ``call`` gets rows as dictionaries and returns (reply, finish reason) of each.

    An exception of a batch becomes its class name in error. Rows are dealt evenly to ``tasks`` tasks. A Ledger calls by provider and remembers.
    """
    return called(prompts.repartition(tasks), call, batch)


def temperature(style, pool_index, attempt, reason):
    """RNK-2: later candidates warmer, each retry cooler; a retry after a leak, a wrong scene or a text too long stays cool. Columns in, column out.

    ``reason`` is why the attempt before was refused; it doesn't count for the first.
    """
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TEMPERATURE.items() for x in pair]), style), F.lit(OTHER_TEMPERATURE))
    warm = F.when(pool_index > 0, F.least(base + POOL_DELTA, F.lit(WARMEST))).otherwise(base)
    now = warm - COOLING * (attempt - 1)
    cool = (attempt > 1) & F.coalesce(reason, F.lit("")).isin(*COOL_REASONS)
    return F.bround(F.when(cool, F.least(now, F.lit(COOL))).otherwise(F.least(F.greatest(now, F.lit(LEAST)), F.lit(WARMEST))), 6)


def token_limit(base, attempt, reason):
    """RNK-2: tokens that an attempt may use: more on a retry, most after a text that was cut."""
    more = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MORE_TOKENS.items() for x in pair]), F.coalesce(reason, F.lit(""))), F.lit(OTHER_TOKENS))
    return base + F.when(attempt > 1, more).otherwise(0)


def attempt_rounds(prompts: DataFrame, call, rules: RuleBook, tasks: int, most: int = 3, base_tokens: int = 140, ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """INF-2: every prompt (task_id, style, pool_index, prompt) called until its caption is good or ``most`` times; the last reply of each.

    Each round works on the failing rows only. With ``ask``, such as ``lambda rows: ledger.call(rows, call)``, that makes the calls (prompts need a model then), and a
    run that broke off repeats no finished call; without it each round is checkpointed, so a lost executor repeats one round's calls at most.
    """
    open_, done = prompts.withColumn("_before", F.lit("")), None
    for n in range(1, most + 1):
        asked = open_.withColumns({"attempt": F.lit(n), "temperature": temperature(F.col("style"), F.col("pool_index"), F.lit(n), F.col("_before")), "max_tokens": token_limit(F.lit(base_tokens), F.lit(n), F.col("_before"))}).drop("_before")
        replies = ask(asked) if ask else call_model(asked, call, tasks)
        replies = replies.withColumn("reason", F.when(F.col("error").isNotNull(), F.col("error")).otherwise(bad_output(F.col("raw"), F.col("style"), rules)))
        replies = replies if ask else checkpointed(replies)  # the ledger's files end the lineage of its replies
        good = replies if n == most else replies.where("reason = ''")
        done = good if done is None else done.unionByName(good)
        open_ = replies.where("reason <> ''").select(*prompts.columns, F.col("reason").alias("_before"))
        if n < most and open_.isEmpty():
            break
    return done


def judge_rounds(captions: DataFrame, judge: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rules: RuleBook, settings: Settings, most: int = 2) -> DataFrame:
    """INF-3: judge, find failures, rewrite them with feedback, judge again, and keep the best of each (task_id, style) with its text.

    ``captions``: (task_id, style, text), one row a key. ``judge`` adds accuracy, style_match, issue, meta_leak, skipped, skip_reason; ``rewrite`` gets the failing
    rows with feedback and returns (task_id, style, text). A round works on failing keys only and is checkpointed.
    """
    every = checkpointed(judge(captions).withColumn("round", F.lit(0)))
    last = every
    for n in range(1, most + 1):
        bad = last.where(failing(last, settings) | (score_reason(F.col("text"), F.col("style"), rules) != "ok")).withColumn("feedback", feedback(last))
        if bad.isEmpty():
            break
        last = checkpointed(judge(rewrite(bad.select("task_id", "style", "text", "feedback")).select("task_id", "style", "text")).withColumn("round", F.lit(n)))
        every = every.unionByName(last)
    best = keep_best(every, settings, most, rules)
    return best.join(every.select("task_id", "style", "round", "text"), ["task_id", "style", "round"])


def model_panel(models: list[str], primary: str, alternate: str) -> list[str]:
    """SET-2: the models of a panel, trimmed, distinct, in order; none named: the primary and, if it differs, the alternate."""
    named = list(dict.fromkeys(m.strip() for m in models if m and m.strip()))
    return named or list(dict.fromkeys([primary, alternate]))
