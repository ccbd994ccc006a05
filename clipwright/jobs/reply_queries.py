"""Queries on replies whose JSON repeats keys, names a key without a value, or goes on after its object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_once
from ..operators import describe
from ..operators import judging as op
from .derived import STYLE_LIST, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _n() -> F.Column:
    return F.col("event_id")


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _score(n: F.Column, most: int = 100) -> F.Column:
    return F.format_string("%.2f", n % most / 100)


@query(
    "jdg_4_repeated_keys",
    """SELECT event_id, CASE WHEN k = 4 THEN NULL ELSE CASE WHEN k = 5 THEN b ELSE a END END AS accuracy, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN b ELSE c END AS style_match, CASE k WHEN 4 THEN 'InvalidJSON: scores must be floats in [0, 1]' ELSE '' END AS error
FROM (SELECT event_id, event_id % 6 AS k, (event_id % 100)::DOUBLE / 100 AS a, (event_id % 89)::DOUBLE / 100 AS b, (event_id % 97)::DOUBLE / 100 AS c FROM events)""",
)
def jdg_4_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Scores told twice: the last counts, also in cut replies (5); style_fit counts where style_match is absent (3), not where it is null (4)."""
    a, b, c = _score(_n()), _score(_n(), 89), _score(_n(), 97)
    match = F.when(_n() % 6 == 3, F.concat(F.lit('"style_fit": '), b)).when(_n() % 6 == 4, F.concat(F.lit('"style_match": null, "style_fit": '), b)).otherwise(F.concat(F.lit('"style_match": 0.1, "style_match": '), c))
    last = F.when(_n() % 6 == 5, b).otherwise(a)
    raw = F.concat(F.lit('{"accuracy": 0.99, '), match, F.lit(', "accuracy": '), last, F.when(_n() % 6 == 5, ', "issue": "cu').otherwise("}"))
    return op.parse_style_reply(table(spark, d, "events").select("event_id", raw.alias("raw"))).select("event_id", "accuracy", "style_match", "error")


@query(
    "jdg_3_repeated_keys",
    f"""SELECT event_id, style, CASE WHEN skip_reason <> '' THEN 0 ELSE (event_id % 89)::DOUBLE / 100 END AS accuracy, skip_reason, CASE WHEN k = 2 THEN 0 ELSE 0.25 END::DOUBLE AS distinctness, CASE WHEN k = 2 THEN 'InvalidJSON' ELSE '' END AS parse_error
FROM (SELECT *, event_id % 5 AS k, CASE WHEN event_id % 5 = 2 OR style <> 'formal' THEN 'judge-missing-style' ELSE '' END AS skip_reason FROM (SELECT event_id, unnest({STYLE_LIST}) AS style FROM events))""",
)
def jdg_3_repeated(spark: SparkSession, d: str) -> DataFrame:
    """A style told twice, with a score told twice; another that is no object; now and then (2) a second object behind the first."""
    entry = lambda x, y: F.concat(F.lit('"formal": {"accuracy": '), x, F.lit(', "style_match": 0.5, "accuracy": '), y, F.lit("}"))
    body = F.concat(F.lit('{"cross_style_distinctness": 0.75, "captions": {'), entry(F.lit("0.5"), _score(_n())), F.lit(', "sarcastic": 5, '), entry(_score(_n()), _score(_n(), 89)), F.lit('}, "cross_style_distinctness": 0.25}'))
    raw = F.when(_n() % 5 == 2, F.concat(body, F.lit(" and {}"))).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" done")))
    return op.parse_batch_reply(table(spark, d, "events").select("event_id", raw.alias("raw"))).select("event_id", "style", "accuracy", "skip_reason", "distinctness", "parse_error")


@query(
    "dsc_2_repeated_keys",
    """SELECT event_id, CASE WHEN event_id % 4 = 1 OR event_id % 5 = 4 THEN 'InvalidJSON' ELSE '' END AS reason, CASE WHEN event_id % 4 = 1 OR event_id % 5 = 4 THEN '' ELSE event_type END AS subject,
  CASE WHEN event_id % 4 = 1 OR event_id % 5 = 4 THEN '' ELSE 'the last of two settings' END AS setting FROM events""",
)
def dsc_2_repeated(spark: SparkSession, d: str) -> DataFrame:
    """A setting and a subject's name told twice; a null at last (1) makes the setting missing; a subject that is no object (4) refuses the reply."""
    last = F.when(_n() % 4 == 1, "null").otherwise('"the last of two settings"')
    second = F.when(_n() % 5 == 4, "7").otherwise('{"colors": "red"}')
    raw = F.concat(F.lit('{"setting": "the first", "actions_early": "a", "actions_late": "b", "subjects": [{"name": "x", "name": "'), F.col("event_type"), F.lit('"}, '), second, F.lit('], "setting": '), last, F.lit("}"))
    rows = with_once(table(spark, d, "events").select("event_id", raw.alias("raw")), p=describe.parse_description(F.col("raw")))
    return rows.select("event_id", "p.reason", F.coalesce(F.get("p.d.subjects", F.lit(0))["name"], F.lit("")).alias("subject"), F.coalesce("p.d.setting", F.lit("")).alias("setting"))
