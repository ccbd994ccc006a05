"""Queries on model calls: a stand-in model, whose replies SQL can tell, called through the ledger and the lanes of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RuleBook
from ..operators.inference import attempt_rounds
from ..operators.ledger import KEY, Lanes, Ledger
from ..operators.tasks import provider
from ..sources.shared import shared_path
from .derived import CAPTIONS, captions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODELS = ["gemma-2", "vendor/some-model", "accounts/team/models/one", "plain-model"]
PROVIDERS = ["direct", "router", "default", "default"]
GOOD = "A small boat crosses the quiet bay at dawn. Gulls circle above the wooden mast."


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("task_id") % 4 + 1).cast("int"))
    return captions(spark, d).select(F.col("task_id").cast("string").alias("task_id"), "style", F.col("pool_index").cast("int").alias("pool_index"), model.alias("model"), F.coalesce("text", F.lit("")).alias("prompt"))


PROMPTS = f"""SELECT task_id::VARCHAR AS task_id, style, pool_index::INT AS pool_index, ['{"', '".join(MODELS)}'][(task_id % 4 + 1)::INT] AS model, ['{"', '".join(PROVIDERS)}'][(task_id % 4 + 1)::INT] AS provider, coalesce(text, '') AS prompt
FROM ({CAPTIONS})"""


@query("inf_1_call_ledger", f"SELECT * EXCLUDE (prompt), model || '|' || length(prompt)::VARCHAR || '|' || left(prompt, 12) AS raw, 1::BIGINT AS calls FROM ({PROMPTS})")
def inf_1(spark: SparkSession, d: str) -> DataFrame:
    """A first run over every third task, as if it had broken off, then one over all: each call is in the ledger once."""
    ledger = Ledger(spark, shared_path(spark, "ledger"))
    prompts = _prompts(spark, d).withColumn("attempt", F.lit(1))
    call = lambda rows: [(f"{r['model']}|{len(r['prompt'])}|{r['prompt'][:12]}", "stop") for r in rows]
    ledger.call(prompts.where(F.col("task_id").cast("long") % 3 == 0), call)
    replies = ledger.call(prompts, call)
    made = spark.read.parquet(ledger.path).groupBy(*KEY).agg(F.count("*").alias("calls"))
    return replies.join(made, KEY).select("task_id", "style", "pool_index", "model", provider(F.col("model"))["provider"].alias("provider"), "raw", "calls")


@query(
    "inf_2_attempt_rounds",
    f"""SELECT task_id, style, pool_index, attempt, CASE WHEN k < 6 THEN '' ELSE 'Incomplete' END AS reason, CASE WHEN attempt = 1 THEN 140 ELSE 200 END AS max_tokens
FROM (SELECT *, CASE WHEN k < 2 THEN 1 WHEN k < 4 THEN 2 ELSE 3 END AS attempt FROM (SELECT task_id, style, pool_index, (task_id::BIGINT + pool_index) % 7 AS k FROM ({PROMPTS})))""",
)
def inf_2(spark: SparkSession, d: str) -> DataFrame:
    """Rounds through the ledger: a prompt's caption is good in its first, second or third attempt, or never."""
    ledger = Ledger(spark, shared_path(spark, "rounds"))
    call = lambda rows: [(GOOD if (int(r["task_id"]) + r["pool_index"]) % 7 < 2 * r["attempt"] else "bad", "stop") for r in rows]
    done = attempt_rounds(_prompts(spark, d), None, RuleBook(), 1, ask=lambda asked: ledger.call(asked, call, Lanes(calls=5_000)))
    return done.select("task_id", "style", "pool_index", "attempt", "reason", "max_tokens")
