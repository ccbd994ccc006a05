"""From documents to packed training sequences: five stages, each over everything that the stage before kept.

toxicity -> quality -> near_dedup -> pii -> packing.  A stage's result is written as Parquet to the shared folder and read again as the next one's
documents.  All but the last return the columns of ``documents``; extra columns pass through them unchanged.
Null texts are kept up to packing, where they count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright.llm import near_dedup, packing, pii, quality, toxicity
from clipwright.llm.common import fresh, small_batches, stage, table

#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "surrogate key of the pipeline"
#: Bytes of rows that go to a Python worker at a time: the workers of all stages live side by side in an executor, so each gets less than with one operator.
BATCH_BYTES = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    small_batches(spark, BATCH_BYTES)
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity_score")
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*_all(docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose quality score is below 0.5."""
    small_batches(spark, BATCH_BYTES)
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*_all(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark, BATCH_BYTES)
    return near_dedup.keep_one(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for private data; n_chars follows the new text."""
    small_batches(spark, BATCH_BYTES)
    out, _ = pii.replace_private(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*_all(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    small_batches(spark, BATCH_BYTES)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_copies),
    ("pii", hide_private),
    ("packing", pack),
]

#: The models and tokenizer of the stages are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
