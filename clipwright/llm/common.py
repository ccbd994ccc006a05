"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that a scoring task tokenises at a time; bounds a worker's memory, not the text scored.
CHUNK_CHARS = 250_000
#: Bytes of rows that go to a Python worker at a time, if the session has Spark's own default.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever extra columns came with it."""
    names, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in names:
        name = f"_{name}"
    return name


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


#: ASCII signs that part words, and what becomes of them and of capital letters.
_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_CAPITALS = "".join(chr(c) for c in range(65, 91))


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case; null has none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _SIGNS + _CAPITALS, " " * len(_SIGNS) + _CAPITALS.lower())
    return F.array_remove(F.split(plain, " ", -1), "")


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lets Arrow batches end at ``size`` bytes, so that long texts don't gather in a Python worker; a size that has been set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864", "67108864b", "64m"):
        spark.conf.set(key, str(size))


def _staged_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/clipwright"  # one machine: its own folder is shared
    return f"{base.rstrip('/')}/clipwright-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); on a cluster that setting must be there."""
    return f"{_staged_root(spark)}/{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that the operators have written to the shared folder in this application; results not yet written can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts with null as empty) in runs of at most CHUNK_CHARS characters, or one longer text."""
    at, size, run = 0, 0, []
    for k, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > CHUNK_CHARS:
            yield at, run
            at, size, run = k, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield at, run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: dict[int, int]) -> DataFrame:
    """(text, label) of at most ``most[y]`` documents for each label value, drawn by a hash of doc_id outside fold ``held``.

    The draw is bounded, so the steps after it are too. In it, copies and near copies count once: texts that share any of
    three least hashes over neighbouring words stay as one, else a copied document would pass its words off as evidence.
    """
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(crc_fold("doc_id", folds) != held)
    parts = [y.where(F.col("label") == v).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(n) for v, n in most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # At most sum(most) ids of 8 bytes, so they go to the texts and the texts stay where they are.
    drawn = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    drawn = drawn.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")
    words = F.split(F.lower("text"), r"\s+")
    keyed = drawn.withColumn("w", words).withColumn("w", F.when(F.size("w") > 1, F.transform(F.slice("w", 2, 1_000_000_000), lambda x, i: F.concat(F.element_at("w", (i + 1).cast("int")), F.lit(" "), x))).otherwise(F.col("w")))
    for seed in range(3):
        keyed = keyed.withColumn(f"k{seed}", F.array_min(F.transform("w", lambda x: F.xxhash64(x, F.lit(seed)))))  # noqa: B023
    kept = stage(keyed.drop("w"))
    for seed in range(3):
        first = Window.partitionBy(f"k{seed}").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "text")
        kept = kept.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return stage(kept.select("text", "label"))


class TokenTable:
    """Numbers for tokens, with one row of values for each; ``values_of`` computes the rows of tokens not seen before.

    It holds at most ``most`` tokens between calls: a task over any amount of text needs bounded memory, and what was
    forgotten is merely computed again.
    """

    def __init__(self, values_of, most: int = 100_000):
        self.values_of, self.most, self.index, self.rows = values_of, most, {}, None

    def __call__(self, tokens: list[str]):
        """(number of each token, rows of values by number); both hold until the next call."""
        if len(self.index) > self.most:
            self.index, self.rows = {}, None
        index = self.index
        new = [t for t in dict.fromkeys(tokens) if t not in index]
        if new or self.rows is None:
            rows = self.values_of(new)
            start = len(index)
            index.update(zip(new, range(start, start + len(new)), strict=True))
            if self.rows is None:
                self.rows, self.used = rows, len(rows)
            else:
                if self.used + len(rows) > len(self.rows):
                    grown = np.empty((max(2 * len(self.rows), self.used + len(rows)), *rows.shape[1:]), rows.dtype)
                    grown[: self.used] = self.rows[: self.used]
                    self.rows = grown
                self.rows[self.used : self.used + len(rows)] = rows
                self.used += len(rows)
        return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)), self.rows


def with_scores(df: DataFrame, text_col: str, make_scorer, fields: str) -> DataFrame:
    """``df`` with the columns ``fields`` (name type, ...) that ``make_scorer()(list of texts) -> tuple of lists`` gives.

    Runs where the rows are, without a shuffle; all columns of ``df`` stay as they are.
    """
    names = [x.split()[0] for x in fields.split(",")]
    small_batches(df.sparkSession)

    def scored(batches):
        scorer = make_scorer()
        for batch in batches:
            yield pd.DataFrame(dict(zip(names, scorer(batch.tolist()), strict=True)))

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(scored, fields)
    out = fresh(df, "scored")
    return df.withColumn(out, udf(F.col(text_col))).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{out}.{n}").alias(n) for n in names])
