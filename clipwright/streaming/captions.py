"""Streams of captions: scoring as they arrive (STR-1), the best so far (STR-2), upserts of descriptions (STR-3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RuleBook
from ..operators.captions import with_rank
from ..operators.tasks import upsert

OUT = "task_id string, style string, text string, score_rank int, pool_index int, updates long"
STATE = "text string, score_rank int, pool_index int, updates long"


def scored_stream(captions: DataFrame, rules: RuleBook) -> DataFrame:
    """STR-1: adds ok, score_rank, score_reason; without state, so it appends."""
    return with_rank(captions, rules)


def _best(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    best = state.get if state.exists else None
    seen, latest = (best[3] if best else 0), 0
    for batch in batches:
        latest = max(latest, int(batch["ts"].max().timestamp() * 1000))
        for row in batch.itertuples(index=False):
            seen += 1
            if best is None or (row.score_rank, -row.pool_index) > (best[1], -best[2]):
                best = (row.text, int(row.score_rank), int(row.pool_index), seen)
    state.update((best[0], best[1], best[2], seen))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 3_600_000)
    yield pd.DataFrame([(*key, best[0], best[1], best[2], seen)], columns=["task_id", "style", "text", "score_rank", "pool_index", "updates"])


def best_so_far(scored: DataFrame, late: str = "10 minutes") -> DataFrame:
    """STR-2: in update mode, the best caption of each (task_id, style) so far. A key's state goes an hour of event time after its last caption."""
    rows = scored.withWatermark("ts", late).select("task_id", "style", "text", "score_rank", "pool_index", "ts")
    return rows.groupBy("task_id", "style").applyInPandasWithState(_best, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


CACHE = "task_id string, text string, source string"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket, newest first; a version counts once its write has been committed. At most a few names a bucket."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for mark in fs.globStatus(hadoop(f"{path}/v*/_SUCCESS")) or []:
        version = mark.getPath().getParent()
        for part in fs.globStatus(hadoop(f"{version}/bucket=*")) or []:
            found.setdefault(int(part.getPath().getName().split("=")[1]), []).append(int(version.getName()[1:]))
    return {k: sorted(v, reverse=True) for k, v in found.items()}


def read_cache(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """(task_id, text, source) of the newest version of each bucket, or of those asked for; an empty table if there are none."""
    paths = [f"{path}/v{v[0]}/bucket={k}" for k, v in sorted(_listed(spark, path).items()) if buckets is None or k in buckets]
    return spark.read.schema(CACHE).parquet(*paths) if paths else spark.createDataFrame([], CACHE)


def upsert_batch(cache_path: str, buckets: int = 64):
    """STR-3: a foreachBatch function: the batch's descriptions (task_id, text, ts) over the cache; the last ts of a task in a batch wins, of its texts that aren't empty.

    The cache lies in buckets by a hash of task_id. A batch reads and writes only the buckets of its keys, as a new version over the newest one that is there, whatever
    the number of the batch; so a stream that starts anew keeps the cache, and a batch that runs again changes nothing. Versions older than the one before go.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        live = batch.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("task_id").agg(F.max_by("text", "ts").alias("text")).persist()
        touched = [r.b for r in live.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            known = _listed(spark, cache_path)
            version = 1 + max((v[0] for v in known.values()), default=-1)
            new = upsert(read_cache(spark, cache_path, touched).select("task_id", "text"), live).withColumn("bucket", _bucket(buckets))
            new.repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{cache_path}/v{version}")
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            for k in touched:
                for old in known.get(k, [])[1:]:
                    gone = hadoop(f"{cache_path}/v{old}/bucket={k}")
                    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        live.unpersist()

    return run
