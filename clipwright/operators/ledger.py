"""Model calls that outlive a lost run (INF-1, INF-2): a ledger of finished calls, and lanes that bound the calls in flight for each provider (TSK-7).

A call is named by (task_id, style, pool_index, model, attempt) and a hash of its whole request, so a changed prompt is a new call.  Calls run in
waves of bounded length; the replies of each task of a wave are in the ledger as soon as the task ends, also if the wave or the driver dies later.  A
run first leaves out what the ledger holds, so it pays for the calls that were in flight at most.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpointed
from .inference import REPLY, called
from .tasks import provider

KEY = ["task_id", "style", "pool_index", "model", "attempt"]
_TEXT, _INT = T.StringType(), T.IntegerType()
_NAMED = [T.StructField(c, k) for c, k in zip([*KEY, "request"], (_TEXT, _TEXT, _INT, _TEXT, _INT, T.LongType()), strict=True)]
ENTRY = T.StructType([*_NAMED, *REPLY.fields, T.StructField("finished_at", T.TimestampType())])


@dataclass(frozen=True)
class Lanes:
    """How many calls of each provider may be in flight, and of each other provider; a lane is one task, which calls one batch after the other."""

    most: Mapping[str, int] = field(default_factory=lambda: {"direct": 4, "router": 8, "default": 8})
    others: int = 2
    #: Calls of a lane in one wave, on average: what a lost task repeats.
    calls: int = 500

    def __post_init__(self):
        if min([*self.most.values(), self.others, self.calls]) < 1:
            raise ValueError("every provider needs a lane, and a lane a call")

    @property
    def total(self) -> int:
        return sum(self.most.values()) + self.others

    def lane(self, name: Column, salt: Column) -> Column:
        """The partition of a call: its provider's lanes in turn, by a hash of the call, so a hot provider uses all of its lanes and no other's."""
        start, out = 0, None
        for known, n in sorted(self.most.items()):
            at = F.lit(start) + F.pmod(salt, F.lit(n)).cast("int")
            out = F.when(name == known, at) if out is None else out.when(name == known, at)
            start += n
        rest = F.lit(start) + F.pmod(salt, F.lit(self.others)).cast("int")
        return rest if out is None else out.otherwise(rest)


def request_of(prompts: DataFrame) -> Column:
    """A hash of all that a request says besides its key; maps can't be hashed and are left out."""
    told = [F.col(f"`{f.name}`") for f in prompts.schema if f.name not in KEY and "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*told) if told else F.lit(0).cast("long")


@dataclass(frozen=True)
class Ledger:
    """Finished calls as Parquet files under ``path``, in a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def finished(self) -> DataFrame:
        """A row of ENTRY for each call; of one that two runs made the earlier reply counts."""
        self.spark.createDataFrame([], ENTRY).write.mode("append").parquet(self.path)  # the folder, where there is none
        rest = [f.name for f in ENTRY if f.name not in (*KEY, "request", "finished_at")]
        rows = self.spark.read.schema(ENTRY).parquet(self.path)
        first = rows.groupBy(*KEY, "request").agg(F.min(F.struct("finished_at", *rest)).alias("x"))
        return first.select(*KEY, "request", *[f"x.{c}" for c in rest], "x.finished_at")

    def _append(self, replies: DataFrame) -> None:
        # This committer moves a task's file when the task ends, so what ended before a failure stays.
        replies.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(self.path)

    def open(self, prompts: DataFrame) -> DataFrame:
        """``prompts`` (KEY, ...) without those whose call is finished."""
        return self._joined(prompts, self.finished().select(*KEY, "request"), "left_anti")

    def _joined(self, prompts: DataFrame, entries: DataFrame, how: str) -> DataFrame:
        asked = prompts.withColumn("_request", request_of(prompts))
        held = entries.withColumnsRenamed({c: f"_of_{c}" for c in (*KEY, "request")})
        same = F.col("_request") == F.col("_of_request")
        for c in KEY:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        return asked.join(held, same, how).drop("_request", *[f"_of_{c}" for c in (*KEY, "request")])

    def call(self, prompts: DataFrame, call: Callable[[list[dict]], list[tuple[str, str]]], lanes: Lanes = Lanes(), batch: int = 16) -> DataFrame:
        """INF-1 with a memory: ``prompts`` (KEY, ...) with raw, finish_reason, error, elapsed_s, each call made once, whatever runs broke off before.

        No more tasks of one provider run at once than ``lanes`` allows, each with one batch in flight. A failed call is finished too, with its error. Repeated
        prompts share a call. Columns of ``prompts`` must not be called as those of a reply.
        """
        keyed = prompts.select(*[F.col(c).cast(ENTRY[c].dataType).alias(c) if c in KEY else F.col(f"`{c}`") for c in prompts.columns])
        missing = self.open(keyed).withColumn("_request", request_of(keyed)).dropDuplicates([*KEY, "_request"])
        salt = F.xxhash64(*KEY)
        dealt = checkpointed(missing.withColumn("_lane", lanes.lane(provider(F.col("model"))["provider"], salt)))
        longest = dealt.groupBy("_lane").count().agg(F.max("count")).first()[0]  # a row a lane
        waves = -(-(longest or 0) // lanes.calls)
        for wave in range(waves):
            # Hashed apart from the lane, else a wave would hold some lanes only.
            part = dealt.where(F.pmod(F.xxhash64(F.lit("wave"), *KEY), F.lit(waves)) == wave).repartitionById(lanes.total, F.col("_lane"))
            replies = called(part, call, batch, hidden=["_request", "_lane"])
            self._append(replies.select(*KEY, F.col("_request").alias("request"), *REPLY.names, F.current_timestamp().alias("finished_at")))
        return self._joined(keyed, self.finished().drop("finished_at"), "inner")
