"""Places of rows in an order without a task that holds a whole group or table: by chunks of a group, or by ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Numbers of a group's order that make a chunk.
CHUNK = 1_024


def chunk_of(order: str, chunk: int = CHUNK) -> Column:
    return F.floor(F.col(order) / chunk)


def before_chunks(rows: DataFrame, keys: list[str], order: str, value: Column, chunk: int = CHUNK) -> DataFrame:
    """(keys, _chunk, _before): what ``value``, an aggregate, gives for the chunk that comes before in its group; null for the first.

    Only a row for each chunk is put in order.
    """
    each = rows.groupBy(*keys, chunk_of(order, chunk).alias("_chunk")).agg(value.alias("_v"))
    return each.select(*keys, "_chunk", F.lag("_v").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before"))


def with_place(rows: DataFrame, keys: list[str], order: str, place: str, total: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with their place from 0 within their group, by the whole numbers in ``order``, and the group's rows: ranked in chunks, plus what the chunks before hold."""
    each = rows.groupBy(*keys, chunk_of(order, chunk).alias("_chunk")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_n").over(group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select(*keys, "_chunk", ahead.alias("_ahead"), F.sum("_n").over(group).alias(total))
    held = rows.withColumn("_chunk", chunk_of(order, chunk))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order)) - 1
    return held.withColumn("_i", within).join(each, [*keys, "_chunk"]).withColumn(place, F.col("_i") + F.col("_ahead")).drop("_chunk", "_i", "_ahead")


def with_position(rows: DataFrame, order: list[Column], position: str) -> DataFrame:
    """``rows`` with 1, 2, 3, ... in ``order``, which should tell rows apart: sorted by range, each range counted on from the ranges before.

    The sorted rows are checkpointed; one number for each range is added up.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(position, F.col("_ahead") + F.col("_at") + 1).drop("_range", "_at", "_ahead")
