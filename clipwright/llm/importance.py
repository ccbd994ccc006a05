"""Importance resampling of documents towards a target distribution, in Spark SQL functions alone.

Runs of words are exploded and dealt to buckets by crc32; the counts of a bucket in the corpus and in the target give its gain, a table of as many rows as
there are buckets, which is joined to the exploded runs again; a document's weight is the sum of its gains.  A Gumbel key from a hash of the id
makes the highest scores a draw without replacement.  Ranks come from one distributed sort: places within range partitions, plus how many rows lie in the
partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, fresh, stage, table

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10


def runs_of(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space; repeats stay."""
    found = [words]
    for n in range(2, longest + 1):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(starts, lambda s: F.array_join(F.slice(words, s, n), " ")))  # noqa: B023
    return F.concat(*found) if len(found) > 1 else words


def bucket_of(run: Column, buckets: int) -> Column:
    return F.crc32(run.cast("binary")) % F.lit(buckets)


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many runs of all ``texts`` lie in each bucket that has any."""
    runs = texts.select(F.explode(runs_of(ascii_words(F.col(f"`{text_col}`")), longest)).alias("run"))
    return runs.groupBy(bucket_of(F.col("run"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for each bucket that ``docs`` fill, at most ``buckets`` rows: floor(1000 ln of the smoothed ratio of target to corpus)."""
    ours = stage(bucket_counts(docs, text_col, longest, buckets))
    theirs = stage(bucket_counts(target, text_col, longest, buckets).withColumnRenamed("n", "m"))
    of = lambda df, c: float(df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0])
    s, t = of(ours, "n"), of(theirs, "m")
    ratio = (F.coalesce("m", F.lit(0)).cast("double") + 1) * F.lit(s + buckets) / ((F.col("n").cast("double") + 1) * F.lit(t + buckets))
    return ours.join(F.broadcast(theirs), "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(id_col: Column, seed: int) -> Column:
    """A Gumbel variate in whole thousandths, from the first 32 bits of sha256 of seed and id; null ids count as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id_col, n_words, n_features, weight), a row for each row of ``docs``; ``gains`` has at most ``buckets`` rows.

    Runs of a row are added up where they are, by id, hash of the text and partition, so the shuffle has one row for each document and a repeated row is
    counted once and given back as often as it occurs.
    """
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.spark_partition_id().alias("part"), ascii_words(F.col(f"`{text_col}`")).alias("w"))
    runs = words.select("id", "h", "part", F.size("w").alias("n_words"), F.posexplode_outer(runs_of(F.col("w"), longest)).alias("at", "run"))
    valued = runs.join(F.broadcast(gains.withColumnRenamed("bucket", "of")), bucket_of(F.col("run"), buckets) == F.col("of"), "left")
    heads = F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("copies")
    summed = valued.groupBy("id", "h", "part", "n_words").agg(heads, F.count("run").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    once = summed.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.expr("n div copies").alias("n_features"), F.expr("g div copies").alias("weight"), "copies")
    many = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return once.withColumn("_copy", many).drop("_copy", "copies")


def with_rank(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``rows`` with 1, 2, 3, ... in ``order``: sorted by range, so that no task sees more than its range; ``order`` should tell rows apart.

    Places within a partition are written with the rows; what lies before a partition is a sum over one number for each partition.
    """
    place, part, before = (fresh(rows, c) for c in ("place", "part", "before"))
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(ahead), F.lit(0)))
    return dealt.join(F.broadcast(sizes), part).withColumn(rank, F.col(before) + F.col(place) + 1).drop(place, part, before)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank), a row for each row of ``docs``: rank 1, 2, 3, ... of those drawn, null for the others.

    Of the N rows with at least ``least_words`` words, floor(``percent`` * N / 100) are drawn, by highest score, ties to the smaller id, null ids last.
    Null and empty texts have no words and weight 0. Repeated rows each get a row and take part each. Empty tables give an empty result; an empty target
    gives gains by rarity alone.
    """
    scored = weighted(docs, gain_table(docs, target, text_col, longest, buckets), id_col, text_col, longest, buckets)
    scored = stage(scored.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)).withColumn("_row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = with_rank(able, [F.desc("score"), F.asc_nulls_last(id_col), F.col("_row").asc()])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("_row")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document, drawn towards ``benchmark``."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance": op12_importance}
ORACLES = {
    "op12_importance": r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), dw AS (SELECT r, unnest(w) AS f FROM d),
b AS (
  SELECT unnest(coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])) AS f FROM benchmark
), bytes AS (
  SELECT f, list_transform(range(0, strlen(f)), lambda k: CAST('0x' || substr(hex(encode(f)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)) AS x
  FROM (SELECT f FROM dw UNION SELECT f FROM b)
), dealt AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN dealt USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN dealt USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (SELECT r, sum(gain) AS weight FROM dw JOIN dealt USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n >= 20
)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
""",
}
