"""TXT-5 for many examples: an index of the examples by their rarest sampled q-gram, joined to texts, then exact containment.

A text echoes an example if their keys are equal, or differ by at most SLACK characters in length and one holds the other.  Then the inner part of the
example, SLACK characters from each end, lies in the text whichever of the two is longer.  So an example is indexed under one q-gram of its inner part, that
which the fewest examples have, of those whose hash is a multiple of SAMPLED if there are any.  Texts whose length no example is near are left out at once, the
others give their sampled q-grams, and all of them only where an example near in length has no sampled one.  Keys too short for an inner part meet by
equality: the shorter is one of the few substrings of the longer that are long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_rules import example_key

#: Characters by which lengths may differ, characters of a q-gram, and one of how many q-grams is sampled.
SLACK, Q, SAMPLED = 12, 8, 16
#: Keys shorter than this have no inner part with a q-gram.
SHORT = 2 * SLACK + Q


def _grams(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{Q}}}))"), F.lit(1))


def _drawn(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SAMPLED)) == 0


def _near(n: Column) -> Column:
    return F.explode(F.sequence(F.greatest(n - SLACK, F.lit(0)), n + SLACK))


def _substrings(key: Column, n: Column) -> Column:
    """Those of a short key that lack at most SLACK characters, the whole key and, of a key that short, the empty text among them."""
    of_length = lambda m: F.transform(F.sequence(F.lit(0), n - m), lambda s: F.substring(key, s + 1, m))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(n - SLACK, F.lit(0)), n), of_length)))


def _keys(df: DataFrame, text_col: str) -> DataFrame:
    """(id, k, n): the distinct keys, their hash and length."""
    keys = df.select(example_key(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("k")).distinct()
    return keys.select(F.md5("k").alias("id"), "k", F.length("k").alias("n"))


def example_index(examples: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, e_id, e_n, sampled) for each distinct example of SHORT characters or more: its rarest q-gram among the examples, ties to the first in order."""
    inner = _keys(examples, text_col).where(F.col("n") >= SHORT)
    grams = inner.select("id", "n", F.explode(F.array_distinct(_grams(F.substring("k", F.lit(SLACK + 1), F.col("n") - 2 * SLACK)))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("many"))
    best = grams.join(often, "gram").groupBy("id", "n").agg(F.min(F.struct((~_drawn(F.col("gram"))).alias("whole"), "many", "gram")).alias("x"))
    return best.select("x.gram", F.col("id").alias("e_id"), F.col("n").alias("e_n"), (~F.col("x.whole")).alias("sampled"))


def example_echoes(texts: DataFrame, examples: DataFrame, text_col: str = "text", example_col: str = "text") -> DataFrame:
    """TXT-5: ``texts`` with echo: whether a text repeats one of ``examples``.

    Null texts count as empty, which echo nothing; a null or empty example is held by every short text. Repeated texts are compared once.
    """
    keyed = texts.withColumn("_id", F.md5(example_key(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    said, shown = _keys(texts, text_col).where("n > 0"), _keys(examples, example_col)
    index = example_index(examples, example_col)
    lengths = index.select("e_n", "sampled").distinct().select(_near(F.col("e_n")).alias("n"), "sampled").groupBy("n").agg(F.bool_or(~F.col("sampled")).alias("dense"))
    grams = said.join(lengths, "n").select("id", "n", "dense", F.explode(_grams(F.col("k"))).alias("gram")).where(F.col("dense") | _drawn(F.col("gram"))).select("id", "n", "gram")
    may = grams.join(index, "gram").where(F.abs(F.col("n") - F.col("e_n")) <= SLACK).select("id", "e_id").distinct()
    both = may.join(said, "id").join(shown.select(F.col("id").alias("e_id"), F.col("k").alias("e")), "e_id")
    long = both.where(F.contains("k", "e") | F.contains("e", "k")).select("id")
    few_said, few_shown = said.where(F.col("n") < SHORT + SLACK), shown.where(F.col("n") < SHORT)
    part = lambda df: df.select("id", F.explode(_substrings(F.col("k"), F.col("n"))).alias("part"))
    held = part(few_said).join(few_shown.select(F.col("k").alias("part")), "part").select("id")
    holds = part(few_shown).select("part").distinct().join(few_said.select("id", F.col("k").alias("part")), "part").select("id")
    echoed = long.unionByName(held).unionByName(holds).distinct().select(F.col("id").alias("_of"), F.lit(True).alias("_hit"))
    return keyed.join(echoed, F.col("_id") == F.col("_of"), "left").withColumn("echo", F.coalesce("_hit", F.lit(False))).drop("_id", "_of", "_hit")
