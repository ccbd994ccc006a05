"""The index of examples against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clipwright.operators import examples
from clipwright.operators.text_rules import example_key


def brute(keys, known):
    by_length = {}
    for e in known:
        by_length.setdefault(len(e), set()).add(e)
    return {k: k != "" and any(k in e or e in k for n in range(len(k) - 12, len(k) + 13) for e in by_length.get(n, ())) for k in set(keys)}


def keys_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(example_key(F.coalesce("text", F.lit(""))).alias("k")).collect()
    return [r.k for r in rows]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij klmno", "aé漢\U0001f600 "])
def test_echoes(spark, alphabet):
    rng = random.Random(len(alphabet))
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    known = [text(rng.randint(0, 60)) for _ in range(150)] + [None, "", "a" * 200, "template number 17 of the same long beginning", "template number 18 of the same long beginning"]
    texts = [None, "", " ' ", "x" * 500]
    for _ in range(300):
        e = rng.choice(known) or ""
        kind = rng.randint(0, 4)
        texts.append([e, e[rng.randint(0, 7) : len(e) - rng.randint(0, 7)], text(rng.randint(0, 8)) + e + text(rng.randint(0, 8)), text(rng.randint(0, 60)), e[:9] + "#" + e[9:]][kind])
    texts += [texts[10]] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").withColumn("k", F.lit("clash")).withColumn("id", F.lit("clash"))
    rows = examples.example_echoes(df, spark.createDataFrame([(e,) for e in known], "e string"), example_col="e").collect()
    wanted = brute(keys_of(spark, texts), keys_of(spark, known))
    named = dict(enumerate(keys_of(spark, texts)))
    assert len(rows) == len(texts) and rows[0].k == "clash"
    assert {r.n: r.echo for r in rows} == {n: wanted[k] for n, k in named.items()} and 50 < sum(r.echo for r in rows) < len(rows)


def test_many_examples(spark):
    """200,000 examples, a third of them of one template; no array of examples, no cross join."""
    known = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("a photo of the quiet harbour at dawn, number "), F.col("id").cast("string"), F.lit(", in soft light"))).otherwise(F.sha1(F.col("id").cast("string"))).alias("text"))
    texts = known.where("crc32(text) % 900 = 0").select(F.concat(F.lit("the "), "text").alias("text")).unionByName(known.where("crc32(text) % 900 = 1").select(F.concat("text", F.lit(" and much, much more than that")).alias("text")))
    found = examples.example_echoes(texts, known)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    told = {r.text: r.echo for r in found.collect()}
    assert told == {t: brute([t], ())[t] or t.startswith("the ") for t in told} and sum(told.values()) > 100 and not all(told.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    one = spark.createDataFrame([("abc",)], "text string")
    assert examples.example_echoes(none, one).count() == 0 and not examples.example_echoes(one, none).first().echo
