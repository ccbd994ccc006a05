"""Chunks of a group and ranges of an order: the same results at any chunk and partition count, and no group in one task."""

import random

import pytest
from pyspark.sql import functions as F

from clipwright.config import STYLES
from clipwright.functions.places import with_place, with_position
from clipwright.operators import judging, tasks
from clipwright.sources import tables


@pytest.fixture(scope="module")
def samples(spark):
    """A clip with a third of all samples, short ones, and one with wide gaps between its sample numbers."""
    rng = random.Random(2)
    hist = lambda: [rng.random() for _ in range(4)]
    rows = [("long", k, hist()) for k in range(300)] + [(f"t{k % 50}", k // 50, hist()) for k in range(550)] + [("gaps", k * k * 7, hist()) for k in range(50)] + [("zero", 0, [0.0] * 4), ("zero", 9, [0.0] * 4)]
    return spark.createDataFrame(rows, "task_id string, sample_idx long, hist array<double>").cache()


def brute_scores(rows):
    out, before = {}, {}
    for r in sorted(rows, key=lambda r: (r.task_id, r.sample_idx)):
        p = before.get(r.task_id)
        if p is None:
            out[r.task_id, r.sample_idx] = 1.0
        else:
            scale = (sum(p) * sum(r.hist)) ** 0.5
            out[r.task_id, r.sample_idx] = max(0.0, 1 - sum((a * b) ** 0.5 for a, b in zip(p, r.hist, strict=True)) / scale) ** 0.5 if scale else 1.0
        before[r.task_id] = r.hist
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 40])
def test_scene_scores_in_chunks(spark, samples, chunk):
    wanted = brute_scores(samples.collect())
    got = {(r.task_id, r.sample_idx): r.score for r in tasks.scene_scores(samples.repartition(7), chunk).collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], abs=1e-6) for k in got)


def test_a_long_clip_spreads(spark, samples):
    """Its samples are ordered in chunks: no window of the plan takes whole clips but that over a row for each chunk."""
    plan = tasks.scene_scores(samples, 64)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("_chunk" in w.split("],")[-2] or "_chunk#" in w for w in windows) == 2


@pytest.mark.parametrize("chunk", [1, 16, 1 << 40])
def test_places_in_chunks(spark, samples, chunk):
    got = {(r.task_id, r.sample_idx): (r.p, r.n) for r in with_place(samples, ["task_id"], "sample_idx", "p", "n", chunk).collect()}
    by = {}
    for k in sorted(got):
        by.setdefault(k[0], []).append(k)
    assert got == {k: (i, len(v)) for v in by.values() for i, k in enumerate(v)}
    few = tasks.even_subset(samples.select("task_id", "sample_idx"), 5, chunk)
    assert {r["count"] for r in few.groupBy("task_id").count().collect()} == {2, 5} and few.columns == ["task_id", "sample_idx"]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_positions(spark, parts):
    rows = spark.range(900).select(F.col("id"), (F.col("id") * 37 % 11).alias("s")).repartition(parts)
    got = with_position(rows, [F.desc("s"), F.asc("id")], "position").collect()
    assert [(r.s, r.id) for r in sorted(got, key=lambda r: r.position)] == [(-a, b) for a, b in sorted((-(i * 37 % 11), i) for i in range(900))]
    assert with_position(rows.limit(0), [F.col("id").asc()], "position").count() == 0


def test_weakest_first_ties_in_file_order(spark):
    rows = [(1 - c, f"b{c}", s, 0.5, 0.5, False, False) for c in range(2) for s in sorted(STYLES)] + [(9, "z", STYLES[0], 0.1, 0.2, False, False), (0, "a", STYLES[0], 0.0, 0.0, False, True)]
    df = spark.createDataFrame(rows, "clip_index long, task_id string, style string, accuracy double, style_match double, meta_leak boolean, skipped boolean")
    order = [(r.clip_index, r.style) for r in sorted(judging.weakest_first(df).collect(), key=lambda r: r.position)]
    assert order == [(9, STYLES[0]), *[(c, s) for c in range(2) for s in STYLES], (0, STYLES[0])]


def test_panel_of_many_scores(spark):
    """300,000 scores of one caption: the median's state is a count for each value, combined before the shuffle."""
    n = F.col("id")
    scores = spark.range(300_000, numPartitions=8).select(F.lit("t").alias("task_id"), F.lit(STYLES[0]).alias("style"), n.alias("judge_order"), (n % 701 / 1000).alias("accuracy"), (n * 7 % 1000 / 1000).alias("style_match"), F.lit("").alias("issue"), F.lit(False).alias("meta_leak"), F.lit(False).alias("skipped"), F.lit("").alias("skip_reason"))
    found = judging.panel(scores)
    row = found.where(F.col("style") == STYLES[0]).first()
    assert (row.accuracy, row.style_match) == (0.35, 0.5) and found.count() == len(STYLES)
    assert "partial_percentile" in found._jdf.queryExecution().executedPlan().toString() or "partial_median" in found._jdf.queryExecution().executedPlan().toString()


def test_description_cache_round_trip(spark, tmp_path):
    rows = [(f"t{k}", f"text {k}\nwith \"signs\"") for k in range(40)] + [("none", None), ("blank", ""), ("t3", "a later text")]
    tables.nested_descriptions(spark.createDataFrame(rows, "task_id string, text string"), {"source": "live", "updated_from_live": True}, each=7).coalesce(2).write.json(str(tmp_path / "c"))
    back = {r.task_id: r.text for r in tables.read_descriptions(spark, str(tmp_path / "c")).collect()}
    assert back == {k: max(t for i, t in rows if i == k and t) for k, t in rows if t}
    assert {tuple(r.meta) for r in spark.read.json(str(tmp_path / "c")).collect()} == {("live", True)}


def test_last_written_caption_ships(spark):
    rows = [(0, "a", "formal", "z first", 1), (0, "a", "formal", "a later", 2), (0, "a", "sarcastic", "x", 1)]
    df = spark.createDataFrame(rows, "clip_index long, task_id string, style string, text string, seq int")
    assert tables.nested_results(df, "seq").first().captions == {"formal": "a later", "sarcastic": "x"}
    assert tables.nested_results(df).first().captions["formal"] == "z first"
