"""Decontamination, importance resampling and hard negatives against brute force, with trees and windows small enough to branch."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwright.llm import decontamination, hard_negatives, importance
from clipwright.llm.common import ascii_words, stage

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_words(spark):
    texts = ["", None, "Ab\x00c-D 9x_É é", "  ,", "ÀB漢字\U0001f600z", "a" * 5000, "\n\tX"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", ascii_words(F.col("text")).alias("w")).collect()
    assert {r.k: r.w for r in rows} == {k: words(t) for k, t in enumerate(texts)}


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents over few words, so that windows, near misses and common terms abound; a third of the rows are one text."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    weights = [2.0**-k for k in range(12)]
    line = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    items = [line(rng.randint(1, 14)) for _ in range(25)] + ["w0 w0 w0 w0 w0", "w11", "", "zz yy", None]
    texts = []
    for k in range(120):
        parts = [line(rng.randint(0, 40))]
        if k % 3 == 0:
            parts += [rng.choice(items[:25]), line(5)]
        texts.append(", ".join(parts))
    texts += [texts[0]] * 60 + [None, ""]
    docs = spark.createDataFrame([(k % 170, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return stage(docs), stage(spark.createDataFrame(list(enumerate(items)), "item_id long, text string")), texts, items


@pytest.mark.parametrize(("window", "rarest"), [(4, 3), (6, 1), (10, 3)])
def test_decontamination(spark, corpus, window, rarest):
    docs, items, texts, passages = corpus
    wanted = Counter()
    for k, t in enumerate(texts):
        said, hit, found = words(t), set(), set()
        for item, p in enumerate(passages):
            w = words(p)
            n = min(len(w), window)
            for s in range(len(w) - n + 1) if w else []:
                for at in range(len(said) - n + 1):
                    if said[at : at + n] == w[s : s + n]:
                        hit.update(range(at, at + n))
                        found.add(str(item))
        wanted[(k % 170, len(said), len(hit), len(found), tuple(sorted(found)), bool(hit))] += 1
    rows = decontamination.contamination(docs, items, window, rarest).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in rows) == wanted


def test_decontamination_without_broadcast(spark, corpus, monkeypatch):
    docs, items, _, _ = corpus
    key = lambda rows: Counter((r.doc_id, r.n_hit, tuple(r["items"])) for r in rows)
    before = key(decontamination.contamination(docs, items, 4).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontamination, "few", lambda df: df)
    assert key(decontamination.contamination(docs, items, 4).collect()) == before


def test_native_plan(spark, corpus):
    docs, items, _, _ = corpus
    for df in (decontamination.contamination(docs, items, 4), importance.resample(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_proximity(spark, corpus):
    docs, items, texts, passages = corpus
    index = decontamination.positional_index(docs, items)
    by_text = {t: words(t) for t in texts}
    counts = Counter(w for t in {(k % 170, t) for k, t in enumerate(texts)} for w in by_text[t[1]])
    term = {r.word: r.term for r in spark.createDataFrame([(w,) for w in {x for p in passages for x in words(p)}], "word string").select("word", decontamination.term_of(F.col("word")).alias("term")).collect()}
    rows = {(r.doc, r.item, r.pos) for r in decontamination.proximity_matches(index, 3).collect()}
    # A text repeated under one id is indexed as often as it occurs, which only the order of equally rare terms could notice.
    counts = {r.term: r.n for r in index.postings.groupBy("term").agg(F.count("*").alias("n")).collect()}
    wanted = set()
    for k, t in enumerate(texts):
        said = by_text[t]
        for item, p in enumerate(passages):
            need = sorted({(counts.get(term[w], 0), term[w], w) for w in words(p)})[:3]
            if need and need[0][0]:
                wanted |= {(k % 170, str(item), at) for at, w in enumerate(said) if w == need[0][2] and {x[2] for x in need} <= set(said[max(0, at - 3) : at + 4])}
    assert rows == wanted and rows


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, corpus, longest):
    docs, items, texts, passages = corpus
    runs = lambda t: [" ".join(w[s : s + n]) for w in [words(t)] for n in range(1, longest + 1) for s in range(len(w) - n + 1)]
    bucket = lambda run: zlib.crc32(run.encode()) % 50
    s, t = (Counter(bucket(r) for x in part for r in runs(x)) for part in (texts, passages))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((n + 1) * (t.total() + 50)))) for b, n in s.items()}
    scored = []
    for k, x in enumerate(texts):
        h = int(hashlib.sha256(f"7:{k % 170}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in runs(x))
        scored.append((k % 170, len(words(x)), len(runs(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= 10), key=lambda x: (-x[4], x[0]))
    drawn = len(able) * 30 // 100
    rows = importance.resample(docs, items, percent=30, least_words=10, longest=longest, buckets=50, seed=7).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in rows) == Counter(scored)
    top = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in top] == list(range(1, drawn + 1)) and [(r.doc_id, r.score) for r in top] == [(x[0], x[4]) for x in able[:drawn]]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("score"), "id").repartition(13)
    ranked = importance.with_rank(rows, [F.desc("score"), F.asc("id")]).collect()
    assert sorted((r["rank"], r.score, r.id) for r in ranked) == [(k + 1, -a, b) for k, (a, b) in enumerate(sorted((-(i % 7), i) for i in range(1000)))]


def brute_negatives(rows, k=5, m=3):
    out = []
    ids, label = [r[0] for r in rows], [r[2] for r in rows]
    v = np.array([r[1] for r in rows])
    for i in (j for j in range(len(rows)) if ids[j] % 10 == 0):
        score = v @ v[i]
        order = sorted((j for j in range(len(rows)) if ids[j] != ids[i]), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if label[j] == label[i]][:k]:
            fit = [j for j in order if label[j] != label[i] and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:m]
            out += [(ids[i], ids[p], r + 1, ids[j], score[p], score[j]) for r, j in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "one vector", "one label", "lengths"])
def test_hard_negatives(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 40
    rows = [(k, np.rint(centres[k % 12] + rng.normal(size=6) * (25 if kind != "lengths" else 4) * (1 + (k % 5 if kind == "lengths" else 0))).tolist(), int(k % 12 // 3 if k % 4 else k % 5)) for k in range(400)]
    if kind == "one vector":
        rows = [(k, rows[0][1] if k % 3 == 0 else v, y) for k, v, y in rows]
    if kind == "one label":
        rows = [(k, v, 1 if k % 40 else 2) for k, v, y in rows]
    df = stage(spark.createDataFrame(rows, "id long, v array<double>, label long").withColumn("dim", F.size("v")))
    found = hard_negatives.mine(df, df.where("id % 10 = 0"), leaf=20, group=5).collect()
    assert sorted(tuple(r) for r in found) == brute_negatives(rows) and found


@pytest.mark.parametrize("size", [1, 1e5, 1e6])
def test_hard_negatives_by_contract_on_large_components(spark, tmp_path, size):
    """Scores that double precision rounds, and steps between neighbouring scores that it loses: all by whole numbers of any length."""
    rng = np.random.default_rng(7)
    v = np.float32(rng.normal(size=(6, 12))[np.arange(330) % 6] * size + rng.normal(size=(330, 12)) * size / 50)
    v[200:260] = v[200]
    v[200:260, 3] += np.float32(np.arange(60) * size / 100_000)
    rows = [(k, x.tolist(), int(k % 10)) for k, x in enumerate(v)] + [(350, None, 1), (400, [None] * 12, 1), (450, [math.nan] * 12, 2), (500, v[0].tolist(), None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [[math.floor(256 * y) for y in x.tolist()] for x in v]
    label = [(k % 10 + (k % 7 == 0)) % 10 for k in range(330)]
    wanted = []
    for a in range(0, 330, 50):
        score = [sum(p * q for p, q in zip(whole[a], x, strict=True)) for x in whole]
        order = sorted((j for j in range(330) if j != a), key=lambda j: (-score[j], j))
        for p in [j for j in order if label[j] == label[a]][:5]:
            fit = [j for j in order if label[j] != label[a] and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:3]
            wanted += [(a, p, r + 1, j, score[p], score[j]) for r, j in enumerate(fit)]
    assert sorted(tuple(r) for r in hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect()) == sorted(wanted) and wanted


def test_products_beyond_double_precision():
    a = np.array([[3.0, 2**30 + 1, -1], [0, 0, 0], [2.0**40, 1, 7], [1, -(2.0**70), 2.0**70]])
    x = np.array([[1.0, 2**31 + 1, 5], [2.0**23 - 1, 3, 2], [1e30, 1e30, 0], [4, 2.0**70, 2.0**70]])
    exact = [[sum(int(p) * int(q) for p, q in zip(r.tolist(), s.tolist(), strict=True)) for s in x] for r in a]
    assert hard_negatives.products(a, x).tolist() == [[max(-hard_negatives.MOST, min(hard_negatives.MOST, y)) for y in r] for r in exact]


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(0)
    a, c = rng.normal(size=(5, 4)), rng.normal(size=(7, 4))
    r, s = rng.uniform(0, 1, 5), rng.uniform(0, 1, 7)
    low, high = hard_negatives.intervals(a, r, c, s)
    ball = lambda x, radius: x + (d := rng.normal(size=4)) / np.linalg.norm(d) * radius * rng.uniform()
    for _ in range(300):
        i, j = rng.integers(5), rng.integers(7)
        assert low[i, j] <= ball(a[i], r[i]) @ ball(c[j], s[j]) <= high[i, j]


def test_pairs_are_pruned(spark):
    """Far clusters meet their own leaves only: most pairs of leaves never are scored."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 1000
    rows = [(k, np.rint(centres[k % 8] + rng.normal(size=8) * 5).tolist(), int(k // 8 % 2)) for k in range(800)]
    df = stage(spark.createDataFrame(rows, "id long, v array<double>, label long"))
    trees = hard_negatives.DualTree.over(df, df.where("id % 10 = 0"), 800, 80, 8, leaf=25, group=2)
    asking = trees.asked.withColumns({"low": F.lit(500_000.0), "top": F.lit(math.inf)})
    pairs = trees.pairs(asking, hard_negatives.shares_label, None).count()
    assert 0 < pairs < 0.4 * len(trees.candidates.kept) * len(trees.anchors.kept)
