"""The registered queries and the pipeline over whole small tables: the smallest given ones, a table of odd rows, and empty ones."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clipwright.llm import common, registry

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
OWN = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_mtree_top_k": ["query_id", "rank", "vec_id", "score"],
    "op6_block_nearest": ["query_id", "rank", "vec_id", "score"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9_pii": ["doc_id", "text"],
    "op10_near_dedup": ["doc_id", "class_id", "kept"],
    "op11_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


def told(x):
    return "null" if x is None or x != x else repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and long texts, ties, repeated rows, and columns with names that the operators use."""
    path = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("tor", "vel", "san", "dim", "por")]
    line = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    given = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [None, "", " \n ", "!!! ...", "a", line(30_000), "x" * 5000, line(40), line(40), None]
    texts += [texts[7]] * 12 + [f"{texts[8][:-1]} {line(2)}" for _ in range(6)] + [f"Mr. Smith wrote to ann{k}@mail.example.org: {line(20)}" for k in range(8)] + ["pass the dolt a doltface " + line(12) for _ in range(9)]
    rows = [(None if k == 9 else k, t, "en" if k % 3 else None) for k, t in enumerate(texts)] + [(7, texts[7], "en"), (7, "another text of the same id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in given.columns:
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(given.schema[c].dataType))
    for c in ("score", "label", "length", "id", "node", "size", "band", "ids", "rare", "_id", "doc", "h", "w", "item", "rank", "weight", "part"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(k, int("dolt" in (t or "")), int(k % 4 > 0)) for k, t in enumerate(texts)] + [(None, 1, 1), (5000, None, None)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{path}/labels.parquet")
    v = np.round(np.random.default_rng(0).normal(size=(60, 4)), 2)
    v[20:45] = v[20]
    vectors = [(k, [float(y) for y in x]) for k, x in enumerate(v)] + [(60, None), (80, [None, 1.0, 1.0, 1.0]), (100, [float("nan")] * 4), (120, [0.0] * 4), (None, [1.0] * 4), (140, [1.0, 2.0]), (20, [float(y) for y in v[20]])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("dim", F.lit("clash")).withColumn("label", F.when(F.coalesce("vec_id", F.lit(0)) != 11, F.col("vec_id") % 3).cast("int")).write.parquet(f"{path}/embeddings.parquet")
    items = [(1, " ".join(texts[7].split()[5:30])), (2, None), (3, "!"), (None, texts[8]), (4, texts[8].upper()), (4, "a"), (4, "a"), (5, "no such words here at all in any of the documents")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("doc_id", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "http://a.org/x", "<p>"), (2, None, "<p>"), (3, "http://a.org/x", None), (4, "::", ""), (5, "http://B.org", "é" * 100_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def test_all_are_registered():
    assert sorted(registry.QUERIES) == sorted(OWN)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(told(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(told, r)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_over_odd_and_empty_tables(spark, odd, empty, name):
    none = registry.QUERIES[name](spark, empty)
    assert none.count() == 0 and set(OWN[name]) <= set(none.columns)
    df = registry.QUERIES[name](spark, odd)
    rows = df.collect()
    assert set(OWN[name]) <= set(df.columns)
    n = spark.read.parquet(f"{odd}/documents.parquet").count()
    if name in ("op1_toxicity", "op2_quality", "op3_language_id"):
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    if name in ("op1_toxicity", "op2_quality"):
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op3_language_id":
        assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 3, None)) for r in rows)
    if name == "op4_best_fit_packing":
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 2048
            ends[r.sequence_id] = r.offset + r.length
        assert sum(r.piece == 0 for r in rows) == n
    if name == "op7_byte_bpe":
        texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in spark.read.parquet(f"{odd}/documents.parquet").collect()}
        assert len(rows) == n and {r.decoded_sha256 for r in rows} == texts
    if name in ("op5_mtree_top_k", "op6_block_nearest"):
        assert {r.query_id for r in rows} == {0, 20, 40} | ({120} if name == "op5_mtree_top_k" else set())
        assert all(sum(r.query_id == q for r in rows) == 20 for q in (0, 20, 40)) and not {60, 80, 100, None} & {r.vec_id for r in rows}
    if name == "op8_warc":
        got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.capture) for r in rows}
        assert got == {1: (3, "response", None, 1), 2: (3, "revisit", 1, 1), 3: (0, "response", None, 2), 4: (0, "revisit", 3, 1), 5: (200_000, "response", None, 1)}
    if name == "op9_pii":
        assert len(rows) == n and not any("ann" in (r.text or "") and "@mail.example.org" in r.text for r in rows) and sum(r.text is None for r in rows) == 2
    if name == "op10_near_dedup":
        classes = {}
        for r in rows:
            classes.setdefault(r.class_id, []).append(r.doc_id)
        assert len(rows) == n and {7, *range(10, 22)} <= set(classes[7]) and 8 in classes[8]
    if name in ("op11_decontamination", "op12_importance", "op13_hard_negatives"):
        import duckdb

        c = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
        found = c.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(tuple(told(r[k]) for k in names) for r in rows) == sorted(tuple(map(told, r)) for r in found.fetchall()) and rows


def brute_packing(rows):
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(v <= 2048 for v in ends.values())


def test_pipeline_stages(spark, odd):
    """Each stage on what the one before kept, against its operator's own scores or classes; then run() against the stages."""
    sf = odd
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.stage(function(spark, before, sf))
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        ids = sorted(str(r.doc_id) for r in docs.collect())
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        if name in ("toxicity", "quality"):
            module = __import__(f"clipwright.llm.{name}", fromlist=["x"])
            model = getattr(module, f"{name}_model")(before, labels)
            scored = getattr(module, f"score_{name}")(before, model, score_col="_s").collect()
            assert ids == sorted(str(r.doc_id) for r in scored if (r["_s"] < 0.5) == (name == "toxicity"))
        elif name == "near_dedup":
            from clipwright.llm import near_dedup

            classes = {r.class_id for r in near_dedup.near_duplicates(before).collect()}
            # An id with two texts can stand for two classes.
            assert set(ids) == {str(x) for x in classes} and len(ids) - len(set(ids)) == sum(i in ("7", "None") for i in ids) - sum(i in ("7", "None") for i in set(ids))
        else:
            assert docs.count() == before.count() and docs.where("text LIKE '%ann_@mail.example.org%'").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    brute_packing(last)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows)
    brute_packing(whole)
    assert key(whole) == key(last)


def test_pipeline_over_the_given_and_empty_tables(spark, empty):
    rows = corpus_pipeline.run(spark, SF).collect()
    brute_packing(rows)
    ids = [r.doc_id for r in rows if r.piece == 0]
    assert len(ids) == len(set(ids)) > 100 and corpus_pipeline.run(spark, empty).count() == 0


def test_staged_tables_can_be_cleared(spark):
    df = common.stage(spark.range(3))
    assert df.count() == 3
    path = df.inputFiles()[0].removeprefix("file:").replace("///", "/")
    common.clear_staged(spark)
    assert not os.path.exists(path)
