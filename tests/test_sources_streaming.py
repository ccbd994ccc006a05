"""Files, the model hook, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from clipwright.config import RuleBook, Settings
from clipwright.operators.inference import attempt_rounds, call_model, judge_rounds, model_panel
from clipwright.sources import tables
from clipwright.streaming.captions import best_so_far, read_cache, scored_stream, upsert_batch

GOOD = "A small boat crosses the quiet bay at dawn. Gulls circle above the wooden mast."


def test_tasks_descriptions_results(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"task_id": "a", "video_url": "u", "styles": ["formal"], "meta": {"duration_s": 3}}, {"task_id": "b"}]))
    rows = tables.read_tasks(spark, str(tmp_path / "t.json")).orderBy("clip_index").collect()
    assert [(r.clip_index, r.task_id, r.styles_raw) for r in rows] == [(0, "a", '["formal"]'), (1, "b", None)]
    for k, shape in enumerate(({"descriptions": {"a": "x", "b": ""}}, {"a": "x", "b": ""})):
        (tmp_path / f"d{k}.json").write_text(json.dumps(shape))
        assert [tuple(r) for r in tables.read_descriptions(spark, str(tmp_path / f"d{k}.json")).collect()] == [("a", "x")]
    captions = spark.createDataFrame([(0, "a", "formal", "x"), (0, "a", "sarcastic", "y"), (1, "b", "formal", "z")], "clip_index long, task_id string, style string, text string")
    tables.write_results(captions, str(tmp_path / "out"))
    assert {r.task_id: r.captions.asDict() for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a": {"formal": "x", "sarcastic": "y"}, "b": {"formal": "z", "sarcastic": None}}


def test_model_hook(spark):
    def call(rows):
        if any(r["prompt"] == "boom" for r in rows):
            raise TimeoutError
        return [(GOOD if r["prompt"] == "good" else "bad", "stop") for r in rows]

    prompts = spark.createDataFrame([("a", "formal", 0, "good"), ("b", "formal", 0, "worse")], "task_id string, style string, pool_index int, prompt string")
    got = {r.task_id: (r.raw, r.error) for r in call_model(prompts, call, 2).collect()}
    assert got == {"a": (GOOD, None), "b": ("bad", None)}
    boom = spark.createDataFrame([("c", "formal", 0, "boom")], prompts.schema)
    assert call_model(boom, call, 1).first().error == "TimeoutError"
    done = {r.task_id: (r.attempt, r.reason) for r in attempt_rounds(prompts, call, RuleBook(), 2).collect()}
    assert done["a"] == (1, "") and done["b"][0] == 3


def test_judge_rounds(spark):
    def judge(df):
        good = F.col("text") == GOOD
        scores = {"accuracy": F.when(good, 0.9).otherwise(0.2), "style_match": F.lit(0.9), "issue": F.lit(""), "meta_leak": F.lit(False), "skipped": F.lit(False), "skip_reason": F.lit("")}
        return df.withColumns(scores)

    told = []

    def rewrite(df):
        told.extend(r.feedback for r in df.collect())
        return df.withColumn("text", F.when(F.col("task_id") == "b", GOOD).otherwise("Still bad."))

    rows = spark.createDataFrame([("a", "formal", "bad"), ("b", "formal", "bad"), ("c", "formal", GOOD)], "task_id string, style string, text string")
    got = {r.task_id: (r.round, r.text) for r in judge_rounds(rows, judge, rewrite, RuleBook(), Settings()).collect()}
    assert got == {"a": (0, "bad"), "b": (1, GOOD), "c": (0, GOOD)} and len(told) == 3 and "0.20" in told[0]
    assert model_panel([" x ", "y", "x", ""], "p", "q") == ["x", "y"] and model_panel([], "p", "p") == ["p"]


def test_best_so_far(spark, tmp_path):
    schema = "task_id string, style string, text string, score_rank int, pool_index int, ts timestamp"
    rows = [("a", "formal", "x", 50, 0), ("a", "formal", "y", 110, 1), ("a", "formal", "z", 110, 2), ("b", "formal", "w", 10, 0)]
    spark.createDataFrame(rows, schema.rsplit(",", 1)[0]).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = best_so_far(stream).writeStream.outputMode("update").format("memory").queryName("best").start()
    q.processAllAvailable()
    q.stop()
    assert {r.task_id: (r.text, r.updates) for r in spark.table("best").collect()} == {"a": ("y", 3), "b": ("w", 1)}


def test_upsert_batches(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda *x: spark.createDataFrame(list(x), "task_id string, text string, ts long")
    held = lambda: {r.task_id: r.text for r in read_cache(spark, path).collect()}
    assert held() == {}
    run = upsert_batch(path, 4)
    run(rows(("a", "1", 1), ("a", "2", 2), *((f"k{n}", "x", 1) for n in range(20))), 0)
    run(rows(("a", "3", 3)), 1)
    run(rows(("a", "3", 3)), 1)  # the batch runs again
    run(rows(("a", "", 4)), 2)  # an empty text changes nothing
    upsert_batch(path, 4)(rows(("b", "new", 1)), 0)  # a stream that starts anew
    upsert_batch(path, 4)(rows(), 1)
    assert held() == {"a": "3", "b": "new"} | {f"k{n}": "x" for n in range(20)}


def test_streams_score_as_batches_do(spark, tmp_path):
    schema = "task_id string, style string, text string"
    batch = spark.createDataFrame([("a", "formal", GOOD), ("b", "formal", "bad")], schema)
    batch.write.parquet(str(tmp_path / "in"))
    q = scored_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), RuleBook()).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.task_id, r.score_rank, r.score_reason) for r in scored_stream(batch, RuleBook()).collect()}
    assert {(r.task_id, r.score_rank, r.score_reason) for r in spark.table("scored").collect()} == want and len(want) == 2


def test_results_frames_events_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"task_id": "a", "captions": {"formal": "x", "sarcastic": "y"}}, {"task_id": "b", "captions": "none"}]))
    assert sorted(map(tuple, tables.read_results(spark, str(tmp_path / "r.json")).collect())) == [(0, "a", "formal", "x"), (0, "a", "sarcastic", "y")]
    (tmp_path / "f.jpg").write_bytes(b"\xff\xd8x")
    assert tables.read_frames(spark, str(tmp_path)).first().data_url == "data:image/jpeg;base64,/9h4"
    stages = spark.createDataFrame([("a", 1.23456, None, 2.0, "t")], "task_id string, download_s double, describe_s double, styles_s double, stage string")
    event = json.loads(tables.event_rows(stages, F.lit("2024-01-02 03:04:05").cast("timestamp")).first().value)
    assert (event["ts"], event["download_s"], event["describe_s"], event["total_s"]) == ("2024-01-02T03:04:05.000Z", 1.235, 0.0, 3.235)
    spark.createDataFrame([(json.dumps(event),)], "value string").write.text(str(tmp_path / "events"))
    read = tables.read_events(spark, str(tmp_path / "events")).first()
    assert (read.task_id, read.total_s, read.describe_error) == ("a", 3.235, None)
    tables.write_descriptions(spark.createDataFrame([("a", "x"), ("b", "")], "task_id string, text string"), str(tmp_path / "d"), "live_pipeline", True)
    assert [r.asDict(True) for r in spark.read.json(str(tmp_path / "d")).collect()] == [{"descriptions": {"a": "x"}, "meta": {"source": "live_pipeline", "updated_from_live": True}}]
    assert [tuple(r) for r in tables.read_descriptions(spark, str(tmp_path / "d")).collect()] == [("a", "x")]
    scores = spark.createDataFrame([("a", "formal", "j1", 0.95, 0.95, "", False, False, ""), ("a", "formal", "j2", 0.5, 0.5, "x", False, False, "")], "task_id string, style string, judge_model string, accuracy double, style_match double, issue string, meta_leak boolean, skipped boolean, skip_reason string")
    clips = spark.createDataFrame([("a", 0.4, "n", "")], "task_id string, distinctness double, note string, parse_error string")
    tables.write_report(scores, scores, clips, str(tmp_path / "report"), Settings(), "panel")
    head = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert (head.passes, head.total, head.mean_score, head.panel_models, [j.passes for j in head.per_judge]) == (1, 2, 0.725, ["j1", "j2"], [1, 0])
    assert spark.read.json(str(tmp_path / "report" / "clips")).first().cross_style_distinctness == 0.4


def test_rules_from_a_table(spark):
    rules = tables.read_rules(spark.createDataFrame([("entities", "Llama"), ("entities", "alpaca"), ("leak_markers", "Given The Facts")], "list string, phrase string"))
    assert rules.entities == ("alpaca", "llama") and rules.leak_markers == ("given the facts",) and rules.cut_stems == RuleBook().cut_stems
    with pytest.raises(ValueError):
        tables.read_rules(spark.createDataFrame([("no_such", "x")], "list string, phrase string"))


def test_an_empty_text_hides_no_older_one(spark, tmp_path):
    batch = spark.createDataFrame([("a", "good", 1), ("a", "", 2), ("a", None, 3), ("b", " ", 1)], "task_id string, text string, ts long")
    upsert_batch(str(tmp_path / "cache"), 4)(batch, 0)
    assert {r.task_id: r.text for r in read_cache(spark, str(tmp_path / "cache")).collect()} == {"a": "good"}
