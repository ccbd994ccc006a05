"""Replies, panels, rounds."""

from pyspark.sql import functions as F

from clipwright.config import RuleBook, Settings
from clipwright.operators import describe, inference, tasks
from clipwright.operators import judging as op

SETTINGS, RULES = Settings(), RuleBook()
SCORE = "task_id string, style string, judge_order int, accuracy double, style_match double, issue string, meta_leak boolean, skipped boolean, skip_reason string"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "raw string").select(column.alias("x")).first().x


def test_unit_score(spark):
    values = ["0.8", "true", "False", "1.2", "-0.1", "nan", "high", None, " 0.12345 "]
    got = [one(spark, op.unit_score(F.col("raw")), v) for v in values]
    assert got == [0.8, 1.0, 0.0, None, None, None, None, None, 0.123]


def test_style_reply(spark):
    replies = ['{"accuracy": 0.9, "style_match": 0.8}', '{"accuracy": 0.9, "style_match": null, "style_fit": 0.8}', '```json\n{"accuracy": 0.9, "style_fit": 0.8, "meta_leak": "yes", "issue": "x"}\n```', '{"accuracy": 0.9, "style_match": 0.8, "issue": "cut', "{}", "", '{"accuracy": 4, "style_match": 5}']
    rows = op.parse_style_reply(spark.createDataFrame(list(enumerate(replies)), "n int, raw string")).orderBy("n").collect()
    assert [(r.accuracy, r.style_match) for r in rows] == [(0.9, 0.8), (None, None), (0.2, 0.2), (0.9, 0.8), (None, None), (None, None), (None, None)]
    assert rows[2].issue == "meta-leak; x" and rows[5].error == "EmptyResponse" and rows[6].error.endswith("[0, 1]")


def test_batch_reply(spark):
    raw = '{"captions": {"formal": {"accuracy": 1, "style_match": 0.5}, "sarcastic": {"accuracy": 7, "style_match": 0.5}}, "cross_style_distinctness": 0.4}'
    got = {r.style: (r.accuracy, r.skip_reason) for r in op.parse_batch_reply(spark.createDataFrame([(raw,)], "raw string")).collect()}
    assert got["formal"] == (1.0, "") and got["sarcastic"] == (0.0, "judge-invalid-scores") and got["humorous_tech"] == (0.0, "judge-missing-style")


def test_vision_and_describe_replies(spark):
    v = one(spark, op.parse_vision(F.col("raw"), SETTINGS), '{"accuracy": 0.9, "conf": 0.4}')
    assert (v.accuracy, v.confidence, v.usable) == (0.9, 0.4, False)
    assert one(spark, op.parse_vision(F.col("raw"), SETTINGS), '{"accuracy": 0.9, "iss').confidence == 1.0
    assert one(spark, op.parse_describe_judge(F.col("raw")), '{"faithfulness": 0.9, "coverage": 0.8}').proxy == 0.85
    assert one(spark, op.parse_distinctness(F.col("raw")), "nothing").error.startswith("InvalidJSON")


def test_panel(spark):
    s = [("a", "formal", 0, 0.8, 0.8, "x", False, False, ""), ("a", "formal", 1, 0.6, 0.4, "x", False, False, ""), ("a", "sarcastic", 0, 0.0, 0.0, "", False, True, "empty")]
    got = {r.style: r for r in op.panel(spark.createDataFrame(s, SCORE)).collect()}
    assert (got["formal"].accuracy, got["formal"].style_match, got["formal"].issue) == (0.7, 0.6, "x")
    assert got["sarcastic"].skip_reason == "empty" and got["humorous_tech"].skip_reason == "judge-missing-style" and len(got) == 4
    alone = op.panel(spark.createDataFrame(s[:1], SCORE)).where("style = 'formal'").first()
    assert (alone.accuracy, alone.style_match) == (0.8, 0.8)


def test_vision_panel(spark):
    fields = "task_id string, style string, judge_order int, accuracy double, confidence double, issue string, parse_error string"
    m = [("a", "formal", 0, 0.9, 0.85, "", ""), ("a", "formal", 1, 0.8, 0.9, "", ""), ("b", "formal", 0, 1.0, 0.9, "", ""), ("b", "formal", 1, 0.0, 0.9, "", ""), ("c", "formal", 0, 0.9, 0.9, "", "Bad"), ("c", "formal", 1, 0.9, 0.9, "", "")]
    got = {r.task_id: r for r in op.vision_panel(spark.createDataFrame(m, fields), SETTINGS).collect()}
    assert (got["a"].accuracy, got["a"].disagreement, got["a"].usable) == (0.85, 0.1, True)
    assert got["b"].disagreement == 1.0 and not got["b"].usable and got["c"].parse_error == "PartialPanel:Bad" and not got["c"].usable


def test_keep_best_and_attempts(spark):
    fields = "task_id string, style string, round int, accuracy double, style_match double, meta_leak boolean, skipped boolean"
    rounds = [("a", "s", 0, 0.5, 0.5, False, False), ("a", "s", 1, 0.7, 0.7, False, False), ("a", "s", 2, 0.6, 0.6, False, False), ("b", "s", 0, 0.9, 0.9, False, False), ("b", "s", 1, 1.0, 1.0, False, False), ("c", "s", 0, 0.9, 0.1, False, False), ("c", "s", 1, 0.0, 0.0, False, True)]
    got = {r.task_id: r.round for r in op.keep_best(spark.createDataFrame(rounds, fields), SETTINGS).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}
    tried = [("a", "p", 1, "InvalidJSON", False), ("a", "p", 2, "", True), ("b", "p", 1, "auth", False), ("b", "p", 2, "", True), ("c", "p", 1, "Truncated", True)]
    got = {r.task_id: (r.attempt, r.ok) for r in op.resolve_attempts(spark.createDataFrame(tried, "task_id string, role string, attempt int, error string, parses boolean")).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (1, True)}


def test_results_do_not_depend_on_partitions(spark):
    s = spark.createDataFrame([(str(k % 9), "formal", k, k % 11 / 10, k % 7 / 10, f"i{k % 3}", k % 13 == 0, k % 5 == 0, "empty") for k in range(200)], SCORE)
    want = sorted(map(tuple, op.panel(s).collect()))
    assert all(sorted(map(tuple, op.panel(s.repartition(n)).collect())) == want for n in (1, 7, 64))


def test_descriptions(spark):
    good = '{"subjects": [{"name": "boat", "colors": ["white", ""]}, {"name": ""}], "setting": "a quiet bay", "actions_early": "it drifts past grey rocks", "actions_late": "it drifts past grey rocks", "ocr": ["AB"]}'
    p = one(spark, describe.parse_description(F.col("raw")), f"Sure: {good}")
    assert p.ok and [s.name for s in p.d.subjects] == ["boat"] and p.d.on_screen_text == ["AB"]
    assert one(spark, describe.description_quality(describe.parse_description(F.col("raw"))["d"], F.lit(10.0), SETTINGS), good) == "StaticActions"
    for bad in ("", "no", "{", '{"setting": null, "actions_early": "a", "actions_late": "b", "subjects": []}', '{"setting": "x", "actions_early": "a", "actions_late": "b", "subjects": "boat"}'):
        assert not one(spark, describe.parse_description(F.col("raw")), bad).ok
    fallback = one(spark, describe.parse_description(F.col("raw")), '{"subjects": [], "setting": "a forest path", "actions_early": "a", "actions_late": "b"}')
    assert fallback.d.subjects[0].name == "a forest path scene"
    text = one(spark, describe.format_description(describe.parse_description(F.col("raw"))["d"]), good)
    assert text.startswith("Primary subject: boat (colors: white)\nSetting: a quiet bay\n")


def ints(values):
    return F.array(*map(F.lit, values)).cast("array<int>")


def test_frame_plans(spark):
    plan = lambda c, n: one(spark, tasks.uniform_plan(F.lit(c), F.lit(n)), "")
    assert (plan(100, 1), plan(0, 1), plan(0, 8), plan(10, 4), plan(3, 8)) == ([0], [0], [], [0, 3, 6, 9], [0, 1, 2])
    times = lambda d, n: one(spark, tasks.time_plan(F.lit(d), F.lit(n)), "")
    assert (times(12.5, 1), times(0.0, 8), times(None, 8), times(30.0, 4), len(times(0.05, 8))) == ([0.0], [], [], [0.0, 10000.0, 20000.0, 30000.0], 8)
    merge = lambda a, b, n: one(spark, tasks.merge_frames(ints(a), ints(b), F.lit(n)), "")
    assert merge([0, 5, 9], [0, 3, 9], 8) == [0, 3, 5, 9] and merge(range(10), [], 4) == [0, 1, 8, 9] and merge(range(10), [], 3) == [0, 5, 9]
    assert [merge(range(10), [], n) for n in (0, 1, 2)] == [[], [0], [0, 9]]
    assert merge([0, 10, 20, 30, 40], [0, 40], 4) == [0, 10, 30, 40]
    cuts = spark.createDataFrame([("a", 0, 1.0, 11), ("a", 5, 0.1, 11), ("b", 0, 1.0, 11), ("b", 4, 0.5, 11), ("c", 0, 1.0, 0), ("d", 0, 1.0, 6), ("d", 5, 0.9, 6)], "task_id string, sample_idx int, score double, frame_count int")
    assert {r.task_id: r.frames for r in tasks.scene_frames(cuts, 0.22).collect()} == {"a": [0, 4, 10], "b": [0, 1, 6, 10], "c": [], "d": [0, 2, 5]}
    which = lambda mode, c, n, scene, d: one(spark, tasks.frame_plan(F.lit(mode), F.lit(c), F.lit(n), ints(scene) if scene is not None else F.lit(None).cast("array<int>"), F.lit(d)), "")
    assert which("scene", 11, 4, [0, 4, 10], 9.0)["frames"] == [0, 3, 4, 10] or which("scene", 11, 4, [0, 4, 10], 9.0)["kind"] == "scene"
    assert (which("scene", 11, 4, None, 9.0)["kind"], which("scene", 0, 4, None, 9.0)["kind"], which("uniform", 0, 3, None, 0.0)) == ("uniform", "time", ("first", [0, 1, 2], None))


def test_frame_budget_and_tasks(spark):
    assert [one(spark, tasks.frame_budget(F.lit(x), SETTINGS), "") for x in (0.0, -1.0, None, 10.0, 30.0, 50.0, 59.9, 60.0, 75.0, 86.0, 900.0)] == [8, 8, 8, 8, 8, 12, 15, 20, 25, 28, 28]
    assert one(spark, tasks.frame_budget(F.lit(50.0), Settings(fixed_frames=5)), "") == 5
    assert [one(spark, tasks.frame_width(F.lit(x), SETTINGS), "") for x in (30.0, 90.0, 0.0)] == [512, 384, 384]
    assert [one(spark, tasks.normalise_styles(F.col("raw")), x) for x in ('["a", "a", 1, null, "b"]', '"a"', None, "[")] == [["a", "b"], [], [], []]
    kinds = ("text/html; x", "video/mp4", "", None, "Application/JSON", "text/xml", "application/xml", "application/javascript", "application/xhtml+xml")
    assert [one(spark, tasks.refused_type(F.col("raw")), x) for x in kinds] == [True, False, False, False, True, True, True, False, False]
    assert [one(spark, tasks.duration_hint(F.col("raw")), x) for x in ("3.5", "-1", "x", None)] == [3.5, 0.0, 0.0, 0.0]
    got = [tuple(one(spark, tasks.provider(F.col("raw")), x)) for x in ("gemma-3", "google-ai/gem", "a/b", "accounts/x/qwen", "kimi", None)]
    assert got == [("direct", "gemma-3", False), ("direct", "gem", False), ("router", "a/b", False), ("default", "accounts/x/qwen", True), ("default", "kimi", True), ("default", "", False)]


def test_messages(spark):
    assert [one(spark, tasks.describe_code(F.col("raw")), x) for x in ("EmptyResponse", "InvalidJSON", "ReadTimeout", "x", None)] == ["empty", "truncated", "timeout", "api", "api"]
    assert [one(spark, tasks.caption_code(F.col("raw")), x) for x in ("TooShort", "MetaLeak", "InvalidJSON", None)] == ["too_short", "meta_leak", "api", "api"]
    assert one(spark, tasks.failure_text("caption", F.lit("too_long"), F.lit("")), "") == "Failed to caption: TooLong"
    assert one(spark, tasks.failure_text("describe", F.lit(None).cast("string"), F.lit(None).cast("string")), "") == "Failed to describe video: Unknown"
    rows = spark.createDataFrame([("Failed to caption: x", "haiku"), (" Fine. ", "formal"), (None, "formal"), ("Invalid task input.", "formal")], "text string, style string")
    known = spark.createDataFrame([("caption", "formal", "C"), ("process", "formal", "P")], "kind string, style string, message string")
    shipped = {(r.text, r.style): r.message for r in tasks.public_messages(rows, known).collect()}
    assert shipped == {("Failed to caption: x", "haiku"): "C", (" Fine. ", "formal"): "Fine.", (None, "formal"): "C", ("Invalid task input.", "formal"): "P"}
    assert [r.message for r in tasks.public_messages(rows, known, friendly=False).collect()] == ["Failed to caption: x", " Fine. ", "", "Invalid task input."]
    s = spark.createDataFrame([(0.5, 0.7, "wrong scene", False, ""), (0.5, 0.7, "", False, ""), (0.0, 0.0, "", False, "missing-score"), (0.1, 0.1, "x", True, "")], "accuracy double, style_match double, issue string, meta_leak boolean, skip_reason string")
    told = [r.f for r in s.select(op.feedback(s).alias("f")).collect()]
    assert "wrong scene" in told[0] and "(mean 0.60)" in told[1] and "missing-score" in told[2] and "issue: x" in told[3]


def test_retry_temperature(spark):
    t = lambda *x: one(spark, inference.temperature(*map(F.lit, x)), "")
    assert [t("formal", 0, 1, ""), t("formal", 1, 1, ""), t("formal", 3, 1, ""), t("haiku", 0, 2, "Truncated")] == [0.5, 0.65, 0.65, 0.67]
    assert [t("formal", 0, 2, "MetaLeak"), t("formal", 0, 6, "Truncated"), t("formal", 0, 6, "TooLong")] == [0.25, 0.2, 0.1]
    assert [one(spark, inference.token_limit(F.lit(140), F.lit(n), F.lit(r)), "") for n, r in ((1, "Truncated"), (2, "Truncated"), (2, "TooLong"), (3, "x"), (2, None))] == [140, 360, 180, 200, 200]


def test_vision_leaves_blank_captions(spark):
    s = spark.createDataFrame([("a", "formal", 0.9, 0.9, "", True, False, "A caption."), ("b", "formal", 0.9, 0.9, "", False, False, " "), ("c", "formal", 0.9, 0.9, "x", False, False, "A caption.")], "task_id string, style string, accuracy double, style_match double, issue string, meta_leak boolean, skipped boolean, text string")
    v = spark.createDataFrame([("a", "formal", 0.3, "", True), ("b", "formal", 0.3, "y", True), ("c", "formal", 0.75, "y", True)], "task_id string, style string, accuracy double, issue string, usable boolean")
    got = {r.task_id: (r.accuracy, r.issue, r.meta_leak, r.demoted) for r in op.merge_vision(s, v, SETTINGS).collect()}
    assert got == {"a": (0.3, "vision: vision accuracy below text accuracy", False, True), "b": (0.9, "", False, False), "c": (0.9, "x", False, False)}


def test_keep_best_with_rules(spark):
    good = "A small boat crosses the quiet bay at dawn. Gulls circle above the wooden mast."
    rows = [("a", "formal", 0, 0.95, 0.95, False, False, "A boat at"), ("a", "formal", 1, 0.92, 0.92, False, False, good), ("b", "formal", 0, 0.95, 0.95, False, False, good), ("b", "formal", 1, 0.99, 0.99, False, False, good)]
    df = spark.createDataFrame(rows, "task_id string, style string, round int, accuracy double, style_match double, meta_leak boolean, skipped boolean, text string")
    assert {r.task_id: (r.round, r.fails) for r in op.keep_best(df, SETTINGS, rules=RULES).collect()} == {"a": (1, False), "b": (0, False)}
    assert {r.task_id: r.round for r in op.keep_best(df, SETTINGS).collect()} == {"a": 0, "b": 0}


def test_upsert_is_idempotent(spark):
    cache = spark.createDataFrame([("e1", "old"), ("e9", "keep"), ("e0", "")], "task_id string, text string")
    live = spark.createDataFrame([("e1", "new"), ("e2", "add"), ("e3", "")], "task_id string, text string")
    once = tasks.upsert(cache, live)
    want = {"e1": "new", "e2": "add", "e9": "keep"}
    assert {r.task_id: r.text for r in once.collect()} == want == {r.task_id: r.text for r in tasks.upsert(once.select("task_id", "text"), live).collect()}
