"""Queries on tasks, frames, descriptions and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STYLES, Settings
from ..functions.text import with_once
from ..operators import describe, inference, tasks
from ..sources.shared import shared_path
from ..sources.tables import nested_results, read_descriptions, write_descriptions
from .derived import CAPTIONS, captions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PLAIN = Settings()


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Pages as tasks: every ninth without id, every seventh without URL, styles in several shapes."""
    n = F.col("page_id")
    raw = F.when(n % 5 == 0, '["formal", "formal", 3, "sarcastic"]').when(n % 5 == 1, '"formal"').when(n % 5 == 2, "[]").when(n % 5 == 3, '["humorous_tech", null, "haiku"]').otherwise('["sarcastic"]')
    return table(spark, d, "pages").select(
        n.alias("clip_index"), F.when(n % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("task_id"), F.when(n % 7 == 0, "").otherwise(F.col("url")).alias("video_url"), tasks.normalise_styles(raw).alias("styles")
    )


TASKS = """SELECT page_id AS clip_index, CASE WHEN page_id % 9 = 0 THEN NULL ELSE 't' || page_id::VARCHAR END AS task_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE url END AS video_url,
  CASE page_id % 5 WHEN 0 THEN ['formal', 'sarcastic'] WHEN 3 THEN ['humorous_tech', 'haiku'] WHEN 4 THEN ['sarcastic'] ELSE [] END AS styles FROM pages"""
VALID = "(coalesce(task_id, '') <> '' AND coalesce(video_url, '') <> '' AND len(styles) > 0)"


@query("tsk_1_styles", f"SELECT clip_index, array_to_string(styles, ',') AS styles FROM ({TASKS})")
def tsk_1(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("clip_index", F.array_join("styles", ",").alias("styles"))


@query("tsk_2_invalid_tasks", f"SELECT clip_index, coalesce(nullif(task_id, ''), 'unknown') AS task_id, unnest(CASE WHEN len(styles) > 0 THEN styles ELSE ['formal'] END) AS style, 'process' AS failure FROM ({TASKS}) WHERE NOT {VALID}")
def tsk_2(spark: SparkSession, d: str) -> DataFrame:
    return tasks.invalid_captions(_tasks(spark, d))


@query("tsk_3_style_status", f"SELECT clip_index, style, CASE WHEN style IN {STYLES!r} THEN 'ready' ELSE 'unsupported-style' END AS status FROM (SELECT clip_index, unnest(styles) AS style FROM ({TASKS}))")
def tsk_3(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("clip_index", F.explode("styles").alias("style")).withColumn("status", tasks.style_status(F.col("style")))


@query("tsk_4_dry_run", f"SELECT clip_index, style, '[DRY_RUN] ' || task_id || ' - ' || style AS text FROM (SELECT clip_index, task_id, unnest(styles) AS style FROM ({TASKS}) WHERE {VALID})")
def tsk_4(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d).where(tasks.valid_task()).select("clip_index", "task_id", F.explode("styles").alias("style"))
    return t.select("clip_index", "style", tasks.dry_run_text(F.col("task_id"), F.col("style")).alias("text"))


@query("tsk_5_duration_hint", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN greatest(round(value, 2), 0) ELSE 0 END AS duration FROM events")
def tsk_5(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.round("value", 2).cast("string")).when(n == 1, "long").when(n == 2, "-3")
    return table(spark, d, "events").select("event_id", tasks.duration_hint(raw).alias("duration"))


@query("tsk_6_refused_type", "SELECT page_id, page_id % 4 IN (0, 2) AS refused FROM pages")
def tsk_6(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 4
    kind = F.when(n == 0, "Text/HTML; charset=utf-8").when(n == 1, "video/mp4").when(n == 2, " application/json ").otherwise("")
    return table(spark, d, "pages").select("page_id", tasks.refused_type(kind).alias("refused"))


@query(
    "frm_1_frame_budget",
    """SELECT p_partkey, (CASE WHEN d >= 60 THEN greatest(12, least(28, round_even(d / 3.0, 0))) WHEN d <= 0 THEN 8 ELSE greatest(8, least(24, round_even(d / 4.0, 0))) END)::INT AS frames
FROM (SELECT p_partkey, (p_size - 2) * 2.5 AS d FROM part)""",
)
def frm_1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tasks.frame_budget((F.col("p_size") - 2) * 2.5, PLAIN).cast("int").alias("frames"))


@query("frm_2_frame_width", f"SELECT p_partkey, (CASE WHEN p_size * 3 > 0 AND p_size * 3 < {PLAIN.short_clip_s} THEN {PLAIN.width_short} ELSE {PLAIN.width_long} END)::INT AS width FROM part")
def frm_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tasks.frame_width(F.col("p_size") * 3.0, PLAIN).cast("int").alias("width"))


@query(
    "frm_3_uniform_plan",
    """SELECT o_orderkey, CASE WHEN n <= 1 THEN '0' WHEN c <= 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(range(n), lambda i: round_even((i * (c - 1))::DOUBLE / (n - 1), 0)::INT))), ',') END AS frames
FROM (SELECT o_orderkey, o_orderkey % 200 AS c, 1 + o_orderkey % 9 AS n FROM orders)""",
)
def frm_3(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tasks.uniform_plan(k % 200, 1 + k % 9), ",").alias("frames"))


#: FRM-7 in SQL, for a sorted list ``e`` without repeats and a budget ``n``: both ends, and evenly placed ones of those between.
MERGED = """CASE WHEN n <= 0 THEN [] WHEN len(e) <= n THEN e WHEN n = 1 THEN [e[1]] WHEN n = 2 THEN [e[1], e[len(e)]] ELSE list_sort(list_distinct(list_concat([e[1], e[len(e)]],
  list_transform(range(n - 2), lambda i: e[2 + (CASE WHEN n > 3 THEN round_even((i * (len(e) - 3))::DOUBLE / (n - 3), 0) ELSE (len(e) - 2) // 2 END)::INT])))) END"""


@query(
    "frm_7_merge_frames",
    f"""SELECT o_orderkey, array_to_string({MERGED}, ',') AS frames FROM (
  SELECT o_orderkey, o_orderkey % 8 AS n, list_sort(list_distinct(list_concat([0, o_orderkey % 7, o_orderkey % 31, o_orderkey % 83], [0, 5, o_orderkey % 50, o_orderkey % 64, 90]))) AS e FROM orders)""",
)
def frm_7(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda x: F.lit(x).cast("long")
    merged = tasks.merge_frames(F.array(n(0), k % 7, k % 31, k % 83), F.array(n(0), n(5), k % 50, k % 64, n(90)), (k % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(merged, ",").alias("frames"))


@query(
    "frm_4_time_plan",
    """SELECT o_orderkey, CASE WHEN n <= 1 THEN '0.0' WHEN d <= 0 THEN '' ELSE array_to_string(list_transform(list_sort(list_distinct(list_transform(range(n), lambda i: round_even(i * (d * 1000.0) / (n - 1), 1)))), lambda x: printf('%.1f', x)), ',') END AS times
FROM (SELECT o_orderkey, (o_orderkey % 41 / 8.0)::DOUBLE AS d, o_orderkey % 9 AS n FROM orders)""",
)
def frm_4(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    times = tasks.time_plan(k % 41 / 8.0, (k % 9).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(times, lambda x: F.format_string("%.1f", x)), ",").alias("times"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as histograms of 32 bins; sixteen vectors in a row are a clip, so that no clip grows with the data."""
    v = F.col("vec_id")
    hist = F.transform(F.slice("embedding", 1, 32), lambda x: F.abs(x))
    return table(spark, d, "embeddings").select(F.floor(v / 16).alias("task_id"), (v % 16).alias("sample_idx"), hist.alias("hist"))


SCENES = """
SELECT task_id, sample_idx, CASE WHEN p IS NULL THEN 1 ELSE round(sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 33), lambda i: sqrt(h[i] * p[i]))) / sqrt(list_sum(h) * list_sum(p)))), 6) END AS score FROM (
  SELECT task_id, sample_idx, h, lag(h) OVER (PARTITION BY task_id ORDER BY sample_idx) AS p FROM (
    SELECT vec_id // 16 AS task_id, vec_id % 16 AS sample_idx, list_transform(embedding[1:32], lambda x: abs(x)::DOUBLE) AS h FROM embeddings))"""


@query("frm_5_scene_scores", SCENES)
def frm_5(spark: SparkSession, d: str) -> DataFrame:
    return tasks.scene_scores(_samples(spark, d))


#: FRM-6 in SQL: the cuts are the first sample, those at the threshold, and the last frame; every segment gives its middle.
CUT = f"""WITH s AS ({SCENES}), c AS (SELECT task_id, list(sample_idx) FILTER (WHERE score >= 0.4 OR first) AS cuts FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_idx) = 1 AS first FROM s) GROUP BY 1),
b AS (SELECT task_id, list_sort(list_distinct(list_concat(cuts, [15, 16]))) AS b FROM c),
scene AS (SELECT task_id, list_sort(list_distinct(list_concat([0, 15], list_transform(range(1, len(b)), lambda i: (b[i] + b[i + 1] - 1) // 2)))) AS frames FROM b)"""


@query("frm_6_scene_frames", f"{CUT} SELECT task_id, array_to_string(frames, ',') AS frames FROM scene")
def frm_6(spark: SparkSession, d: str) -> DataFrame:
    scored = tasks.scene_scores(_samples(spark, d)).withColumn("frame_count", F.lit(16))
    return tasks.scene_frames(scored, 0.4).select("task_id", F.array_join("frames", ",").alias("frames"))


UNIFORM16 = "list_sort(list_distinct(list_transform(range(n), lambda i: round_even((i * 15)::DOUBLE / (n - 1), 0)::BIGINT)))"


@query(
    "frm_8_frame_plan",
    f"""{CUT}, k AS (SELECT task_id, frames, task_id % 7 AS n, CASE WHEN task_id % 3 = 0 THEN 0 ELSE 16 END AS c, task_id % 2 = 0 AS by_scene, (task_id % 5)::DOUBLE AS d FROM scene),
m AS (SELECT *, CASE WHEN by_scene AND c > 0 AND n > 1 THEN 'scene' WHEN n <= 1 OR c > 0 THEN 'uniform' WHEN d > 0 THEN 'time' ELSE 'first' END AS kind, CASE WHEN n > 1 THEN list_sort(list_distinct(list_concat(frames, {UNIFORM16}))) ELSE [0] END AS e FROM k)
SELECT task_id, kind, array_to_string(CASE kind WHEN 'scene' THEN {MERGED} WHEN 'uniform' THEN CASE WHEN n <= 1 THEN [0] ELSE {UNIFORM16} END WHEN 'first' THEN range(n) ELSE [] END, ',') AS frames,
  CASE WHEN kind = 'time' THEN array_to_string(list_transform(list_sort(list_distinct(list_transform(range(n), lambda i: round_even(i * (d * 1000.0) / (n - 1), 1)))), lambda x: printf('%.1f', x)), ',') ELSE '' END AS times FROM m""",
)
def frm_8(spark: SparkSession, d: str) -> DataFrame:
    """Every third clip has no known number of frames, every fifth no duration."""
    scored = tasks.scene_scores(_samples(spark, d)).withColumn("frame_count", F.lit(16))
    k = F.col("task_id")
    mode, count = F.when(k % 2 == 0, "scene").otherwise("uniform"), F.when(k % 3 == 0, 0).otherwise(16)
    plans = tasks.scene_frames(scored, 0.4).select("task_id", tasks.frame_plan(mode, count, (k % 7).cast("int"), F.col("frames"), (k % 5).cast("double")).alias("p"))
    told = F.coalesce(F.array_join(F.transform("p.times", lambda x: F.format_string("%.1f", x)), ","), F.lit(""))
    return plans.select("task_id", "p.kind", F.array_join("p.frames", ",").alias("frames"), told.alias("times"))


@query(
    "frm_9_even_subset",
    """WITH k AS (SELECT vec_id // 16 AS task_id, vec_id % 16 AS sample_idx, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings)
SELECT task_id, sample_idx FROM k WHERE n <= 6 OR list_contains(list_transform(range(6), lambda j: round_even((j * (n - 1))::DOUBLE / 5, 0)::BIGINT), i)""",
)
def frm_9(spark: SparkSession, d: str) -> DataFrame:
    return tasks.even_subset(_samples(spark, d).select("task_id", "sample_idx"), 6)


MODELS = ["gemma-2", "google-ai/Pro-1", "Google-AI/flash", "vendor/some-model", "accounts/team/models/qwen-7", "plain-kimi", "", " gemma-9 "]


@query(
    "tsk_7_provider",
    """SELECT page_id, CASE k WHEN 0 THEN 'direct' WHEN 1 THEN 'direct' WHEN 2 THEN 'direct' WHEN 3 THEN 'router' WHEN 7 THEN 'direct' ELSE 'default' END AS provider,
  ['gemma-2', 'Pro-1', 'flash', 'vendor/some-model', 'accounts/team/models/qwen-7', 'plain-kimi', '', 'gemma-9'][k + 1] AS bare_id, k IN (4, 5) AS no_thinking FROM (SELECT page_id, (page_id % 8)::INT AS k FROM pages)""",
)
def tsk_7(spark: SparkSession, d: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", tasks.provider(model).alias("p")).select("page_id", "p.*")


SHIPPED = ["Failed to describe video: Timeout", "Failed to caption: MetaLeak", "Failed to process video: x", "Invalid task input.", "failed to do it", " A fine day at the lake. ", ""]


@query(
    "msg_1_public_text",
    """WITH e AS (SELECT event_id, (event_id % 7)::INT AS k, CASE event_id % 3 WHEN 0 THEN 'formal' WHEN 1 THEN 'sarcastic' ELSE 'haiku' END AS style FROM events)
SELECT event_id, CASE WHEN k = 5 THEN 'A fine day at the lake.' WHEN k IN (2, 3) THEN 'This clip has no caption.' ELSE CASE WHEN k = 0 THEN 'describe' ELSE 'caption' END || ' / ' || CASE style WHEN 'haiku' THEN 'formal' ELSE style END END AS message FROM e""",
)
def msg_1(spark: SparkSession, d: str) -> DataFrame:
    """Messages for two kinds and all styles; the third kind has none."""
    n = F.col("event_id")
    text = F.element_at(F.array(*map(F.lit, SHIPPED)), (n % 7 + 1).cast("int"))
    style = F.when(n % 3 == 0, "formal").when(n % 3 == 1, "sarcastic").otherwise("haiku")
    known = spark.createDataFrame([(k, s, f"{k} / {s}") for k in ("describe", "caption") for s in STYLES], "kind string, style string, message string")
    return tasks.public_messages(table(spark, d, "events").select("event_id", text.alias("text"), style.alias("style")), known).select("event_id", "message")


REASONS = ["EmptyResponse", "truncated", "InvalidJSON", "ReadTimeoutError", "MetaLeak", "TooLong", "HTTP 500", "", "TooShort", "Truncated"]


@query(
    "msg_2_failure_codes",
    """SELECT event_id, d AS describe_code, c AS caption_code, 'Failed to describe video: ' || CASE d WHEN 'empty' THEN 'EmptyResponse' WHEN 'truncated' THEN 'Truncated' WHEN 'timeout' THEN 'Timeout' ELSE 'APIError' END AS described,
  'Failed to caption: ' || CASE WHEN event_id % 4 = 0 THEN 'detail' ELSE CASE c WHEN 'empty' THEN 'EmptyResponse' WHEN 'truncated' THEN 'Truncated' WHEN 'meta_leak' THEN 'MetaLeak' WHEN 'too_long' THEN 'TooLong' WHEN 'too_short' THEN 'TooShort' ELSE 'APIError' END END AS captioned,
  CASE event_id % 3 WHEN 0 THEN 'Invalid task input.' WHEN 1 THEN 'Unsupported style requested.' ELSE 'Failed to process video: ' || CASE WHEN event_id % 4 = 0 THEN 'detail' ELSE 'processing' END END AS processed
FROM (SELECT event_id, ['empty', 'truncated', 'truncated', 'timeout', 'api', 'api', 'api', 'api', 'api', 'truncated'][(event_id % 10)::INT + 1] AS d, ['empty', 'api', 'api', 'api', 'meta_leak', 'too_long', 'api', 'api', 'too_short', 'truncated'][(event_id % 10)::INT + 1] AS c FROM events)""",
)
def msg_2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (n % 10 + 1).cast("int"))
    detail, of_task = F.when(n % 4 == 0, "detail"), F.when(n % 3 == 0, "invalid_task").when(n % 3 == 1, "unsupported_style").otherwise("processing")
    rows = table(spark, d, "events").select(n, tasks.describe_code(reason).alias("describe_code"), tasks.caption_code(reason).alias("caption_code"), detail.alias("t"), of_task.alias("p"))
    told = [tasks.failure_text("describe", F.col("describe_code"), F.lit(None).cast("string")).alias("described"), tasks.failure_text("caption", F.col("caption_code"), F.col("t")).alias("captioned"), tasks.failure_text("process", F.col("p"), F.col("t")).alias("processed")]
    return rows.select("event_id", "describe_code", "caption_code", *told)


@query(
    "msg_4_prompt",
    """SELECT event_id, 'Hint.' || CASE WHEN event_id % 5 > 0 THEN '|Facts ' || event_type ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '|Nudge.' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '|Feedback.' ELSE '' END AS prompt FROM events""",
)
def msg_4(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    made = tasks.prompt(F.lit("Hint."), F.when(n % 5 > 0, F.concat(F.lit("Facts "), F.col("event_type"))), F.when(n % 2 == 0, "Nudge.").otherwise(" "), F.when(n % 3 == 0, " Feedback. "))
    return table(spark, d, "events").select("event_id", F.replace(made, F.lit("\n\n"), F.lit("|")).alias("prompt"))


@query(
    "rnk_2_temperature",
    """WITH e AS (SELECT event_id, (event_id % 3)::INT AS pool, (1 + event_id % 4)::INT AS attempt, ['', 'MetaLeak', 'SceneMismatch', 'TooLong', 'Truncated', 'TooShort'][(event_id % 6)::INT + 1] AS reason,
  CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 WHEN 3 THEN 0.64 ELSE 0.75 END::DOUBLE AS base FROM events),
b AS (SELECT *, CASE WHEN pool > 0 THEN least(base + 0.15, 0.97) ELSE base END - 0.08 * (attempt - 1) AS now FROM e)
SELECT event_id, round(CASE WHEN attempt > 1 AND reason IN ('MetaLeak', 'SceneMismatch', 'TooLong') THEN least(now, 0.25) ELSE least(greatest(now, 0.2), 0.97) END, 6) AS temperature,
  (140 + CASE WHEN attempt = 1 THEN 0 WHEN reason = 'Truncated' THEN 220 WHEN reason = 'TooLong' THEN 40 ELSE 60 END)::INT AS max_tokens FROM b""",
)
def rnk_2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    style = F.element_at(F.array(*map(F.lit, [*STYLES, "haiku"])), (n % 5 + 1).cast("int"))
    reason = F.element_at(F.array(*map(F.lit, ["", "MetaLeak", "SceneMismatch", "TooLong", "Truncated", "TooShort"])), (n % 6 + 1).cast("int"))
    attempt = (n % 4 + 1).cast("int")
    return table(spark, d, "events").select("event_id", inference.temperature(style, n % 3, attempt, reason).alias("temperature"), inference.token_limit(F.lit(140), attempt, reason).alias("max_tokens"))


SETTINGS_OF = ["Central Park at noon", "a rocky coastline", "Open sea under clouds", "the season opens at the office", "green field, far off", "outdoor market, busy stalls", "Indoor climbing gym with ropes and mats", "a harbour scene at dusk", "", "outdoor indoor mix"]


@query(
    "dsc_3_fallback_subject",
    "SELECT event_id, ['park scene', 'coastal scene', 'ocean scene', 'ocean scene', 'meadow scene', 'market scene', 'climbing gym with ropes scene', 'a harbour scene at', 'scene', 'mix scene'][(event_id % 10)::INT + 1] AS subject FROM events",
)
def dsc_3(spark: SparkSession, d: str) -> DataFrame:
    """A part of a word counts, as in `season`."""
    setting = F.element_at(F.array(*map(F.lit, SETTINGS_OF)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", describe.fallback_subject(setting)["name"].alias("subject"))


@query("jon_10_fallback_description", """SELECT c_custkey AS task_id, CASE WHEN c_custkey % 3 > 0 THEN 'first' WHEN c_custkey % 2 = 0 THEN 'second' END AS text, CASE WHEN c_custkey % 3 > 0 OR c_custkey % 2 = 0 THEN '' ELSE 'timeout' END AS error FROM customer""")
def jon_10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("task_id"))
    first = rows.select("task_id", F.when(F.col("task_id") % 3 > 0, "first").alias("text"), F.when(F.col("task_id") % 3 > 0, "").otherwise("timeout").alias("error"))
    second = rows.where("task_id % 5 <> 9").select("task_id", F.when(F.col("task_id") % 2 == 0, "second").alias("text"), F.when(F.col("task_id") % 2 == 0, "").otherwise("empty").alias("error"))
    return tasks.fallback_description(first, second)


CACHE = "SELECT c_custkey AS task_id, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END AS text FROM customer"
LIVE = "SELECT o_custkey AS task_id, 'live ' || max(o_orderkey)::VARCHAR AS text FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_name")).alias("text"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("task_id"))
    return o.agg(F.concat(F.lit("live "), F.max("o_orderkey").cast("string")).alias("text"))


@query("jon_2_still_to_describe", f"SELECT DISTINCT o_custkey AS task_id FROM orders WHERE o_custkey NOT IN (SELECT task_id FROM ({CACHE}) WHERE text <> '')")
def jon_2(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id")).distinct()
    return tasks.still_to_describe(wanted, _cache(spark, d).where("text <> ''"))


@query("jon_3_fan_out", f"SELECT clip_index, style, pool_index::INT AS pool_index, ['m/a', 'm/b', 'm/c'][pool_index + 1] AS model FROM (SELECT clip_index, unnest(styles) AS style FROM ({TASKS}) WHERE {VALID}) CROSS JOIN (SELECT unnest([0, 1, 2]) AS pool_index)")
def jon_3(spark: SparkSession, d: str) -> DataFrame:
    return tasks.fan_out(_tasks(spark, d).where(tasks.valid_task()), ["m/a", "m/b", "m/c"]).select("clip_index", "style", "pool_index", "model")


def _described(spark: SparkSession, d: str, second: bool) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer")
    if second:
        return rows.where(k % 4 != 0).select(k.alias("task_id"), F.when(k % 3 != 0, "B").alias("text"), F.when(k % 3 != 0, "").otherwise("InvalidJSON").alias("error"), F.when(k % 2 == 0, k % 10 / 10).alias("proxy"))
    return rows.where(k % 5 != 0).select(k.alias("task_id"), F.when(k % 7 != 0, "A").alias("text"), F.when(k % 7 != 0, "").otherwise("timeout").alias("error"), F.when(k % 11 != 0, k % 8 / 10).alias("proxy"))


@query(
    "jon_6_pick_description",
    """WITH a AS (SELECT c_custkey AS task_id, c_custkey % 7 <> 0 AS ok, CASE WHEN c_custkey % 7 = 0 THEN 'timeout' ELSE '' END AS error, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 8)::DOUBLE / 10 END AS proxy FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS task_id, c_custkey % 3 <> 0 AS ok, CASE WHEN c_custkey % 3 = 0 THEN 'InvalidJSON' ELSE '' END AS error, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 10)::DOUBLE / 10 END AS proxy FROM customer WHERE c_custkey % 4 <> 0),
j AS (SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.ok, false) AS a_ok, coalesce(b.ok, false) AS b_ok, coalesce(b.proxy, -1) > coalesce(a.proxy, -1) AS higher, a.error AS ae, b.error AS be FROM a FULL JOIN b ON a.task_id = b.task_id)
SELECT task_id, CASE WHEN b_ok AND (NOT a_ok OR higher) THEN 'alternate' WHEN a_ok THEN 'primary' ELSE 'none' END AS chosen, CASE WHEN NOT a_ok AND NOT b_ok THEN coalesce(ae, be, 'missing') ELSE '' END AS error FROM j""",
)
def jon_6(spark: SparkSession, d: str) -> DataFrame:
    return tasks.pick_description(_described(spark, d, False), _described(spark, d, True)).select("task_id", "chosen", "error")


@query(
    "jon_8_upsert",
    f"SELECT * FROM (SELECT coalesce(c.task_id, l.task_id) AS task_id, coalesce(l.text, c.text) AS text, CASE WHEN l.text IS NOT NULL THEN 'live' ELSE 'cache' END AS source FROM ({CACHE}) c FULL JOIN ({LIVE}) l ON c.task_id = l.task_id) WHERE text <> ''",
)
def jon_8(spark: SparkSession, d: str) -> DataFrame:
    return tasks.upsert(_cache(spark, d), _live(spark, d))


def _described_raw() -> F.Column:
    """Description objects from events: fenced, incomplete, without subjects, with null, broken."""
    n = F.col("event_id")
    subjects = F.when(n % 6 == 0, "[]").when(n % 6 == 1, '"none"').otherwise(F.concat(F.lit('[{"name": "'), F.col("event_type"), F.lit('", "colors": ["red", ""]}, {"name": " "}]')))
    late = F.when(n % 8 == 0, "null").otherwise(F.concat(F.lit('"'), F.when(n % 3 == 0, "it moves on slowly now").otherwise("it stands there quite still"), F.lit('"')))
    body = F.concat(F.lit('{"setting": "a '), F.when(n % 5 == 0, "x").otherwise("long road"), F.lit(' here", "actions_early": "it moves on slowly now", "actions_late": '), late, F.lit(', "subjects": '), subjects, F.lit("}"))
    return F.when(n % 10 == 9, "no object").when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), body, F.lit(" done")))


PARSED = """SELECT event_id, CASE WHEN event_id % 10 = 9 OR event_id % 8 = 0 OR event_id % 6 = 1 THEN 'InvalidJSON' ELSE '' END AS reason, event_id % 6 = 0 AS none, event_type, event_id % 3 = 0 AS same, event_id % 5 = 0 AS short FROM events"""


@query("dsc_1_json_text", """SELECT event_id, event_id % 10 <> 9 AS found, event_id % 10 = 9 AS bare FROM events""")
def dsc_1(spark: SparkSession, d: str) -> DataFrame:
    text = describe.json_text(_described_raw())
    return table(spark, d, "events").select("event_id", text.rlike(r"(?s)^\{.*\}$").alias("found"), (text == "no object").alias("bare"))


@query(
    "dsc_2_parse",
    f"SELECT event_id, reason, CASE WHEN reason <> '' THEN '' WHEN none THEN CASE WHEN short THEN 'a x here scene' ELSE 'a long road here scene' END ELSE event_type END AS subject FROM ({PARSED})",
)
def dsc_2(spark: SparkSession, d: str) -> DataFrame:
    p = with_once(table(spark, d, "events").select("event_id", _described_raw().alias("raw")), p=describe.parse_description(F.col("raw")))
    return p.select("event_id", "p.reason", F.coalesce(F.get("p.d.subjects", F.lit(0))["name"], F.lit("")).alias("subject"))


@query(
    "dsc_4_format",
    f"""SELECT event_id, 'Primary subject: ' || CASE WHEN none THEN CASE WHEN short THEN 'a x here scene' ELSE 'a long road here scene' END ELSE event_type || ' (colors: red)' END || '|Setting: a ' || CASE WHEN short THEN 'x' ELSE 'long road' END || ' here|Actions (early): it moves on slowly now|Actions (late): '
  || CASE WHEN same THEN 'it moves on slowly now' ELSE 'it stands there quite still' END || '|Caption focus: the primary subject leads, other subjects and the background follow.' AS facts FROM ({PARSED}) WHERE reason = ''""",
)
def dsc_4(spark: SparkSession, d: str) -> DataFrame:
    p = with_once(table(spark, d, "events").select("event_id", _described_raw().alias("raw")), p=describe.parse_description(F.col("raw"))).where("p.ok")
    return p.select("event_id", F.replace(describe.format_description(F.col("p.d")), F.lit("\n"), F.lit("|")).alias("facts"))


@query(
    "dsc_5_quality",
    f"SELECT event_id, CASE WHEN same THEN 'StaticActions' WHEN event_id % 4 < 2 THEN 'MissingBackground' ELSE '' END AS weakness FROM ({PARSED}) WHERE reason = ''",
)
def dsc_5(spark: SparkSession, d: str) -> DataFrame:
    """Settings have three words at least here, actions five; half of the clips are long."""
    p = with_once(table(spark, d, "events").select("event_id", _described_raw().alias("raw")), p=describe.parse_description(F.col("raw"))).where("p.ok")
    return p.select("event_id", describe.description_quality(F.col("p.d"), F.when(F.col("event_id") % 4 < 2, 90.0).otherwise(30.0), PLAIN).alias("weakness"))


@query(
    "txt_14_reply_issue",
    f"SELECT event_id, CASE WHEN reason <> '' THEN CASE WHEN event_id % 4 = 1 THEN 'Truncated' ELSE reason END WHEN same THEN 'StaticActions' WHEN event_id % 4 < 2 THEN 'MissingBackground' ELSE '' END AS issue FROM ({PARSED})",
)
def txt_14(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth reply ended at the model's limit."""
    n = F.col("event_id")
    issue = describe.reply_issue(_described_raw(), F.when(n % 4 == 1, "length").otherwise("stop"), F.when(n % 4 < 2, 90.0).otherwise(30.0), PLAIN)
    return table(spark, d, "events").select("event_id", issue.alias("issue"))


@query(
    "snk_1_results",
    "SELECT task_id, " + ", ".join(f"max(text) FILTER (WHERE style = '{s}') AS {s}" for s in STYLES) + f" FROM ({CAPTIONS}) GROUP BY 1",
)
def snk_1(spark: SparkSession, d: str) -> DataFrame:
    """The nested results, one column a style so that they compare."""
    nested = nested_results(captions(spark, d).withColumn("clip_index", F.col("task_id")))
    return nested.select("task_id", *[F.try_element_at("captions", F.lit(s)).alias(s) for s in STYLES])


@query(
    "snk_1_last_written",
    "SELECT task_id, " + ", ".join(f"max_by(text, pool_index) FILTER (WHERE style = '{s}') AS {s}" for s in STYLES) + f" FROM ({CAPTIONS}) GROUP BY 1",
)
def snk_1_last(spark: SparkSession, d: str) -> DataFrame:
    """Of a style that a task's candidates give twice the last by pool index ships."""
    nested = nested_results(captions(spark, d).withColumn("clip_index", F.col("task_id")), written="pool_index")
    return nested.select("task_id", *[F.try_element_at("captions", F.lit(s)).alias(s) for s in STYLES])


@query("snk_2_description_cache", "SELECT conv_id::VARCHAR AS task_id, max(text) AS text, 'live' AS source FROM conversations WHERE text <> '' GROUP BY 1")
def snk_2(spark: SparkSession, d: str) -> DataFrame:
    """Turns as descriptions, written as a nested cache and read back from it."""
    path = shared_path(spark, "cache")
    write_descriptions(table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), "text"), path, "live")
    source = spark.read.json(path).select("meta.source").distinct()
    return read_descriptions(spark, path).withColumn("source", F.lit(source.first()[0]))
