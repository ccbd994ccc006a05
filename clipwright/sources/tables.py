"""Reading and writing of the jobs' tables (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STYLES, RuleBook, Settings
from ..operators.judging import totals

#: Most phrases of a rule table, which goes to the driver and into the rules' expressions.
MOST_PHRASES = 10_000


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: tasks from a JSON array, one file at a time; a file whose root is no array is an error.

    For many tasks store JSON Lines or Parquet with clip_index instead, see README.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("value", F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.raise_error(F.lit("the root of a task list must be an array"))))
    items = raw.select(F.posexplode(F.from_json("value", "array<struct<task_id: string, video_url: string, styles: string, meta: struct<duration_s: string>>>")).alias("clip_index", "t"))
    return items.select(F.col("clip_index").cast("long"), "t.task_id", "t.video_url", F.col("t.styles").alias("styles_raw"), F.col("t.meta.duration_s").alias("duration_raw"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: (task_id, text) from {"descriptions": {...}} or a flat object, without empty texts. A file holds one object, on any number of lines, or one a line."""
    flat = "map<string,string>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.when(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{flat}>").isNotNull(), F.array("value")).otherwise(F.split("value", r"\r?\n"))).alias("value"))
    inner = F.from_json(F.get_json_object("value", "$.descriptions"), flat)
    return whole.select(F.explode(F.coalesce(inner, F.from_json("value", flat))).alias("task_id", "text")).where(F.coalesce("text", F.lit("")) != "")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: (clip_index, task_id, style, text) from results; captions that are no object count as none."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", "array<struct<task_id: string, captions: string>>")).alias("clip_index", "t"))
    return rows.select(F.col("clip_index").cast("long"), "t.task_id", F.explode(F.from_json("t.captions", "map<string,string>")).alias("style", "text"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: (path, jpeg, data_url) of image files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jp*g").load(path)
    return files.select("path", F.col("content").alias("jpeg"), F.concat(F.lit("data:image/jpeg;base64,"), F.base64("content")).alias("data_url"))


EVENTS = (
    "ts timestamp, stage string, task_id string, download_s double, describe_s double, styles_s double, total_s double, frames int, video_duration_s double, "
    "describe_attempts int, style_attempts map<string,int>, describe_error string, process_error string"
)


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """SRC-5: run events from JSON lines."""
    return (spark.readStream if stream else spark.read).schema(EVENTS).json(path)


def read_rules(phrases: DataFrame) -> RuleBook:
    """The rules with the lists of a table (list, phrase), by the names of RuleBook's fields; lists that it lacks keep their defaults.

    Phrases are taken in lower case and in order. More than MOST_PHRASES rows, or a list of another name, are an error.
    """
    rows = phrases.select("list", F.lower("phrase").alias("phrase")).where(F.col("phrase") != "").distinct().limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["list"], []).append(r["phrase"])
    lists = {k for k, v in vars(RuleBook()).items() if isinstance(v, tuple)}
    if set(found) - lists:
        raise ValueError(f"no such list: {', '.join(sorted(set(found) - lists))}")
    return RuleBook(**{k: tuple(sorted(v)) for k, v in found.items()})


def nested_results(captions: DataFrame, written: str | None = None) -> DataFrame:
    """SNK-1: one row a task with its captions as a map. Of a style written twice that with the greatest ``written`` stays, ties and without that column the last in text order.

    Groups are as large as a task's styles.
    """
    last = F.max("text") if written is None else F.max(F.struct(F.col(written).alias("w"), "text"))["text"]
    one = captions.groupBy("clip_index", "task_id", "style").agg(last.alias("text"))
    return one.groupBy("clip_index", "task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("style", "text")))).alias("captions"))


def write_results(captions: DataFrame, path: str, written: str | None = None) -> None:
    nested_results(captions, written).orderBy("clip_index").select("task_id", "captions").write.json(path)


def nested_descriptions(descriptions: DataFrame, meta: dict[str, str | bool], each: int = 5_000) -> DataFrame:
    """SNK-2: rows {"descriptions": {task_id: text, ...}, "meta": {...}} of about ``each`` tasks, as SRC-2 reads them; empty texts are left out.

    Of a task described twice the text that is last in order stays.
    """
    kept = descriptions.where(F.coalesce("text", F.lit("")) != "").groupBy("task_id").agg(F.max("text").alias("text"))
    parts = max(1, -(-kept.count() // each))
    grouped = kept.groupBy(F.pmod(F.xxhash64("task_id"), F.lit(parts)).alias("_part")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("task_id").cast("string"), "text")))).alias("descriptions"))
    return grouped.select("descriptions", F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta"))


def write_descriptions(descriptions: DataFrame, path: str, source: str, updated_from_live: bool = False) -> None:
    """SNK-2: a description cache with where it came from and whether it was updated from a live run; no row holds all tasks."""
    nested_descriptions(descriptions, {"source": source} | ({"updated_from_live": True} if updated_from_live else {})).write.json(path)


def nested_report(panel: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """SNK-3: one row a task with its styles' scores, in the order of styles; with ``clips`` (task_id, distinctness, note, parse_error) also those."""
    order = F.array_position(F.array(*map(F.lit, STYLES)), F.col("style"))
    item = F.struct(order.alias("o"), "style", "accuracy", "style_match", "issue", "meta_leak", "skipped", *(["skip_reason"] if "skip_reason" in panel.columns else []))
    rows = panel.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    out = rows.select("task_id", F.transform("s", lambda x: x.dropFields("o")).alias("captions"))
    if clips is None:
        return out
    told = clips.select("task_id", F.col("distinctness").alias("cross_style_distinctness"), F.col("note").alias("distinctness_note"), "parse_error")
    return out.join(told, "task_id", "left")


def report_header(panel: DataFrame, scores: DataFrame, settings: Settings, model: str, described: bool) -> DataFrame:
    """SNK-3: one row: model, bar, passes, captions and mean of the panel, and the same of each judge in ``scores`` (judge_model), whose number is that of models."""
    whole = totals(panel, settings.judge_min_score).select(F.struct("passes", "total", F.col("mean").alias("mean_score")).alias("t"))
    judges = totals(scores, settings.judge_min_score, "judge_model").select(F.struct(F.col("judge_model").alias("model"), "passes", "total", F.col("mean").alias("mean_score")).alias("j"))
    listed = judges.agg(F.array_sort(F.collect_list("j")).alias("per_judge"))
    given = [F.lit(model).alias("model"), F.lit(settings.judge_min_score).alias("min_score"), F.lit(described).alias("descriptions_provided")]
    return whole.select(*given, "t.*").join(F.broadcast(listed)).withColumn("panel_models", F.transform("per_judge", lambda x: x["model"]))


def write_report(panel: DataFrame, scores: DataFrame, clips: DataFrame, path: str, settings: Settings, model: str, described: bool = True) -> None:
    """SNK-3: the judge report as JSON lines: its header in `summary`, a line for each task in `clips`, so that no row holds all tasks."""
    report_header(panel, scores, settings, model, described).write.json(f"{path}/summary")
    nested_report(panel, clips).write.json(f"{path}/clips")


def event_rows(stages: DataFrame, now: Column | None = None) -> DataFrame:
    """SNK-4: one JSON text a row: UTC time, seconds with three decimals, their sum; fields that are null are left out."""
    parts = [F.bround(F.coalesce(c, F.lit(0.0)), 3).alias(c) for c in ("download_s", "describe_s", "styles_s")]
    total = F.bround(sum((F.coalesce(c, F.lit(0.0)) for c in ("download_s", "describe_s", "styles_s")), F.lit(0.0)), 3).alias("total_s")
    rest = [F.col(c) for c in stages.columns if c not in ("ts", "download_s", "describe_s", "styles_s", "total_s")]
    ts = F.date_format(now if now is not None else F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts")
    return stages.select(F.to_json(F.struct(ts, *rest, *parts, total)).alias("value"))
