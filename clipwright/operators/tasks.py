"""Tasks, messages, frames and joins of clips (TSK, MSG, FRM, JON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STYLES, Settings
from ..functions.places import CHUNK, before_chunks, chunk_of, with_place
from ..functions.text import let, trimmed

# Content types that are no video (any `text/` type is refused too), codes and labels of failures, and the texts that mark a failure.
REFUSED_TYPES = ("application/json", "application/xml")
DESCRIBE_CODES = {"EmptyResponse": "empty", "empty": "empty", "Truncated": "truncated", "truncated": "truncated", "InvalidJSON": "truncated"}
CAPTION_CODES = {"EmptyResponse": "empty", "Truncated": "truncated", "MetaLeak": "meta_leak", "TooShort": "too_short", "TooLong": "too_long"}
CODE_LABELS = {"empty": "EmptyResponse", "truncated": "Truncated", "meta_leak": "MetaLeak", "too_short": "TooShort", "too_long": "TooLong", "api": "APIError", "timeout": "Timeout"}
FAILURE_PREFIXES = {"describe": "Failed to describe video:", "caption": "Failed to caption:", "process": "Failed to process video:"}
TASK_FAILURES = {"invalid_task": "Invalid task input.", "unsupported_style": "Unsupported style requested."}
#: Most rows of a side that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def normalise_styles(raw: Column) -> Column:
    """TSK-1: strings of a JSON list, distinct, in order; anything else gives an empty list."""
    none = F.array().cast("array<string>")
    items = F.from_json(raw, "array<variant>")
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.when(trimmed(F.coalesce(raw, F.lit(""))).startswith("["), F.coalesce(F.array_distinct(F.filter(texts, lambda t: t.isNotNull())), none)).otherwise(none)


def valid_task() -> Column:
    """Has an id, a URL and styles."""
    return (F.coalesce("task_id", F.lit("")) != "") & (F.coalesce("video_url", F.lit("")) != "") & (F.size("styles") > 0)


def invalid_captions(tasks: DataFrame) -> DataFrame:
    """TSK-2: a failure row for each style of the tasks that can't run; clip_index keeps those without an id apart."""
    bad = tasks.where(~valid_task())
    styles = F.when(F.size("styles") > 0, F.col("styles")).otherwise(F.array(F.lit("formal")))
    return bad.select("clip_index", F.coalesce(F.nullif("task_id", F.lit("")), F.lit("unknown")).alias("task_id"), F.explode(styles).alias("style"), F.lit("process").alias("failure"))


def style_status(style: Column) -> Column:
    """TSK-3."""
    return F.when(style.isin(*STYLES), "ready").otherwise("unsupported-style")


def dry_run_text(task_id: Column, style: Column) -> Column:
    """TSK-4."""
    return F.format_string("[DRY_RUN] %s - %s", task_id, style)


def duration_hint(value: Column) -> Column:
    """TSK-5: not a number, missing or negative counts as 0."""
    x = trimmed(value.cast("string")).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).otherwise(x)


def refused_type(content_type: Column) -> Column:
    """TSK-6: a fetched item that can't be a video; no type at all is allowed."""
    kind = F.lower(trimmed(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return kind.isin(*REFUSED_TYPES) | kind.startswith("text/")


def provider(model: Column) -> Column:
    """TSK-7: struct(provider, bare_id, no_thinking) of a model id.

    `google-ai/...` and `gemma-...` are called directly, other ids with a slash through the router, and `accounts/...` and plain ids at the default
    provider. Only a direct id loses its first part. Hybrid reasoning models are asked not to think.
    """
    slug = trimmed(F.coalesce(model, F.lit("")))
    low = F.lower(slug)
    own_path = low.startswith("accounts/")
    direct = ~own_path & (low.startswith("google-ai/") | low.startswith("gemma-"))
    name = F.when(direct, "direct").when(~slug.startswith("accounts/") & slug.contains("/"), "router").otherwise("default")
    bare = F.when(direct & low.startswith("google-ai/"), F.regexp_replace(slug, r"^[^/]*/", "")).otherwise(slug)
    return F.struct(name.alias("provider"), bare.alias("bare_id"), (low.contains("qwen") | low.contains("kimi")).alias("no_thinking"))


# --- messages ------------------------------------------------------------------------------------------------------


def failure_kind(text: Column) -> Column:
    """The kind of failure that a text reports, or null for a caption: by its prefix; any other `failed to` counts as a failed caption."""
    kind = F.when(text.isin(*TASK_FAILURES.values()), "process")
    for name, prefix in FAILURE_PREFIXES.items():
        kind = kind.when(text.startswith(prefix), name)
    return kind.when(F.lower(trimmed(text)).startswith("failed to"), "caption")


def public_messages(captions: DataFrame, messages: DataFrame, friendly: bool = True) -> DataFrame:
    """MSG-1: ``captions`` (text, style, ...) with message: what ships in place of the text.

    A text that reports a failure gets the message of its kind and style from ``messages`` (kind, style, message), unknown styles that of formal, and a
    kind without any message a general one; other texts ship trimmed. With ``friendly`` off, texts ship as they are. A null text counts as a failed caption.
    """
    if not friendly:
        return captions.withColumn("message", F.coalesce("text", F.lit("")))
    small = messages.select(F.col("kind").alias("_k"), F.col("style").alias("_s"), F.col("message"))
    if messages.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    kind = F.when(trimmed(F.coalesce("text", F.lit(""))) == "", "caption").otherwise(failure_kind(F.col("text")))
    known = captions.drop("message").withColumns({"_k": kind, "_s": F.when(F.col("style").isin(*STYLES), F.col("style")).otherwise("formal")})
    out = known.join(small, ["_k", "_s"], "left")
    return out.withColumn("message", F.when(F.col("_k").isNull(), trimmed(F.col("text"))).otherwise(F.coalesce("message", F.lit("This clip has no caption.")))).drop("_k", "_s")


def _coded(reason: Column, codes: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), reason)


def describe_code(reason: Column) -> Column:
    """MSG-2: the code of a failed description: by name, else a timeout, else the API's failure."""
    known = F.coalesce(reason, F.lit(""))
    return F.coalesce(_coded(known, DESCRIBE_CODES), F.when(F.lower(known).contains("timeout"), "timeout").otherwise("api"))


def caption_code(reason: Column) -> Column:
    """MSG-2: the code of a failed caption."""
    return F.coalesce(_coded(F.coalesce(reason, F.lit("")), CAPTION_CODES), F.lit("api"))


def failure_text(kind: str, code: Column, detail: Column) -> Column:
    """MSG-2: the text that reports a failure (kind: describe, caption or process): its detail if there is one, else the label of its code; without code `Unknown`."""
    given = F.nullif(F.coalesce(detail, F.lit("")), F.lit(""))
    label = F.coalesce(given, _coded(code, CODE_LABELS) if kind != "process" else code, F.lit("Unknown"))
    told = F.concat(F.lit(f"{FAILURE_PREFIXES[kind]} "), label)
    return F.coalesce(_coded(code, TASK_FAILURES), told) if kind == "process" else told


def prompt(hint: Column, facts: Column, nudge: Column, feedback: Column) -> Column:
    """MSG-4: the parts that are there, apart by a blank line."""
    part = lambda c: F.nullif(trimmed(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws("\n\n", part(hint), part(facts), part(nudge), part(feedback))


# --- frames ----------------------------------------------------------------------------------------------------------


def frame_budget(duration_s: Column, settings: Settings) -> Column:
    """FRM-1: one frame each interval within bounds, both by whether the clip is short; the least number where the duration isn't known; or a fixed number."""
    if settings.fixed_frames is not None:
        return F.lit(max(settings.fixed_frames, 1))
    d = F.coalesce(duration_s, F.lit(0.0))

    def within(interval: float, bounds: tuple[int, int]) -> Column:
        low = max(bounds[0], 1)
        return F.when(d <= 0, low).otherwise(F.greatest(F.lit(low), F.least(F.lit(max(bounds[1], low)), F.bround(d / max(interval, 0.5), 0).cast("int"))))

    return F.when(d >= settings.short_clip_s, within(settings.long_interval_s, settings.long_frames)).otherwise(within(settings.short_interval_s, settings.short_frames))


def frame_width(duration_s: Column, settings: Settings) -> Column:
    """FRM-2: short clips wider; no duration counts as long."""
    return F.when((duration_s > 0) & (duration_s < settings.short_clip_s), settings.width_short).otherwise(settings.width_long)


def _spread(count: Column, n: Column, last: Column, digits: int) -> Column:
    """``n`` values from 0 to ``last`` with equal steps."""
    steps = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.transform(steps, lambda i: F.bround(i * last / F.greatest(n - 1, F.lit(1)), digits))


def uniform_plan(count: Column, n: Column) -> Column:
    """FRM-3: frame numbers spread over a clip; the first if only one is asked for, none of no frames."""
    spread = F.transform(_spread(count, n, count - 1, 0), lambda x: x.cast("int"))
    return F.when(n <= 1, F.array(F.lit(0))).when(count <= 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(spread)))


def time_plan(duration_s: Column, n: Column) -> Column:
    """FRM-4: milliseconds spread over a clip, to a tenth; none without a duration."""
    none = F.array().cast("array<double>")
    return F.when(n <= 1, F.array(F.lit(0.0))).when(F.coalesce(duration_s, F.lit(0.0)) <= 0, none).otherwise(F.array_sort(F.array_distinct(_spread(duration_s, n, duration_s * 1000, 1))))


def scene_scores(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """FRM-5: Bhattacharyya distance of each histogram to the one before in its clip, with six decimals; 1 for the first and beside an empty one. Histograms leave at once.

    A clip's samples are compared in chunks of ``chunk`` numbers, so a long clip spreads over tasks; only the last histogram of a chunk goes on to the next.
    """
    held = samples.withColumn("_chunk", chunk_of("sample_idx", chunk))
    w = Window.partitionBy("task_id", "_chunk").orderBy("sample_idx")
    near = held.select("task_id", "_chunk", "sample_idx", "hist", F.lag("hist").over(w).alias("_p"), (F.row_number().over(w) == 1).alias("_opens"))
    ends = before_chunks(samples, ["task_id"], "sample_idx", F.max_by("hist", "sample_idx"), chunk).where("_before IS NOT NULL")
    near = near.join(ends, ["task_id", "_chunk"], "left").withColumn("_p", F.when(F.col("_opens"), F.col("_before")).otherwise(F.col("_p")))
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x.cast("double"))
    overlap = F.aggregate(F.zip_with("hist", "_p", lambda a, b: F.sqrt(a.cast("double") * b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    scale = F.sqrt(total(F.col("hist")) * total(F.col("_p")))
    far = F.when(scale > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - overlap / scale)))
    return near.select("task_id", "sample_idx", F.when(F.col("_p").isNull(), 1.0).otherwise(F.bround(F.coalesce(far, F.lit(1.0)), 6)).alias("score"))


def scene_frames(scores: DataFrame, threshold: float) -> DataFrame:
    """FRM-6: (task_id, frames): first and last frame and the middle of each segment between cuts. ``scores`` has frame_count.

    Cuts are the first sample, the samples whose score reaches the threshold, and the last frame, which is a segment of its own. A clip without frames has none.
    A task's array holds its cuts, which are gathered where the samples are; no clip's samples meet in one task.
    """
    index = F.col("sample_idx").cast("int")
    cuts = scores.groupBy("task_id").agg(F.collect_set(F.when(F.col("score") >= threshold, index)).alias("c"), F.min(index).alias("first"), F.max("frame_count").cast("int").alias("n"))
    last = F.greatest(F.col("n") - 1, F.lit(0))
    bounds = cuts.select("task_id", "n", last.alias("last"), F.array_sort(F.array_union("c", F.array("first", last, last + 1))).alias("b"))
    middles = F.zip_with(F.slice("b", F.lit(1), F.size("b") - 1), F.slice("b", F.lit(2), F.size("b") - 1), lambda start, end: F.floor((start + end - 1) / 2).cast("int"))
    frames = F.array_sort(F.array_union(F.array(F.lit(0), F.col("last")), middles))
    return bounds.select("task_id", F.when(F.col("n") > 0, frames).otherwise(F.array().cast("array<int>")).alias("frames"))


def merge_frames(preferred: Column, filler: Column, n: Column) -> Column:
    """FRM-7: both lists within a budget: first and last stay, the places between go evenly to the frames between."""
    every = F.array_sort(F.array_union(preferred, filler))

    def within(x: Column) -> Column:
        inner, slots = F.size(x) - 2, n - 2
        ends = F.array(F.get(x, F.lit(0)), F.get(x, F.size(x) - 1))
        at = lambda i: F.when(slots > 1, F.bround(i * (inner - 1) / F.greatest(slots - 1, F.lit(1)), 0)).otherwise(F.floor(inner / 2)).cast("int")
        picked = F.transform(F.sequence(F.lit(0), F.greatest(slots - 1, F.lit(0))), lambda i: F.get(x, at(i) + 1))
        return F.when(F.size(x) <= n, x).when(n == 1, F.slice(x, 1, 1)).when(slots <= 0, ends).otherwise(F.array_sort(F.array_union(ends, picked)))

    return F.when(n <= 0, F.slice(every, 1, 0)).otherwise(let(every, within))


def frame_plan(mode: Column, count: Column, n: Column, scene: Column, duration_s: Column) -> Column:
    """FRM-8: struct(kind, frames, times): by scenes, by frame numbers, by time where the number of frames is unknown, or the first frames as they come."""
    none = F.array().cast("array<int>")
    cut = (mode == "scene") & (count > 0) & (n > 1) & scene.isNotNull() & (F.size(scene) > 0)
    kind = F.when(cut, "scene").when((n <= 1) | (count > 0), "uniform").when(F.coalesce(duration_s, F.lit(0.0)) > 0, "time").otherwise("first")
    frames = F.when(kind == "scene", merge_frames(scene, uniform_plan(count, n), n)).when(kind == "uniform", uniform_plan(count, n)).when(kind == "first", F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i)).otherwise(none)
    return F.struct(kind.alias("kind"), frames.alias("frames"), F.when(kind == "time", time_plan(duration_s, n)).alias("times"))


def even_subset(frames: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """FRM-9: of each clip at most ``most`` frames, evenly; the middle one if one. Frames are counted in chunks, so a long clip spreads over tasks."""
    placed = with_place(frames, ["task_id"], "sample_idx", "_place", "_total", chunk)
    if most == 1:
        keep = F.col("_place") == F.floor(F.col("_total") / 2)
    else:
        wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_total") - 1) / (most - 1), 0).cast("long"))
        keep = (F.col("_total") <= most) | F.array_contains(wanted, F.col("_place").cast("long"))
    return placed.where(keep).drop("_place", "_total").select(*frames.columns)


# --- joins -----------------------------------------------------------------------------------------------------------


def with_facts(captions: DataFrame, descriptions: DataFrame) -> DataFrame:
    """JON-1: captions with the facts of their task, null where there are none."""
    return captions.join(descriptions.select("task_id", F.col("text").alias("facts")), "task_id", "left")


def still_to_describe(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """JON-2."""
    return tasks.join(cache.select("task_id"), "task_id", "left_anti")


def fan_out(tasks: DataFrame, models: list[str]) -> DataFrame:
    """JON-3: a row for each task, style and model of the pool; the pool is configuration, so it is a literal array and nothing is joined."""
    pool = F.array(*[F.struct(F.lit(k).alias("pool_index"), F.lit(m).alias("model")) for k, m in enumerate(models)])
    return tasks.select("*", F.explode("styles").alias("style")).select("*", F.inline(pool))


def pick_description(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """JON-6: of two descriptions the one that is ok; of two ok ones the alternate only if its proxy is higher; else the primary's error."""
    a = primary.select("task_id", *[F.col(c).alias(f"a_{c}") for c in ("text", "error", "proxy")])
    b = alternate.select("task_id", *[F.col(c).alias(f"b_{c}") for c in ("text", "error", "proxy")])
    both = a.join(b, "task_id", "full")
    a_ok, b_ok = (F.col(f"{x}_text").isNotNull() & (F.coalesce(f"{x}_error", F.lit("")) == "") for x in "ab")
    higher = F.coalesce("b_proxy", F.lit(-1.0)) > F.coalesce("a_proxy", F.lit(-1.0))
    second = b_ok & (~a_ok | higher)
    return both.select(
        "task_id",
        F.when(second, "alternate").when(a_ok, "primary").otherwise("none").alias("chosen"),
        F.when(second, F.col("b_text")).when(a_ok, F.col("a_text")).alias("text"),
        F.when(~a_ok & ~b_ok, F.coalesce("a_error", "b_error", F.lit("missing"))).otherwise("").alias("error"),
    )


def vision_targets(scores: DataFrame, failed: DataFrame, mode: str) -> DataFrame:
    """JON-7: rows to send to the vision judge: off, all, humor, or fail."""
    if mode == "off":
        return scores.where(F.lit(False))
    if mode == "humor":
        return scores.where(F.col("style").startswith("humorous"))
    return scores if mode == "all" else scores.join(failed.select("task_id", "style"), ["task_id", "style"], "left_semi")


def upsert(cache: DataFrame, live: DataFrame) -> DataFrame:
    """JON-8: live descriptions over the cache; other keys stay, empty texts go. One row a task_id is expected on both sides."""
    new = live.where(F.coalesce("text", F.lit("")) != "").select("task_id", F.col("text").alias("_new"))
    out = cache.join(new, "task_id", "full")
    source = F.when(F.col("_new").isNotNull(), "live").otherwise("cache")
    return out.select("task_id", F.coalesce("_new", "text").alias("text"), source.alias("source")).where(F.coalesce("text", F.lit("")) != "")


def caption_of(scores: DataFrame, captions: DataFrame) -> DataFrame:
    """JON-9: scores with their caption; of repeated ids the last clip's text."""
    last = captions.groupBy("task_id", "style").agg(F.max_by("text", "clip_index").alias("caption"))
    return scores.join(last, ["task_id", "style"], "left")


def fallback_description(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """JON-10: the first description if ok, else the fallback if ok, else the first one's error."""
    b = fallback.select("task_id", F.col("text").alias("_t"), F.col("error").alias("_e"))
    ok, ok_b = F.coalesce("error", F.lit("")) == "", F.col("_t").isNotNull() & (F.coalesce("_e", F.lit("")) == "")
    return first.join(b, "task_id", "left").select("task_id", F.when(ok, F.col("text")).when(ok_b, F.col("_t")).alias("text"), F.when(ok | ok_b, "").otherwise(F.col("error")).alias("error"))
