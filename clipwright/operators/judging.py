"""Judge replies and panels: parsing (JDG), aggregation (AGG-1 to 5, 7), reports (TOP), failures (SET-1), rounds (WIN-3, WIN-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STYLES, RuleBook, Settings
from ..functions.places import with_position
from ..functions.text import alternation, let, trimmed, with_once
from . import text_rules as rules_of

CAP = 0.2
FIELD = "map<string,string>"


def json_text(raw: Column) -> Column:
    """DSC-1: without a code fence, from the first { to the last }; without braces the bare text."""
    unfenced = lambda t: F.when(t.startswith("```"), trimmed(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(t)
    inner = lambda bare: let(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), lambda x: F.when(x != "", x).otherwise(bare))
    return let(trimmed(F.coalesce(raw, F.lit(""))), lambda t: let(unfenced(t), inner))


def unit_score(value: Column) -> Column:
    """JDG-1: a number from 0 to 1 with three decimals; numeric text and booleans count, anything else and NaN is null."""
    number = lambda low: F.when(low == "true", 1.0).when(low == "false", 0.0).otherwise(low.try_cast("double"))
    in_range = lambda x: F.when((x >= 0) & (x <= 1) & ~F.isnan(x), F.bround(x, 3))
    return let(F.lower(trimmed(value.cast("string"))), lambda low: let(number(low), in_range))


def mean_of(a: Column, b: Column) -> Column:
    """Mean of two scores of three decimals, to three decimals, half to even; taken in whole thousandths, so ties are exact."""
    return F.bround((F.round(a * 1000) + F.round(b * 1000)) / 2, 0) / 1000


def flag(value: Column) -> Column:
    """JDG-2: true, a number other than zero, or one of 1, true, yes, y."""
    low = F.lower(trimmed(F.coalesce(value.cast("string"), F.lit(""))))
    return low.isin("1", "true", "yes", "y") | F.coalesce((low.try_cast("double") != 0) & ~F.isnan(low.try_cast("double")), F.lit(False))


#: JSON as it is defined, without the quotes that Spark's reader would also take.
STRICT = {"allowSingleQuotes": "false"}


def json_object(text: Column, kind: str) -> Column:
    """The JSON object that ``text`` consists of as ``kind``, read once; null if it is anything else, such as two objects or a cut one.

    Read as the only element of an array, so that what follows the object isn't overlooked. A field of a struct is the last of its repeated keys; a map
    keeps all of them, see ``last_of``.
    """
    return let(F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", STRICT), lambda rows: F.when(F.size(rows) == 1, F.get(rows, F.lit(0))))


def last_first(fields: Column) -> Column:
    """A map as struct(keys, values) from its end, so that the first place of a key is its last."""
    return F.struct(F.reverse(F.map_keys(fields)).alias("keys"), F.reverse(F.map_values(fields)).alias("values"))


def last_of(turned: Column, key: Column) -> Column:
    """The last value of a key, from ``last_first``; null without it."""
    return F.get(turned["values"], (F.array_position(turned["keys"], key) - 1).cast("int"))


def reply(raw: Column) -> Column:
    """struct(text, blank, ok, fields): a reply read once: its JSON text, whether it is blank, whether it is an object, and the object's fields as text, from the end."""

    def read(text: Column) -> Column:
        blank = trimmed(F.coalesce(raw, F.lit(""))) == ""
        return let(json_object(text, FIELD), lambda m: F.struct(text.alias("text"), blank.alias("blank"), m.isNotNull().alias("ok"), last_first(m).alias("fields")))

    return let(json_text(raw), read)


def _field(r: Column, name: str) -> Column:
    """A field of a reply's object; of repeated keys the last."""
    return last_of(r["fields"], F.lit(name))


def _has(r: Column, name: str) -> Column:
    """Whether the key is there, be it null."""
    return F.coalesce(F.array_contains(r["fields"]["keys"], name), F.lit(False))


def _number(r: Column, name: str) -> Column:
    """A number after its key in the text, for replies that were cut; of repeated keys the last."""
    found = F.regexp_extract(r["text"], rf'(?is)^.*"{name}"\s*:\s*([0-9]*\.?[0-9]+)', 1)
    return let(found, lambda x: F.when(x != "", x))


def leak_cap(score: Column, leak: Column) -> Column:
    """JDG-5, for one score."""
    return F.when(leak, F.least(score, F.lit(CAP))).otherwise(score)


def leak_issue(issue: Column, leak: Column) -> Column:
    named = F.when(issue == "", "meta-leak").when(~F.lower(issue).contains("meta"), F.concat(F.lit("meta-leak; "), issue)).otherwise(issue)
    return F.when(leak, named).otherwise(issue)


def parse_style_reply(df: DataFrame, raw: str = "raw") -> DataFrame:
    """JDG-4: adds accuracy, style_match, issue, meta_leak, error for a reply on one style; cut JSON is read by pattern.

    The older key style_fit counts only where style_match is absent, not where it is null.
    """
    read = with_once(df, _r=reply(F.col(raw)))
    r = F.col("_r")
    style = F.when(_has(r, "style_match"), _field(r, "style_match")).otherwise(_field(r, "style_fit"))
    cut_style = F.coalesce(_number(r, "style_match"), _number(r, "style_fit"))
    accuracy = F.when(r["ok"], _field(r, "accuracy")).otherwise(_number(r, "accuracy"))
    issue = F.when(r["ok"], F.coalesce(_field(r, "issue"), F.lit(""))).otherwise(F.regexp_extract(r["text"], r'(?is)"issue"\s*:\s*"(.*?)"', 1))
    leak = F.when(r["ok"], flag(_field(r, "meta_leak"))).otherwise(F.lower(F.regexp_extract(r["text"], r'(?i)"meta_leak"\s*:\s*(true|false)', 1)) == "true")
    read = read.withColumns({"_x": accuracy, "_y": F.when(r["ok"], style).otherwise(cut_style), "_i": trimmed(issue), "_l": leak})
    read = read.withColumns({"_a": unit_score(F.col("_x")), "_m": unit_score(F.col("_y")), "_readable": r["ok"] | (F.col("_x").isNotNull() & F.col("_y").isNotNull())})
    good = F.col("_readable") & F.col("_a").isNotNull() & F.col("_m").isNotNull()
    return read.withColumns(
        {
            "accuracy": F.when(good, leak_cap(F.col("_a"), F.col("_l"))),
            "style_match": F.when(good, leak_cap(F.col("_m"), F.col("_l"))),
            "issue": F.when(good, leak_issue(F.col("_i"), F.col("_l"))),
            "meta_leak": F.when(good, F.col("_l")),
            "error": F.when(r["blank"], "EmptyResponse").when(~F.col("_readable"), "InvalidJSON: could not parse judge scores").when(~good, "InvalidJSON: scores must be floats in [0, 1]").otherwise(""),
        }
    ).drop("_r", "_x", "_y", "_a", "_m", "_i", "_l", "_readable")


BATCH = "struct<captions: map<string,string>, cross_style_distinctness: string, distinctness_note: string>"


def parse_batch_reply(df: DataFrame, raw: str = "raw") -> DataFrame:
    """JDG-3: one row a style: accuracy, style_match, issue, meta_leak, skipped, skip_reason, and the reply's distinctness, note, parse_error.

    Of a style or key named twice the last counts; an entry that is no object is missing, the others stay.
    """
    r = F.col("_b")
    rows = with_once(df, _b=let(json_text(F.col(raw)), lambda t: json_object(t, BATCH))).withColumn("_c", last_first(r["captions"]))
    rows = with_once(rows.withColumn("style", F.explode(F.array(*map(F.lit, STYLES)))), _m=json_object(last_of(F.col("_c"), F.col("style")), FIELD)).withColumn("_e", last_first(F.col("_m")))
    key = lambda k: last_of(F.col("_e"), F.lit(k))
    match = F.when(F.array_contains(F.col("_e.keys"), "style_match"), key("style_match")).otherwise(key("style_fit"))
    leak = flag(key("meta_leak"))
    rows = rows.withColumns({"_a": unit_score(key("accuracy")), "_y": unit_score(match)})
    reason = F.when(F.col("_m").isNull(), "judge-missing-style").when(F.col("_a").isNull() | F.col("_y").isNull(), "judge-invalid-scores").otherwise("")
    return rows.withColumns(
        {
            "skip_reason": reason,
            "skipped": reason != "",
            "accuracy": F.when(reason == "", leak_cap(F.col("_a"), leak)).otherwise(0.0),
            "style_match": F.when(reason == "", leak_cap(F.col("_y"), leak)).otherwise(0.0),
            "issue": F.when(reason == "", leak_issue(trimmed(F.coalesce(key("issue"), F.lit(""))), leak)).otherwise(reason),
            "meta_leak": (reason == "") & leak,
            "distinctness": F.coalesce(unit_score(r["cross_style_distinctness"]), F.lit(0.0)),
            "distinctness_note": trimmed(F.coalesce(r["distinctness_note"], F.lit(""))),
            "parse_error": F.when(trimmed(F.coalesce(raw, F.lit(""))) == "", "EmptyResponse").when(r.isNull(), "InvalidJSON").otherwise(""),
        }
    ).drop("_b", "_c", "_m", "_e", "_a", "_y")


def parse_distinctness(raw: Column) -> Column:
    """JDG-6: struct(score, note, error)."""

    def read(r: Column) -> Column:
        found = F.when(r["ok"], _field(r, "cross_style_distinctness")).otherwise(_number(r, "cross_style_distinctness"))

        def told(score: Column) -> Column:
            error = (
                F.when(r["blank"], "EmptyResponse")
                .when(score.isNotNull(), "")
                .when(r["ok"] | found.isNotNull(), "InvalidJSON: distinctness must be a float in [0, 1]")
                .otherwise("InvalidJSON: could not parse distinctness")
            )
            note = F.when(r["ok"] & score.isNotNull(), trimmed(F.coalesce(_field(r, "distinctness_note"), F.lit("")))).otherwise("")
            return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), note.alias("note"), error.alias("error"))

        return let(unit_score(found), told)

    return let(reply(raw), read)


def parse_vision(raw: Column, settings: Settings) -> Column:
    """JDG-7: struct(accuracy, confidence, issue, error, usable); a missing confidence counts as 1."""

    def read(r: Column) -> Column:
        conf = F.when(_has(r, "confidence"), _field(r, "confidence")).otherwise(_field(r, "conf"))
        issue = F.when(r["ok"], F.coalesce(_field(r, "issue"), F.lit(""))).otherwise(F.regexp_extract(r["text"], r'(?is)"issue"\s*:\s*"(.*?)"', 1))
        scores = F.struct(
            unit_score(F.when(r["ok"], _field(r, "accuracy")).otherwise(_number(r, "accuracy"))).alias("a"),
            F.coalesce(unit_score(F.when(r["ok"], conf).otherwise(_number(r, "confidence"))), F.lit(1.0)).alias("c"),
        )

        def told(s: Column) -> Column:
            good = ~r["blank"] & s["a"].isNotNull()
            return F.struct(
                F.when(good, s["a"]).otherwise(0.0).alias("accuracy"),
                F.when(good, s["c"]).otherwise(0.0).alias("confidence"),
                F.when(good, trimmed(issue)).otherwise("").alias("issue"),
                F.when(r["blank"], "EmptyResponse").when(~good, "InvalidJSON").otherwise("").alias("error"),
                (good & (s["c"] >= settings.vision_confidence)).alias("usable"),
            )

        return let(scores, told)

    return let(reply(raw), read)


def parse_describe_judge(raw: Column) -> Column:
    """JDG-8: struct(faithfulness, coverage, proxy, error); the proxy is their mean with three decimals."""

    def read(r: Column) -> Column:
        pick = lambda k: unit_score(F.when(r["ok"], _field(r, k)).otherwise(_number(r, k)))

        def told(s: Column) -> Column:
            good = ~r["blank"] & s["f"].isNotNull() & s["c"].isNotNull()
            error = F.when(r["blank"], "EmptyResponse").when(~good, "InvalidJSON").otherwise("")
            return F.struct(F.when(good, s["f"]).alias("faithfulness"), F.when(good, s["c"]).alias("coverage"), F.when(good, mean_of(s["f"], s["c"])).alias("proxy"), error.alias("error"))

        return let(F.struct(pick("faithfulness").alias("f"), pick("coverage").alias("c")), told)

    return let(reply(raw), read)


def auto_skip(text: Column, rules: RuleBook, facts: Column | None = None) -> Column:
    """JDG-9: struct(skipped, skip_reason, meta_leak): captions that need no judge."""
    early = rules_of.structural_failure(text, rules)
    reason = F.when(early != "", early).otherwise(rules_of.hard_fail(text, rules, facts))
    return F.struct((reason != "").alias("skipped"), reason.alias("skip_reason"), reason.isin("meta-leak", "scene-mismatch", "describe-dump", "incomplete").alias("meta_leak"))


def clamp(df: DataFrame, rules: RuleBook) -> DataFrame:
    """JDG-10: (text, facts, accuracy, style_match, issue, meta_leak) with scores held down where the caption fails hard; blank captions stay."""
    facts = F.col("facts") if "facts" in df.columns else None
    reason = F.when(trimmed(F.coalesce("text", F.lit(""))) == "", "").otherwise(rules_of.hard_fail(F.col("text"), rules, facts))
    held = df.withColumn("_r", reason)
    bad, issue = F.col("_r") != "", F.when(F.coalesce("issue", F.lit("")) == "", F.col("_r")).otherwise(F.col("issue"))
    return held.withColumns(
        {
            "issue": F.when(bad & ~F.contains(F.lower(issue), F.col("_r")), F.concat(F.col("_r"), F.lit("; "), issue)).when(bad, issue).otherwise(F.col("issue")),
            "accuracy": F.when(bad, F.least("accuracy", F.lit(0.1))).otherwise(F.col("accuracy")),
            "style_match": F.when(bad, F.least("style_match", F.lit(CAP))).otherwise(F.col("style_match")),
            "meta_leak": bad | F.col("meta_leak"),
        }
    ).drop("_r")


def mean_score() -> Column:
    return mean_of(F.col("accuracy"), F.col("style_match"))


def passes(bar: float) -> Column:
    """JDG-11."""
    return ~F.col("skipped") & ~F.col("meta_leak") & (mean_score() >= F.lit(min(max(bar, 0.0), 1.0)))


def _in_order(value: Column, order: Column, keep: Column) -> Column:
    """Distinct values in the order of ``order``, from an aggregate of a few rows a group."""
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def panel(scores: DataFrame) -> DataFrame:
    """AGG-1: one row for each task and style over its judges; all styles appear.

    Scores are whole thousandths, and Spark's exact median keeps a count for each value, so its state is a map of at most 1,001 counts that is merged where the
    rows are. Issues of a group are gathered.
    """
    active = ~F.col("skipped")
    by = scores.groupBy("task_id", "style").agg(
        F.bround(F.median(F.when(active, F.round("accuracy", 3))), 3).alias("a"),
        F.bround(F.median(F.when(active, F.round("style_match", 3))), 3).alias("m"),
        F.coalesce(F.bool_or(F.when(active, F.col("meta_leak"))), F.lit(False)).alias("leak"),
        F.count_if(active).alias("n"),
        F.substring(F.array_join(_in_order(F.col("issue"), F.col("judge_order"), active & (F.col("issue") != "")), "; "), 1, 240).alias("issues"),
        F.min(F.when(~active & (F.col("skip_reason") != ""), F.struct("judge_order", "skip_reason")))["skip_reason"].alias("why"),
    )
    every = scores.select("task_id").distinct().withColumn("style", F.explode(F.array(*map(F.lit, STYLES))))
    full = every.join(by, ["task_id", "style"], "left")
    skipped = F.coalesce(F.col("n"), F.lit(0)) == 0
    reason = F.when(skipped, F.coalesce("why", F.lit("judge-missing-style"))).otherwise("")
    leak = ~skipped & F.coalesce("leak", F.lit(False))
    return full.select(
        "task_id",
        "style",
        F.when(skipped, 0.0).otherwise(leak_cap(F.col("a"), leak)).alias("accuracy"),
        F.when(skipped, 0.0).otherwise(leak_cap(F.col("m"), leak)).alias("style_match"),
        F.when(skipped, reason).when(leak & (F.col("issues") == ""), "meta-leak").otherwise(F.col("issues")).alias("issue"),
        leak.alias("meta_leak"),
        skipped.alias("skipped"),
        reason.alias("skip_reason"),
    )


def clip_panel(clips: DataFrame) -> DataFrame:
    """AGG-2: median of the distinctness that isn't zero, first note, distinct parse errors, by task."""
    return clips.groupBy("task_id").agg(
        F.coalesce(F.bround(F.median(F.nullif("distinctness", F.lit(0.0))), 3), F.lit(0.0)).alias("distinctness"),
        F.coalesce(F.min(F.when(F.col("note") != "", F.struct("judge_order", "note")))["note"], F.lit("")).alias("note"),
        F.array_join(_in_order(F.col("parse_error"), F.col("judge_order"), F.col("parse_error") != ""), "; ").alias("parse_error"),
    )


def totals(scores: DataFrame, bar: float, *by: str) -> DataFrame:
    """AGG-3, and AGG-4 with ``by='judge_model'``: passes, captions, and means over those that aren't skipped."""
    live = lambda c: F.bround(F.avg(F.when(~F.col("skipped"), c)), 3)
    return scores.groupBy(*by).agg(
        F.count_if(passes(bar)).alias("passes"), F.count("*").alias("total"), live(mean_score()).alias("mean"), live(F.col("accuracy")).alias("mean_accuracy"), live(F.col("style_match")).alias("mean_style_match")
    )


def vision_panel(members: DataFrame, settings: Settings) -> DataFrame:
    """AGG-5: mean accuracy and confidence of the parsed members, their disagreement, issues, failed members, and whether the panel is usable."""
    ok = F.col("parse_error") == ""
    by = members.groupBy("task_id", "style").agg(
        F.bround(F.avg(F.when(ok, F.col("accuracy"))), 3).alias("accuracy"),
        F.bround(F.avg(F.when(ok, F.col("confidence"))), 3).alias("confidence"),
        F.bround(F.max(F.when(ok, F.col("accuracy"))) - F.min(F.when(ok, F.col("accuracy"))), 3).alias("disagreement"),
        F.array_join(_in_order(F.col("issue"), F.col("judge_order"), ok & (F.col("issue") != "")), " | ").alias("issue"),
        F.count_if(ok).alias("n_ok"),
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~ok, F.struct("judge_order", "parse_error")))), lambda x: x["parse_error"]), ",").alias("failed"),
        F.min(F.struct("judge_order", "parse_error"))["parse_error"].alias("first_error"),
    )
    error = F.when(F.col("n_ok") == 0, F.col("first_error")).when(F.col("n_ok") < F.col("n"), F.concat(F.lit("PartialPanel:"), "failed")).otherwise("")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    usable = (F.col("n_ok") == F.col("n")) & (F.col("confidence") >= settings.vision_confidence) & (F.col("disagreement") <= settings.vision_disagreement)
    return by.select("task_id", "style", zero("accuracy"), zero("confidence"), zero("disagreement"), "issue", error.alias("parse_error"), F.coalesce(usable, F.lit(False)).alias("usable"))


def passing_styles(scores: DataFrame, bar: float) -> DataFrame:
    """AGG-7."""
    return scores.groupBy("task_id").agg(F.count_if(passes(bar)).alias("passing"), F.count("*").alias("styles"))


def in_file_order(scores: DataFrame) -> list[Column]:
    """The order of a results file: clips as they come (clip_index if it is there, else task_id), styles as they are listed."""
    return [F.col("clip_index" if "clip_index" in scores.columns else "task_id"), F.array_position(F.array(*map(F.lit, STYLES)), F.col("style"))]


def calibration_sample(scores: DataFrame, settings: Settings) -> DataFrame:
    """TOP-1: the captions nearest to the bar, for people to check; ties in the order of the file."""
    bar = min(max(settings.judge_min_score, 0.0), 1.0)
    low = F.least("accuracy", "style_match")
    near = (F.abs(low - bar) <= settings.calibration_margin) | (F.abs(mean_score() - bar) <= settings.calibration_margin)
    distance = F.abs(low - bar) + F.abs(mean_score() - bar) * 0.25 - F.when(passes(bar), 0.0).otherwise(0.05)
    kept = scores.where(~F.col("skipped") & near).withColumns({"passed": passes(bar), "distance": F.bround(distance, 6)})
    return kept.orderBy("distance", *in_file_order(scores)).limit(settings.calibration_rows)


def weakest_first(scores: DataFrame) -> DataFrame:
    """TOP-2: with mean and position from 1: the weakest first, skipped captions last, ties in the order of the file.

    The order is global by range partitions, and positions count on from the ranges before, so no task sees all rows.
    """
    held = F.when(F.col("skipped"), 0.0).otherwise(mean_score())
    ranked = with_position(scores.withColumn("_mean", held), [F.col("skipped").asc(), F.col("_mean").asc(), *in_file_order(scores)], "position")
    return ranked.withColumn("mean", mean_score()).drop("_mean")


def low_distinctness(clips: DataFrame, settings: Settings) -> DataFrame:
    """TOP-3."""
    return clips.where((F.col("distinctness") > 0) & (F.col("distinctness") < settings.distinctness_warning)).orderBy("task_id")


def failure_report(scores: DataFrame, bar: float) -> DataFrame:
    """TOP-4: failing captions with their weak dimensions and leak note."""
    weak = F.concat_ws(", ", F.when(F.col("accuracy") < bar, "accuracy"), F.when(F.col("style_match") < bar, "style_match"), F.when(F.col("meta_leak"), "meta-leak"))
    return scores.where(~F.col("skipped") & ~passes(bar)).withColumn("weak", weak)


def failing(scores: DataFrame, settings: Settings) -> Column:
    """Whether a judged score fails: skipped, not passing, or below a floor."""
    return F.col("skipped") | ~passes(settings.judge_min_score) | (mean_score() < settings.quality_floor) | (F.col("accuracy") < settings.accuracy_floor) | (F.col("style_match") < settings.style_floor)


def failures(scores: DataFrame, captions: DataFrame, rules: RuleBook, settings: Settings) -> DataFrame:
    """SET-1: (task_id, style) that a judge or a rule fails, distinct."""
    judged = scores.where(failing(scores, settings)).select("task_id", "style")
    ruled = captions.where(rules_of.score_reason(F.col("text"), F.col("style"), rules) != "ok").select("task_id", "style")
    return judged.unionByName(ruled).dropDuplicates(["task_id", "style"])


def merge_vision(scores: DataFrame, vision: DataFrame, settings: Settings) -> DataFrame:
    """JON-5: accuracy from the vision judge where it parsed, is confident, is lower and below the demote bar; style stays, the leak flag is reset.

    Skipped captions stay as they are, and blank ones if ``scores`` has their text.
    """
    v = vision.select("task_id", "style", F.col("accuracy").alias("_va"), F.col("issue").alias("_vi"), F.col("usable").alias("_u"))
    joined = scores.join(v, ["task_id", "style"], "left")
    seen = trimmed(F.coalesce("text", F.lit(""))) != "" if "text" in scores.columns else F.lit(True)
    low = ~F.col("skipped") & seen & F.coalesce(F.col("_u") & (F.col("_va") < F.col("accuracy")) & (F.col("_va") < settings.vision_demote), F.lit(False))
    note = F.coalesce(F.nullif("_vi", F.lit("")), F.lit("vision accuracy below text accuracy"))
    issue = F.concat_ws("; ", F.nullif("issue", F.lit("")), F.concat(F.lit("vision: "), note))
    merged = joined.withColumns({"_low": low, "issue": F.when(low, issue).otherwise(F.col("issue")), "meta_leak": ~low & F.col("meta_leak"), "accuracy": F.when(low, F.col("_va")).otherwise(F.col("accuracy"))})
    return merged.withColumnRenamed("_low", "demoted").drop("_va", "_vi", "_u")


def resolve_attempts(attempts: DataFrame, no_retry: tuple[str, ...] = ("auth", "refused")) -> DataFrame:
    """WIN-3: of each (task_id, role) the first success, else the last attempt; attempts after a reason that forbids another are ignored.

    A success after earlier failures is kept. A last attempt that was cut (`Truncated`) but still parses counts as a success.
    """
    w = Window.partitionBy("task_id", "role")
    stop = F.min(F.when(F.col("error").isin(*no_retry), F.col("attempt"))).over(w)
    live = attempts.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
    last = F.max("attempt").over(w)
    ok = (F.col("error") == "") | ((F.col("error") == "Truncated") & (F.col("attempt") == last) & F.col("parses"))
    order = Window.partitionBy("task_id", "role").orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
    return live.withColumn("ok", ok).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_stop")


def keep_best(rounds: DataFrame, settings: Settings, most: int = 2, rules: RuleBook | None = None) -> DataFrame:
    """WIN-4: of each (task_id, style) the caption that stands after at most ``most`` retry rounds.

    Round 0 is the first caption. A later round replaces the best if the best is skipped, if its mean is higher, or if it no longer fails; a skipped
    round is ignored; nothing changes once the best doesn't fail. With ``rules``, a text that breaks a rule fails too, against its facts if ``rounds`` has them.
    The fold runs over an array of at most ``most`` + 1 rows.
    """
    fails = failing(rounds, settings)
    if rules is not None:
        fails = fails | (rules_of.score_reason(F.col("text"), F.col("style"), rules, F.col("facts") if "facts" in rounds.columns else None) != "ok")
    item = F.struct("round", mean_score().alias("mean"), fails.alias("fails"), "skipped", "accuracy", "style_match")
    kept = rounds.where(F.col("round") <= most).groupBy("task_id", "style").agg(F.array_sort(F.collect_list(item)).alias("r"))

    def step(best: Column, new: Column) -> Column:
        better = best["skipped"] | (new["mean"] > best["mean"]) | ~new["fails"]
        return F.when(best["fails"] & ~new["skipped"] & better, new).otherwise(best)

    best = F.aggregate(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.get("r", F.lit(0)), step)
    return kept.select("task_id", "style", best.alias("b")).select("task_id", "style", "b.round", "b.mean", "b.fails", "b.accuracy", "b.style_match")


#: Parts of an issue that tell of an unfinished caption or another scene.
WRONG_SCENE = ("scene", "wrong subject", "incomplete", "describe", "meta")


def feedback(df: DataFrame) -> Column:
    """MSG-3: what a retry is told: that the caption was unfinished or about another scene, or its scores and their mean; with the issue, or why it was skipped."""
    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    issue = F.coalesce(given("issue"), given("skip_reason"), F.lit("below the bar for accuracy or style"))
    wrong = F.col("meta_leak") | F.lower(issue).rlike(alternation(WRONG_SCENE))
    told = F.concat(F.lit("The last caption was unfinished, held notes or was about another scene (issue: "), issue, F.lit("). Write one finished caption of one or two sentences about the primary subject, from the facts alone."))
    scored = F.format_string("The last caption scored accuracy %.2f and style %.2f (mean %.2f). Issue: %s. Rewrite it from the facts alone and keep its style.", F.col("accuracy"), F.col("style_match"), mean_score(), issue)
    return F.when(wrong, told).otherwise(scored)
