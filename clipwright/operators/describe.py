"""Scene descriptions: cutting out, validating and formatting the JSON object (DSC), quality of a description, and issues of a reply (TXT-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import chain, let, size0, trimmed, word_count
from .judging import json_object, json_text
from .text_rules import truncated

SCHEMA = (
    "struct<subjects: array<struct<name: string, colors: array<string>, distinguishing: array<string>>>, setting: string, actions_early: string, "
    "actions_late: string, background: string, camera: string, notable_moments: array<string>, on_screen_text: array<string>, ocr: array<string>, readable_text: array<string>>"
)
#: Parts of a setting, and the subject that stands for a scene with one of them; the first that occurs counts.
SCENERY = {
    "park": "park scene", "beach": "coastal scene", "coast": "coastal scene", "shore": "coastal scene", "coastline": "coastal scene", "ocean": "ocean scene", "sea": "ocean scene", "waves": "ocean scene",
    "office": "office scene", "meadow": "meadow scene", "field": "meadow scene", "garden": "garden scene",
}


def _text(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit("")))


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _text), lambda x: x != "")


def fallback_subject(setting: Column) -> Column:
    """DSC-3: a subject from the setting alone: by its scenery, else at most four words of its first clause, without `outdoor` and `indoor`, and `scene`."""
    low = F.lower(trimmed(setting))
    known = F.when(F.lit(False), "")
    for part, name in SCENERY.items():
        known = known.when(low.contains(part), name)
    clause = trimmed(F.split_part(setting, F.lit(","), F.lit(1)))
    clause = trimmed(F.regexp_replace(F.regexp_replace(clause, "(?i)^outdoor ", ""), r"(?i)^\s*indoor ", ""))
    start = F.array_join(F.slice(F.filter(F.split(clause, r"\s+"), lambda w: w != ""), 1, 4), " ")
    said = F.when(start == "", "scene").otherwise(start)
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(known, F.when(F.lower(said).contains("scene"), said).otherwise(F.concat(said, F.lit(" scene")))).alias("name"), none.alias("colors"), none.alias("distinguishing"))


def parse_description(raw: Column) -> Column:
    """DSC-2: struct(ok, reason, d). Null counts as missing, of repeated keys the last counts; subjects must be a list of objects; unnamed subjects go."""

    def read(x: Column) -> Column:
        text, d = x["text"], x["d"]
        listed = d["subjects"].isNotNull() & ~F.exists(d["subjects"], lambda s: s.isNull())
        need = (_text(d["setting"]) != "") & (_text(d["actions_early"]) != "") & (_text(d["actions_late"]) != "")
        reason = F.when(text == "", "EmptyResponse").when(F.coalesce(d.isNull() | ~need | ~listed, F.lit(True)), "InvalidJSON").otherwise("")
        return let(F.struct(reason.alias("reason"), d.alias("d")), tidied)

    def tidied(x: Column) -> Column:
        d = x["d"]
        tidy = F.transform(d["subjects"], lambda s: F.struct(_text(s["name"]).alias("name"), _list(s["colors"]).alias("colors"), _list(s["distinguishing"]).alias("distinguishing")))
        fallback = F.array(fallback_subject(_text(d["setting"])))
        subjects = let(F.filter(tidy, lambda s: s["name"] != ""), lambda named: F.when(size0(named) > 0, named).otherwise(fallback))
        first = lambda a, b: let(_list(a), lambda found: F.when(size0(found) > 0, found).otherwise(b))
        whole = F.struct(
            subjects.alias("subjects"),
            *[_text(d[k]).alias(k) for k in ("setting", "actions_early", "actions_late", "background", "camera")],
            _list(d["notable_moments"]).alias("notable_moments"),
            first(d["on_screen_text"], first(d["ocr"], _list(d["readable_text"]))).alias("on_screen_text"),
        )
        return F.struct((x["reason"] == "").alias("ok"), x["reason"].alias("reason"), F.when(x["reason"] == "", whole).alias("d"))

    return let(json_text(raw), lambda t: let(F.struct(t.alias("text"), json_object(t, SCHEMA).alias("d")), read))


def format_description(d: Column) -> Column:
    """DSC-4: the description as labelled lines, the primary subject first."""

    def subject(s: Column, i: Column) -> Column:
        return F.concat(
            F.when(i == 0, "Primary subject").otherwise(F.concat(F.lit("Subject "), (i + 1).cast("string"))),
            F.lit(": "),
            s["name"],
            F.when(F.size(s["colors"]) > 0, F.concat(F.lit(" (colors: "), F.array_join(s["colors"], ", "), F.lit(")"))).otherwise(""),
            F.when(F.size(s["distinguishing"]) > 0, F.concat(F.lit(" ["), F.array_join(s["distinguishing"], ", "), F.lit("]"))).otherwise(""),
        )

    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(
        "\n",
        F.array_join(F.transform(d["subjects"], subject), "\n"),
        F.concat(F.lit("Setting: "), d["setting"]),
        F.concat(F.lit("Actions (early): "), d["actions_early"]),
        F.concat(F.lit("Actions (late): "), d["actions_late"]),
        line("Camera", d["camera"]),
        line("Background", d["background"]),
        line("On-screen text", F.array_join(d["on_screen_text"], "; ")),
        line("Notable moments", F.array_join(d["notable_moments"], "; ")),
        F.when(d.isNotNull(), "Caption focus: the primary subject leads, other subjects and the background follow."),
    )


def description_quality(d: Column, duration_s: Column, settings: Settings) -> Column:
    """DSC-5: the first weakness of a valid description, or the empty text; the last two only for long clips."""
    early, late = F.lower(d["actions_early"]), F.lower(d["actions_late"])
    a, b = F.array_distinct(F.split(early, r"\s+")), F.array_distinct(F.split(late, r"\s+"))
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    long_clip = F.coalesce(duration_s, F.lit(0.0)) >= settings.short_clip_s
    return chain(
        (word_count(d["setting"]) < settings.min_setting_words, "WeakSetting"),
        (word_count(d["actions_early"]) < settings.min_action_words, "WeakActionsEarly"),
        (word_count(d["actions_late"]) < settings.min_action_words, "WeakActionsLate"),
        (early == late, "StaticActions"),
        (long_clip & (F.size(d["notable_moments"]) == 0) & (apart < 2), "WeakLongClipActions"),
        (long_clip & (d["background"] == ""), "MissingBackground"),
    )


def reply_issue(raw: Column, finish_reason: Column, duration_s: Column, settings: Settings, prose: bool = False) -> Column:
    """TXT-14: what is wrong with a describing reply, or the empty text; prose is checked for truncation only."""
    blank = trimmed(F.coalesce(raw, F.lit(""))) == ""
    if prose:
        return F.when(blank, "EmptyResponse").when(truncated(F.coalesce(raw, F.lit("")), finish_reason), "Truncated").otherwise("")
    cut = F.coalesce(finish_reason == "length", F.lit(False))
    return let(
        parse_description(raw),
        lambda parsed: F.when(blank, "EmptyResponse")
        .when(cut & ~parsed["ok"], "Truncated")
        .when(~parsed["ok"], parsed["reason"])
        .otherwise(description_quality(parsed["d"], duration_s, settings)),
    )
