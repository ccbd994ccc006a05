"""The jobs' inputs, derived from the given tables; for each the same rows as DuckDB SQL.

The generated prose holds few of the default phrases, so the queries run with rule phrases that do occur in it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STYLES, RuleBook, Settings
from ..operators.text_rules import EMPTY_COLON, LIST_LINE, OPEN_END, TALLY

RULES = RuleBook(
    drafting_prefixes=("the ", "la ", "er "),
    drafting_markers=("thth", "queque", "schsch"),
    field_labels=("in ", "an ", "de la ", "und der ", " of the "),
    leak_prefixes=("et ", "of ", "th", "el"),
    leak_markers=(" is ", " des ", " der ", " del "),
    score_leak_markers=(" at ", " un ", " ein ", " su "),
    score_leak_prefixes=("re", "au"),
    neutral_prefixes=("an", "en"),
    evaluative_tails=("as", "in", "la", "der"),
    fragment_tails=("the", "of", "le", "und", "que", "it"),
    fragment_sentences=("an", "on", "de", "er"),
    dangling_endings=("in the", "de la"),
    cut_stems=("ther", "ing", "tion", "keit", "ado"),
    label_prefixes=("is ", "es ", "ch "),
    entities=("ing", "tion", "ble", "keit", "aux", "rea", "hea"),
    synonyms={"ing": ("tion", "ble"), "aux": ("eau",), "keit": ("ung",)},
    content_stopwords=("the", "and", "that", "und", "der", "que", "les"),
    grounding_stopwords=("the", "and", "with", "setting", "actions", "primary", "subject"),
    action_verbs=("ing", "ent", "tion", "ble", "aux", "mente"),
    tech_words=("that", "und", "que", "est", "not"),
    tech_not_jargon=("not",),
    word_limits={"formal": 58, "humorous_non_tech": 90, "sarcastic": 120, "humorous_tech": 150},
)
SETTINGS = Settings(judge_min_score=0.5, quality_floor=0.5, accuracy_floor=0.3, style_floor=0.2, similarity_warning=0.1, tie_margin=8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _style(index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, STYLES)), (index % 4 + 1).cast("int"))


STYLE_LIST = "[" + ", ".join(f"'{s}'" for s in STYLES) + "]"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: assistant turns."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select(F.col("conv_id").alias("task_id"), _style(F.col("turn")).alias("style"), F.col("turn").alias("pool_index"), "text")


CAPTIONS = f"SELECT conv_id AS task_id, {STYLE_LIST}[(turn % 4 + 1)::INT] AS style, turn AS pool_index, text FROM conversations WHERE role = 'assistant'"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene facts of a task: its first turn as subject and setting, its last as action; no turn is gathered."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'assistant'")
    ends = turns.groupBy(F.col("conv_id").alias("task_id")).agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    subject = F.regexp_extract(flat("a"), r"^(\S+ ?\S* ?\S*)", 1)
    return ends.select("task_id", F.concat(F.lit("Primary subject: "), subject, F.lit("\nSetting: "), flat("a"), F.lit("\nActions (early): "), flat("b")).alias("text"))


FACTS = r"""
SELECT task_id, 'Primary subject: ' || regexp_extract(a, '^(\S+ ?\S* ?\S*)', 1) || chr(10) || 'Setting: ' || a || chr(10) || 'Actions (early): ' || b AS facts
FROM (SELECT conv_id AS task_id, regexp_replace(min_by(text, turn), '\s+', ' ', 'g') AS a, regexp_replace(max_by(text, turn), '\s+', ' ', 'g') AS b
      FROM conversations WHERE role <> 'assistant' GROUP BY 1)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge scores: events of a user, an event type each style, `error` events skipped; two decimals."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    skipped = F.col("event_type") == "error"
    return e.select(
        "event_id",
        F.col("user_id").alias("task_id"),
        _style(kind).alias("style"),
        F.concat(F.lit("judge"), (F.col("event_id") % 3).cast("string")).alias("judge_model"),
        F.col("event_id").alias("judge_order"),
        (F.least(F.floor(F.col("value") / 5), F.lit(100)) / 100).alias("accuracy"),
        ((F.col("event_id") * 37) % 101 / 100).alias("style_match"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("issue "), (F.col("event_id") % 7).cast("string"))).otherwise("").alias("issue"),
        (F.col("event_id") % 97 == 0).alias("meta_leak"),
        skipped.alias("skipped"),
        F.when(skipped, F.when(F.col("event_id") % 2 == 0, "empty").otherwise("incomplete")).otherwise("").alias("skip_reason"),
    )


SCORES = f"""
SELECT event_id, user_id AS task_id, {STYLE_LIST}[CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END] AS style,
  'judge' || (event_id % 3)::VARCHAR AS judge_model, event_id AS judge_order, least(floor(value / 5), 100)::DOUBLE / 100 AS accuracy,
  ((event_id * 37) % 101)::DOUBLE / 100 AS style_match, CASE WHEN event_id % 4 = 0 THEN 'issue ' || (event_id % 7)::VARCHAR ELSE '' END AS issue,
  event_id % 97 = 0 AS meta_leak, event_type = 'error' AS skipped,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'empty' ELSE 'incomplete' END ELSE '' END AS skip_reason
FROM events"""
#: Mean of a score, and whether it passes and fails, in SQL.
MEAN = "round_even(CAST((accuracy * 1000 + style_match * 1000) AS DECIMAL(18, 3)) / 2, 0)::DOUBLE / 1000"
PASSES = f"(NOT skipped AND NOT meta_leak AND {MEAN} >= {SETTINGS.judge_min_score})"
FAILS = f"(skipped OR NOT {PASSES} OR accuracy < {SETTINGS.accuracy_floor} OR style_match < {SETTINGS.style_floor})"


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry rounds: the events of each (user, style) in order; round 0 is the first."""
    from pyspark.sql import Window

    s = scores(spark, sf_dir)
    w = Window.partitionBy("task_id", "style").orderBy("event_id")
    return s.withColumn("round", F.row_number().over(w) - 1)


ROUNDS = f"SELECT *, row_number() OVER (PARTITION BY task_id, style ORDER BY event_id) - 1 AS round FROM ({SCORES})"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies as JSON, every fifth cut before its end, every eleventh without one score, every thirteenth out of range."""
    s = scores(spark, sf_dir)
    match = F.when(F.col("event_id") % 13 == 0, F.lit("1.5")).otherwise(F.format_string("%.2f", "style_match"))
    key = F.when(F.col("event_id") % 3 == 0, "style_fit").otherwise("style_match")
    raw = F.concat(
        F.lit('{"accuracy": '), F.format_string("%.2f", "accuracy"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit(', "'), key, F.lit('": '), match)),
        F.lit(', "meta_leak": '), F.col("meta_leak").cast("string"), F.lit(', "issue": "'), F.col("issue"), F.lit('"}'),
    )
    return s.select("event_id", "task_id", "style", F.when(F.col("event_id") % 5 == 0, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(raw).alias("raw"))


REPLIES = f"""
SELECT event_id, task_id, style, CASE WHEN event_id % 5 = 0 THEN left(raw, length(raw) - 1) ELSE raw END AS raw FROM (
  SELECT *, '{{"accuracy": ' || printf('%.2f', accuracy) || CASE WHEN event_id % 11 = 0 THEN '' ELSE ', "' || CASE WHEN event_id % 3 = 0 THEN 'style_fit' ELSE 'style_match' END || '": '
    || CASE WHEN event_id % 13 = 0 THEN '1.5' ELSE printf('%.2f', style_match) END END || ', "meta_leak": ' || CASE WHEN meta_leak THEN 'true' ELSE 'false' END || ', "issue": "' || issue || '"}}' AS raw
  FROM ({SCORES}))"""


# --- the text rules in SQL -------------------------------------------------------------------------------------------


def any_of(phrases) -> str:
    return "|".join(re.escape(p).replace("'", "''").replace("\\ ", " ") for p in phrases)


def _hits(col: str, phrases) -> str:
    return " + ".join(f"contains({col}, '{p}')::INT" for p in phrases)


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"(CASE WHEN {trim_sql(x)} = '' THEN 0 ELSE len(regexp_split_to_array({trim_sql(x)}, '\s+')) END)"


def split_sentences(x: str) -> str:
    """TXT-1 in SQL."""
    return rf"""list_transform(list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: {trim_sql("s")}), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END)"""


L = r"[^\p{L}\p{N}_]"


def judged(source: str, rules: RuleBook = RULES) -> str:
    """CTEs after which ``r`` has, for each row of ``source`` (text, style, ...), the flags and reasons of the text rules."""
    r = rules
    jargon = [w for w in r.tech_words if w not in r.tech_not_jargon]
    limit = "CASE style " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in r.word_limits.items()) + f" ELSE {r.default_word_limit} END"
    dangling = rf"(regexp_matches(t, '{OPEN_END}') OR regexp_matches(low, '(?:^|{L})(?:{any_of(r.dangling_endings)})\s*\.$'))"
    return rf"""
WITH c AS ({source}),
b AS (SELECT *, {trim_sql("coalesce(text, '')")} AS t, coalesce(text, '') AS x FROM c),
p AS (SELECT *, lower(t) AS low, lower(x) AS xlow, {split_sentences("t")} AS parts FROM b),
q AS (SELECT *, len(parts) AS n_parts, coalesce(parts[len(parts)], '') AS lastp, regexp_replace(coalesce(parts[len(parts)], ''), '[.!?"'')]+$', '') AS bare, {words_sql("x")} AS n_words FROM p),
f AS (SELECT *,
  t <> '' AND (regexp_matches(low, '^(?:{any_of(r.field_labels)})') OR {_hits("low", r.field_labels)} >= 2) AS dump,
  t <> '' AND (NOT regexp_matches(t, '[.!?"'')]$') OR n_parts = 0 OR (n_parts = 1 AND {words_sql("parts[1]")} < 8) OR {dangling} OR {words_sql("bare")} = 0
    OR ({words_sql("bare")} = 1 AND regexp_replace(lower({trim_sql("bare")}), '^["'']+|["'']+$', '', 'g') IN ({", ".join(f"'{w}'" for w in r.fragment_sentences)}))
    OR regexp_replace(lower(regexp_extract(bare, '(\S+)\s*$', 1)), '[^a-z0-9'']+', '', 'g') IN ('', {", ".join(f"'{w}'" for w in r.cut_stems)})) AS cut,
  t <> '' AND (regexp_matches(low, '^(?:{any_of(r.drafting_prefixes)})') OR regexp_matches(low, '{any_of(r.drafting_markers)}')
    OR regexp_matches(t, '{LIST_LINE}') OR len(regexp_extract_all(t, '{TALLY}')) >= 2 OR {dangling}
    OR (length(t) - length(replace(t, '"', ''))) % 2 = 1 OR regexp_matches(t, '{EMPTY_COLON}')
    OR {_hits("low", r.checklist_tags)} >= 2 OR regexp_matches(low, '[.!?]["'']?\s+(?:{any_of(r.evaluative_tails)})\s*[.!?]?$')
    OR (n_parts > 0 AND (regexp_matches(regexp_replace(lower(lastp), '[.!?]+$', ''), '(?:^|{L})(?:{any_of(r.fragment_tails)})$')
      OR regexp_replace(lower(lastp), '[.!?]+$', '') IN ({", ".join(f"'{w}'" for w in r.evaluative_tails)})
      OR (n_parts >= 2 AND {words_sql("lastp")} <= 3 AND regexp_matches(lower(lastp), '^(?:the|and|but|or|a|an) '))))) AS draft,
  regexp_matches(low, '^(?:{any_of(r.leak_prefixes)})') OR {_hits("low", r.leak_markers)} >= 2 AS leak FROM q),
h AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN dump THEN 'describe-dump' WHEN draft THEN 'meta-leak' WHEN cut THEN 'incomplete' ELSE '' END AS hard FROM f),
r AS (SELECT *,
  CASE WHEN t = '' THEN 'EmptyResponse' WHEN hard = 'meta-leak' THEN 'MetaLeak' WHEN hard = 'describe-dump' THEN 'DescribeDump' WHEN hard = 'incomplete' THEN 'Incomplete'
    WHEN leak THEN 'MetaLeak' WHEN n_words < 5 THEN 'TooShort' WHEN n_words > {limit} THEN 'TooLong' WHEN x <> '' AND NOT regexp_matches(x, '[.!?)"]\z') THEN 'Truncated' ELSE '' END AS bad,
  CASE WHEN t = '' THEN 'empty' WHEN xlow LIKE 'failed to%' THEN 'error' WHEN xlow LIKE 'video caption (%' THEN 'placeholder' ELSE hard END AS structural,
  CASE WHEN t = '' THEN 'empty' WHEN xlow LIKE 'failed to%' THEN 'error' WHEN xlow LIKE 'video caption (%' THEN 'placeholder' WHEN hard <> '' THEN hard
    WHEN regexp_matches(xlow, '^(?:{any_of(r.neutral_prefixes)})') THEN 'neutral-copy' WHEN {_hits("xlow", r.score_leak_markers)} >= 2 THEN 'meta-leak'
    WHEN regexp_matches(xlow, '^(?:{any_of(r.score_leak_prefixes)})') THEN 'meta-leak' WHEN NOT regexp_matches(x, '[.!?)"'']\z') THEN 'truncated' WHEN n_words < 5 THEN 'too-short'
    WHEN n_words > {limit} THEN 'too-long' WHEN style = 'humorous_tech' AND NOT regexp_matches(xlow, '(?:^|{L})(?:{any_of(r.tech_words)})(?:$|{L})') THEN 'no-tech-joke'
    WHEN style = 'humorous_non_tech' AND regexp_matches(xlow, '(?:^|{L})(?:{any_of(jargon)})(?:$|{L})') THEN 'tech-jargon' ELSE 'ok' END AS score_reason FROM h)"""


def sql_tokens(x: str, pattern: str, stop=()) -> str:
    dropped = f" AND k NOT IN ({', '.join(repr(w) for w in stop)})" if stop else ""
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '{pattern}'), lambda k: length(k) > 2{dropped})))"
