"""Queries on judge replies and scores: parsing, panels, reports, failures, rounds, vision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judging as op
from ..operators.tasks import vision_targets
from ..sources.tables import nested_report, report_header
from .derived import CAPTIONS, FAILS, MEAN, PASSES, REPLIES, ROUNDS, RULES, SCORES, SETTINGS, STYLE_LIST, captions, judged, replies, rounds, scores, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BAR = SETTINGS.judge_min_score


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query(
    "jdg_1_unit_score",
    "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 1.0 WHEN event_id % 6 = 1 THEN 0.0 WHEN event_id % 6 = 2 THEN NULL WHEN value / 100 BETWEEN 0 AND 1 THEN round(value / 100, 3) END::DOUBLE AS score "
    "FROM (SELECT event_id, round(value, 1) AS value FROM events)",
)
def jdg_1(spark: SparkSession, d: str) -> DataFrame:
    """Values as numbers, booleans and words."""
    n = F.col("event_id") % 6
    x = F.when(n == 0, "true").when(n == 1, " False ").when(n == 2, "high").otherwise((F.round("value", 1) / 100).cast("string"))
    return table(spark, d, "events").select("event_id", op.unit_score(x).alias("score"))


@query(
    "jdg_3_batch_reply",
    f"""SELECT event_id, style, CASE WHEN reason = '' THEN CASE WHEN leak THEN least(a, 0.2) ELSE a END ELSE 0 END AS accuracy, reason AS skip_reason
FROM (SELECT event_id, unnest({STYLE_LIST}) AS style, user_id, value FROM events) e
CROSS JOIN LATERAL (SELECT (event_id % 100)::DOUBLE / 100 AS a, event_id % 17 = 0 AS leak,
  CASE WHEN style IN ('sarcastic', 'humorous_tech') THEN 'judge-missing-style' WHEN style = 'humorous_non_tech' AND event_id % 7 = 0 THEN 'judge-invalid-scores' ELSE '' END AS reason)""",
)
def jdg_3(spark: SparkSession, d: str) -> DataFrame:
    """Batch replies made of events: two of four styles answered, one of them now and then out of range."""
    e = table(spark, d, "events")
    leak = (F.col("event_id") % 17 == 0).cast("string")
    entry = lambda style, bad: F.concat(
        F.lit(f'"{style}": {{"accuracy": '), F.format_string("%.2f", F.col("event_id") % 100 / 100), F.lit(', "style_match": '), F.when(bad, "4").otherwise("0.5"), F.lit(', "meta_leak": '), leak, F.lit("}")
    )
    raw = F.concat(F.lit('```json\n{"captions": {'), entry("formal", F.lit(False)), F.lit(", "), entry("humorous_non_tech", F.col("event_id") % 7 == 0), F.lit('}, "cross_style_distinctness": 0.7}\n```'))
    return op.parse_batch_reply(e.select("event_id", raw.alias("raw"))).select("event_id", "style", "accuracy", "skip_reason")


@query(
    "jdg_4_style_reply",
    f"""WITH r AS ({REPLIES}), s AS (SELECT event_id, accuracy, style_match, issue, meta_leak FROM ({SCORES})),
k AS (SELECT s.*, event_id % 11 = 0 AS lacks, event_id % 13 = 0 AS wrong, event_id % 5 = 0 AS cut, event_id % 3 = 0 AS old FROM s JOIN r USING (event_id)),
g AS (SELECT *, CASE WHEN lacks AND cut THEN 'InvalidJSON: could not parse judge scores' WHEN lacks OR wrong THEN 'InvalidJSON: scores must be floats in [0, 1]' ELSE '' END AS error FROM k)
SELECT event_id, error, CASE WHEN error = '' THEN CASE WHEN meta_leak THEN least(accuracy, 0.2) ELSE accuracy END END AS accuracy,
  CASE WHEN error = '' THEN CASE WHEN meta_leak THEN least(style_match, 0.2) ELSE style_match END END AS style_match,
  CASE WHEN error = '' THEN CASE WHEN NOT meta_leak THEN issue WHEN issue = '' THEN 'meta-leak' ELSE 'meta-leak; ' || issue END END AS issue FROM g""",
)
def jdg_4(spark: SparkSession, d: str) -> DataFrame:
    return op.parse_style_reply(replies(spark, d)).select("event_id", "error", "accuracy", "style_match", "issue")


@query(
    "jdg_6_distinctness_reply",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE (event_id % 100)::DOUBLE / 100 END AS score, CASE WHEN event_id % 9 = 0 THEN 'InvalidJSON: could not parse distinctness' ELSE '' END AS error FROM events""",
)
def jdg_6(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(F.lit('{"cross_style_distinctness": '), F.format_string("%.2f", F.col("event_id") % 100 / 100), F.lit(', "distinctness_note": "n"}'))
    n = F.col("event_id")
    raw = F.when(n % 9 == 0, "no idea").when(n % 5 == 0, F.concat(F.lit("Here: "), F.substring(whole, F.lit(1), F.length(whole) - 4))).otherwise(whole)
    return table(spark, d, "events").select("event_id", op.parse_distinctness(raw).alias("p")).select("event_id", "p.score", "p.error")


@query(
    "jdg_7_vision_reply",
    f"""SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 0 ELSE a END AS accuracy, CASE WHEN event_id % 8 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE c END AS confidence,
  event_id % 8 <> 0 AND (event_id % 2 = 0 OR c >= {SETTINGS.vision_confidence}) AS usable FROM (SELECT event_id, (event_id % 100)::DOUBLE / 100 AS a, (event_id % 89)::DOUBLE / 100 AS c FROM events)""",
)
def jdg_7(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    conf = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit(', "'), F.when(n % 3 == 0, "conf").otherwise("confidence"), F.lit('": '), F.format_string("%.2f", n % 89 / 100)))
    raw = F.when(n % 8 == 0, "{}").otherwise(F.concat(F.lit('{"accuracy": '), F.format_string("%.2f", n % 100 / 100), conf, F.lit("}")))
    return table(spark, d, "events").select("event_id", op.parse_vision(raw, SETTINGS).alias("p")).select("event_id", "p.accuracy", "p.confidence", "p.usable")


@query(
    "jdg_8_describe_reply",
    """SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round_even(((event_id % 100) * 10 + (event_id % 50) * 20)::DECIMAL(18, 1) / 2, 0)::DOUBLE / 1000 END AS proxy,
  CASE WHEN event_id % 10 = 0 THEN 'InvalidJSON' ELSE '' END AS error FROM events""",
)
def jdg_8(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    raw = F.concat(F.lit('{"faithfulness": '), F.format_string("%.2f", n % 100 / 100), F.lit(', "coverage": '), F.when(n % 10 == 0, "9").otherwise(F.format_string("%.2f", n % 50 * 2 / 100)), F.lit("}"))
    return table(spark, d, "events").select("event_id", op.parse_describe_judge(raw).alias("p")).select("event_id", "p.proxy", "p.error")


R = judged(CAPTIONS)


@query(
    "jdg_9_auto_skip",
    f"{R} SELECT task_id, pool_index, structural <> '' AS skipped, structural AS skip_reason, structural IN ('meta-leak', 'describe-dump', 'incomplete') AS meta_leak FROM r",
)
def jdg_9(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).select("task_id", "pool_index", op.auto_skip(F.col("text"), RULES).alias("s")).select("task_id", "pool_index", "s.*")


@query(
    "jdg_10_clamp",
    f"""{R} SELECT task_id, pool_index, CASE WHEN hard NOT IN ('', 'empty') THEN 0.1 ELSE 0.9 END::DOUBLE AS accuracy, CASE WHEN hard NOT IN ('', 'empty') THEN 0.2 ELSE 0.8 END::DOUBLE AS style_match,
  CASE WHEN hard IN ('', 'empty') OR hard = 'incomplete' THEN 'incomplete now' ELSE hard || '; incomplete now' END AS issue FROM r""",
)
def jdg_10(spark: SparkSession, d: str) -> DataFrame:
    given = {"accuracy": F.lit(0.9), "style_match": F.lit(0.8), "issue": F.lit("incomplete now"), "meta_leak": F.lit(False)}
    return op.clamp(captions(spark, d).withColumns(given), RULES).select("task_id", "pool_index", "accuracy", "style_match", "issue")


@query("jdg_11_pass", f"SELECT event_id, {PASSES} AS passed, {MEAN} AS mean FROM ({SCORES})")
def jdg_11(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("event_id", op.passes(BAR).alias("passed"), op.mean_score().alias("mean"))


PANEL = f"""
WITH s AS ({SCORES}),
a AS (SELECT task_id, style, median((accuracy * 100)::INT) FILTER (WHERE NOT skipped) / 100 AS acc, median((style_match * 100)::INT) FILTER (WHERE NOT skipped) / 100 AS sm,
  coalesce(bool_or(meta_leak) FILTER (WHERE NOT skipped), false) AS leak, count(*) FILTER (WHERE NOT skipped) AS n,
  arg_min(skip_reason, judge_order) FILTER (WHERE skipped AND skip_reason <> '') AS why FROM s GROUP BY 1, 2),
i AS (SELECT task_id, style, left(string_agg(issue, '; ' ORDER BY o), 240) AS issues FROM (SELECT task_id, style, issue, min(judge_order) AS o FROM s WHERE NOT skipped AND issue <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
e AS (SELECT DISTINCT task_id, unnest({STYLE_LIST}) AS style FROM s),
p AS (SELECT e.task_id, e.style, coalesce(n, 0) = 0 AS skipped, acc, sm, coalesce(n, 0) > 0 AND coalesce(leak, false) AS leak, coalesce(issues, '') AS issues, coalesce(why, 'judge-missing-style') AS why
  FROM e LEFT JOIN a USING (task_id, style) LEFT JOIN i USING (task_id, style)),
panel AS (SELECT task_id, style, CASE WHEN skipped THEN 0 WHEN leak THEN least(acc, 0.2) ELSE acc END::DOUBLE AS accuracy, CASE WHEN skipped THEN 0 WHEN leak THEN least(sm, 0.2) ELSE sm END::DOUBLE AS style_match,
  CASE WHEN skipped THEN why WHEN leak AND issues = '' THEN 'meta-leak' ELSE issues END AS issue, leak AS meta_leak, skipped, CASE WHEN skipped THEN why ELSE '' END AS skip_reason FROM p)"""


@query("agg_1_panel", f"{PANEL} SELECT * FROM panel")
def agg_1(spark: SparkSession, d: str) -> DataFrame:
    return op.panel(scores(spark, d))


@query(
    "agg_2_clip_panel",
    """WITH c AS (SELECT user_id AS task_id, event_id AS judge_order, (event_id % 5 * 20)::INT AS d, CASE WHEN event_id % 3 = 0 THEN 'note ' || (event_id % 4)::VARCHAR ELSE '' END AS note,
  CASE WHEN event_id % 50 = 0 THEN 'error ' || (event_id % 3)::VARCHAR ELSE '' END AS parse_error FROM events),
e AS (SELECT task_id, string_agg(parse_error, '; ' ORDER BY o) AS parse_error FROM (SELECT task_id, parse_error, min(judge_order) AS o FROM c WHERE parse_error <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT c.task_id, coalesce(median(d) FILTER (WHERE d > 0) / 100, 0)::DOUBLE AS distinctness, coalesce(arg_min(note, judge_order) FILTER (WHERE note <> ''), '') AS note, coalesce(any_value(e.parse_error), '') AS parse_error
FROM c LEFT JOIN e USING (task_id) GROUP BY 1""",
)
def agg_2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    clips = table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), n.alias("judge_order"), (n % 5 * 20 / 100).alias("distinctness"), F.when(n % 3 == 0, F.concat(F.lit("note "), (n % 4).cast("string"))).otherwise("").alias("note"),
        F.when(n % 50 == 0, F.concat(F.lit("error "), (n % 3).cast("string"))).otherwise("").alias("parse_error"),
    )
    return op.clip_panel(clips)


TOTALS = f"count(*) FILTER (WHERE {PASSES}) AS passes, count(*) AS total, round(avg(CASE WHEN NOT skipped THEN {MEAN} END), 3) AS mean, round(avg(CASE WHEN NOT skipped THEN accuracy END), 3) AS mean_accuracy, round(avg(CASE WHEN NOT skipped THEN style_match END), 3) AS mean_style_match"


@query("agg_3_file_totals", f"SELECT {TOTALS} FROM ({SCORES})")
def agg_3(spark: SparkSession, d: str) -> DataFrame:
    return op.totals(scores(spark, d), BAR)


@query("agg_4_totals_by_judge", f"SELECT judge_model, {TOTALS} FROM ({SCORES}) GROUP BY 1")
def agg_4(spark: SparkSession, d: str) -> DataFrame:
    return op.totals(scores(spark, d), BAR, "judge_model")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Vision judges: the first three scores of each (user, style); every seventh failed to parse."""
    n = F.col("event_id")
    return rounds(spark, d).where("round < 3").select(
        "task_id", "style", F.col("round").alias("judge_order"), "accuracy", F.col("style_match").alias("confidence"), "issue", F.when(n % 7 == 0, F.concat(F.lit("Bad"), (n % 2).cast("string"))).otherwise("").alias("parse_error")
    )


MEMBERS = f"SELECT task_id, style, round AS judge_order, accuracy, style_match AS confidence, issue, CASE WHEN event_id % 7 = 0 THEN 'Bad' || (event_id % 2)::VARCHAR ELSE '' END AS parse_error FROM ({ROUNDS}) WHERE round < 3"
VISION = f"""
WITH vm AS ({MEMBERS}),
vi AS (SELECT task_id, style, string_agg(issue, ' | ' ORDER BY o) AS issue FROM (SELECT task_id, style, issue, min(judge_order) AS o FROM vm WHERE parse_error = '' AND issue <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
vg AS (SELECT task_id, style, sum((accuracy * 100)::INT) FILTER (WHERE parse_error = '') AS sa, sum((confidence * 100)::INT) FILTER (WHERE parse_error = '') AS sc, count(*) FILTER (WHERE parse_error = '') AS n_ok, count(*) AS n,
  max(accuracy) FILTER (WHERE parse_error = '') - min(accuracy) FILTER (WHERE parse_error = '') AS dis, string_agg(parse_error, ',' ORDER BY judge_order) FILTER (WHERE parse_error <> '') AS failed, arg_min(parse_error, judge_order) AS first_error FROM vm GROUP BY 1, 2),
v AS (SELECT task_id, style, coalesce(round_even(sa * 10.0 / n_ok, 0) / 1000, 0)::DOUBLE AS accuracy, coalesce(round_even(sc * 10.0 / n_ok, 0) / 1000, 0)::DOUBLE AS confidence, coalesce(round(dis, 3), 0) AS disagreement, coalesce(vi.issue, '') AS issue,
  CASE WHEN n_ok = 0 THEN first_error WHEN n_ok < n THEN 'PartialPanel:' || failed ELSE '' END AS parse_error, n_ok = n AND sc * 10.0 / n_ok >= {SETTINGS.vision_confidence * 1000} AND round(dis, 3) <= {SETTINGS.vision_disagreement} AS usable FROM vg LEFT JOIN vi USING (task_id, style))"""


@query("agg_5_vision_panel", f"{VISION} SELECT task_id, style, accuracy, confidence, disagreement, issue, parse_error, usable FROM v")
def agg_5(spark: SparkSession, d: str) -> DataFrame:
    return op.vision_panel(_members(spark, d), SETTINGS)


@query("agg_7_passing_styles", f"{PANEL} SELECT task_id, count(*) FILTER (WHERE {PASSES}) AS passing, count(*) AS styles FROM panel GROUP BY 1")
def agg_7(spark: SparkSession, d: str) -> DataFrame:
    return op.passing_styles(op.panel(scores(spark, d)), BAR)


@query(
    "jon_5_merge_vision",
    f"""{PANEL}, {VISION.strip().removeprefix("WITH ")}, j AS (SELECT panel.*, v.accuracy AS va, v.issue AS vi, NOT panel.skipped AND coalesce(v.usable AND v.accuracy < panel.accuracy AND v.accuracy < {SETTINGS.vision_demote}, false) AS low
  FROM panel LEFT JOIN v USING (task_id, style))
SELECT task_id, style, CASE WHEN low THEN va ELSE accuracy END AS accuracy, style_match, CASE WHEN low THEN CASE WHEN issue = '' THEN '' ELSE issue || '; ' END || 'vision: ' || coalesce(nullif(vi, ''), 'vision accuracy below text accuracy') ELSE issue END AS issue, NOT low AND meta_leak AS meta_leak, low AS demoted FROM j""",
)
def jon_5(spark: SparkSession, d: str) -> DataFrame:
    return op.merge_vision(op.panel(scores(spark, d)), op.vision_panel(_members(spark, d), SETTINGS), SETTINGS).select("task_id", "style", "accuracy", "style_match", "issue", "meta_leak", "demoted")


@query("jon_7_vision_targets", f"{PANEL} SELECT task_id, style FROM panel WHERE {FAILS}")
def jon_7(spark: SparkSession, d: str) -> DataFrame:
    p = op.panel(scores(spark, d))
    return vision_targets(p, p.where(op.failing(p, SETTINGS)), "fail").select("task_id", "style")


@query(
    "win_3_resolve_attempts",
    f"""WITH a AS (SELECT task_id, style AS role, round + 1 AS attempt, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'InvalidJSON' WHEN 2 THEN 'Truncated' ELSE CASE WHEN event_id % 20 = 3 THEN 'auth' ELSE 'timeout' END END AS error, event_id % 3 = 0 AS parses
  FROM ({ROUNDS})),
s AS (SELECT *, min(CASE WHEN error IN ('auth', 'refused') THEN attempt END) OVER (PARTITION BY task_id, role) AS stop FROM a),
l AS (SELECT *, max(attempt) OVER (PARTITION BY task_id, role) AS last FROM s WHERE stop IS NULL OR attempt <= stop),
o AS (SELECT *, error = '' OR (error = 'Truncated' AND attempt = last AND parses) AS ok FROM l)
SELECT task_id, role, attempt, error, ok FROM (SELECT *, row_number() OVER (PARTITION BY task_id, role ORDER BY ok DESC, CASE WHEN ok THEN attempt ELSE -attempt END) AS r FROM o) WHERE r = 1""",
)
def win_3(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    error = F.when(n % 4 == 0, "").when(n % 4 == 1, "InvalidJSON").when(n % 4 == 2, "Truncated").when(n % 20 == 3, "auth").otherwise("timeout")
    tried = rounds(spark, d).select("task_id", F.col("style").alias("role"), (F.col("round") + 1).alias("attempt"), error.alias("error"), (n % 3 == 0).alias("parses"))
    return op.resolve_attempts(tried).select("task_id", "role", "attempt", "error", "ok")


@query(
    "win_4_keep_best",
    f"""WITH r AS (SELECT *, {MEAN} AS mean, {FAILS} AS fails FROM ({ROUNDS}) WHERE round <= 2),
a AS (SELECT a.task_id, a.style, CASE WHEN b.round IS NOT NULL AND a.fails AND NOT b.skipped AND (a.skipped OR b.mean > a.mean OR NOT b.fails) THEN b ELSE a END AS best
  FROM (SELECT * FROM r WHERE round = 0) a LEFT JOIN (SELECT * FROM r WHERE round = 1) b USING (task_id, style)),
c AS (SELECT a.task_id, a.style, CASE WHEN c.round IS NOT NULL AND best.fails AND NOT c.skipped AND (best.skipped OR c.mean > best.mean OR NOT c.fails) THEN c ELSE best END AS best
  FROM a LEFT JOIN (SELECT * FROM r WHERE round = 2) c USING (task_id, style))
SELECT task_id, style, best.round::BIGINT AS round, best.mean AS mean, best.fails AS fails FROM c""",
)
def win_4(spark: SparkSession, d: str) -> DataFrame:
    return op.keep_best(rounds(spark, d), SETTINGS).select("task_id", "style", F.col("round").cast("long").alias("round"), "mean", "fails")


#: A caption for each event: one that only some styles accept, one that is cut, one that is too short.
SAID = ["Two small boats drift slowly past our quiet pier. Nobody seems to mind that much today.", "Two small boats drift slowly past our", "Boats drift by."]
SAID_SQL = "[" + ", ".join(f"'{x}'" for x in SAID) + "][(event_id % 3)::INT + 1]"


@query(
    "win_4_keep_best_with_rules",
    f"""{judged(f"SELECT *, {SAID_SQL} AS text FROM ({ROUNDS}) WHERE round <= 2")}, k AS (SELECT task_id, style, round, skipped, {MEAN} AS mean, {FAILS} OR score_reason <> 'ok' AS fails FROM r),
a AS (SELECT a.task_id, a.style, CASE WHEN b.round IS NOT NULL AND a.fails AND NOT b.skipped AND (a.skipped OR b.mean > a.mean OR NOT b.fails) THEN b ELSE a END AS best
  FROM (SELECT * FROM k WHERE round = 0) a LEFT JOIN (SELECT * FROM k WHERE round = 1) b USING (task_id, style)),
z AS (SELECT a.task_id, a.style, CASE WHEN c.round IS NOT NULL AND best.fails AND NOT c.skipped AND (best.skipped OR c.mean > best.mean OR NOT c.fails) THEN c ELSE best END AS best
  FROM a LEFT JOIN (SELECT * FROM k WHERE round = 2) c USING (task_id, style))
SELECT task_id, style, best.round::BIGINT AS round, best.mean AS mean, best.fails AS fails FROM z""",
)
def win_4_rules(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("event_id") % 3 + 1).cast("int"))
    return op.keep_best(rounds(spark, d).withColumn("text", said), SETTINGS, rules=RULES).select("task_id", "style", F.col("round").cast("long").alias("round"), "mean", "fails")


ISSUE = "coalesce(nullif(issue, ''), nullif(skip_reason, ''), 'below the bar for accuracy or style')"


@query(
    "msg_3_feedback",
    f"""SELECT event_id, CASE WHEN meta_leak OR regexp_matches(lower({ISSUE}), 'scene|wrong subject|incomplete|describe|meta') THEN 'The last caption was unfinished, held notes or was about another scene (issue: ' || {ISSUE} || '). Write one finished caption of one or two sentences about the primary subject, from the facts alone.'
  ELSE printf('The last caption scored accuracy %.2f and style %.2f (mean %.2f). Issue: ', accuracy, style_match, {MEAN}) || {ISSUE} || '. Rewrite it from the facts alone and keep its style.' END AS feedback
FROM (SELECT * REPLACE (CASE WHEN event_id % 9 = 1 THEN 'wrong scene' ELSE issue END AS issue, round(round(accuracy * 50) / 50, 2) AS accuracy, round(round(style_match * 50) / 50, 2) AS style_match) FROM ({SCORES}))""",
)
def msg_3(spark: SparkSession, d: str) -> DataFrame:
    """Scores in steps of 0.02, so that means have two decimals."""
    even = lambda c: F.round(F.round(F.col(c) * 50) / 50, 2)
    s = scores(spark, d).withColumns({"issue": F.when(F.col("event_id") % 9 == 1, "wrong scene").otherwise(F.col("issue")), "accuracy": even("accuracy"), "style_match": even("style_match")})
    return s.select("event_id", op.feedback(s).alias("feedback"))


@query("jdg_2_flag", "SELECT event_id, event_id % 9 IN (0, 1, 2, 3, 8) AS leak FROM events")
def jdg_2(spark: SparkSession, d: str) -> DataFrame:
    told = F.element_at(F.array(*map(F.lit, ["true", " YES ", "1", "y", "no", "0", "nan", "", "2.5"])), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", op.flag(told).alias("leak"))


@query(
    "jdg_5_leak_cap",
    f"""SELECT event_id, CASE WHEN meta_leak THEN least(accuracy, 0.2) ELSE accuracy END AS accuracy, CASE WHEN NOT meta_leak THEN issue WHEN issue = '' THEN 'meta-leak' WHEN contains(lower(issue), 'meta') THEN issue ELSE 'meta-leak; ' || issue END AS issue FROM ({SCORES})""",
)
def jdg_5(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("event_id", op.leak_cap(F.col("accuracy"), F.col("meta_leak")).alias("accuracy"), op.leak_issue(F.col("issue"), F.col("meta_leak")).alias("issue"))


@query("top_3_low_distinctness", f"SELECT task_id, distinctness FROM ({ORACLES['agg_2_clip_panel']}) WHERE distinctness > 0 AND distinctness < {SETTINGS.distinctness_warning}")
def top_3(spark: SparkSession, d: str) -> DataFrame:
    return op.low_distinctness(agg_2(spark, d), SETTINGS).select("task_id", "distinctness")


@query(
    "snk_3_report_header",
    f"""{PANEL}, w AS (SELECT {TOTALS} FROM panel), j AS (SELECT count(DISTINCT judge_model) AS judges, count(*) FILTER (WHERE {PASSES}) AS judge_passes FROM ({SCORES}))
SELECT 'panel' AS model, {SETTINGS.judge_min_score}::DOUBLE AS min_score, passes, total, mean AS mean_score, judges::INT AS judges, judge_passes FROM w, j""",
)
def snk_3(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    head = report_header(op.panel(s), s, SETTINGS, "panel", True)
    judge_passes = F.aggregate("per_judge", F.lit(0).cast("long"), lambda a, x: a + x["passes"])
    return head.select("model", "min_score", "passes", "total", "mean_score", F.size("panel_models").alias("judges"), judge_passes.alias("judge_passes"))


@query(
    "snk_3_report_clips",
    f"{PANEL} SELECT task_id, string_agg(style || ':' || printf('%.3f', accuracy) || ':' || CASE WHEN skipped THEN skip_reason ELSE issue END, '|' ORDER BY list_position({STYLE_LIST}, style)) AS captions FROM panel GROUP BY 1",
)
def snk_3_clips(spark: SparkSession, d: str) -> DataFrame:
    told = F.transform("captions", lambda x: F.concat(x["style"], F.lit(":"), F.format_string("%.3f", x["accuracy"]), F.lit(":"), F.when(x["skipped"], x["skip_reason"]).otherwise(x["issue"])))
    return nested_report(op.panel(scores(spark, d))).select("task_id", F.array_join(told, "|").alias("captions"))


DIST = f"round(abs(least(accuracy, style_match) - {BAR}) + abs({MEAN} - {BAR}) * 0.25 - CASE WHEN {PASSES} THEN 0 ELSE 0.05 END, 6)"
NEAR = f"NOT skipped AND (abs(least(accuracy, style_match) - {BAR}) <= {SETTINGS.calibration_margin} OR abs({MEAN} - {BAR}) <= {SETTINGS.calibration_margin})"


@query("top_1_calibration_sample", f"{PANEL} SELECT task_id, style, {PASSES} AS passed, {DIST} AS distance FROM panel WHERE {NEAR} ORDER BY distance, task_id, list_position({STYLE_LIST}, style) LIMIT {SETTINGS.calibration_rows}")
def top_1(spark: SparkSession, d: str) -> DataFrame:
    return op.calibration_sample(op.panel(scores(spark, d)), SETTINGS).select("task_id", "style", "passed", "distance")


@query("top_2_weakest_first", f"{PANEL} SELECT task_id, style, skipped, {MEAN} AS mean FROM panel ORDER BY skipped, mean, task_id, style")
def top_2(spark: SparkSession, d: str) -> DataFrame:
    return op.weakest_first(op.panel(scores(spark, d))).select("task_id", "style", "skipped", "mean")


@query(
    "top_2_positions",
    f"{PANEL} SELECT task_id, style, row_number() OVER (ORDER BY skipped, CASE WHEN skipped THEN 0 ELSE {MEAN} END, task_id, list_position({STYLE_LIST}, style)) AS position FROM panel",
)
def top_2_positions(spark: SparkSession, d: str) -> DataFrame:
    return op.weakest_first(op.panel(scores(spark, d))).select("task_id", "style", "position")


@query("top_4_failures", f"{PANEL} SELECT task_id, style, array_to_string(list_filter([CASE WHEN accuracy < {BAR} THEN 'accuracy' END, CASE WHEN style_match < {BAR} THEN 'style_match' END, CASE WHEN meta_leak THEN 'meta-leak' END], lambda x: x IS NOT NULL), ', ') AS weak FROM panel WHERE NOT skipped AND NOT {PASSES}")
def top_4(spark: SparkSession, d: str) -> DataFrame:
    return op.failure_report(op.panel(scores(spark, d)), BAR).select("task_id", "style", "weak")


ONE = f"SELECT task_id, style, min_by(text, pool_index) AS text FROM ({CAPTIONS}) GROUP BY 1, 2"


@query("set_1_failures", f"SELECT task_id, style FROM ({judged(ONE)} SELECT task_id, style FROM r WHERE score_reason <> 'ok') UNION SELECT task_id, style FROM ({PANEL} SELECT task_id, style FROM panel WHERE {FAILS})")
def set_1(spark: SparkSession, d: str) -> DataFrame:
    one = captions(spark, d).groupBy("task_id", "style").agg(F.min_by("text", "pool_index").alias("text"))
    return op.failures(op.panel(scores(spark, d)), one, RULES, SETTINGS)
