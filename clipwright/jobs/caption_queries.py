"""Queries on captions: text rules, tokens, grounding, ranking, salvage, similarity, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens, word_count
from ..operators import captions as op
from ..operators import text_rules as t
from ..operators.examples import example_echoes
from ..operators.tasks import caption_of, with_facts
from .derived import CAPTIONS, FACTS, RULES, SETTINGS, any_of, captions, facts, judged, split_sentences, sql_tokens, table, trim_sql, words_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = "task_id, pool_index"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


R = judged(CAPTIONS)
JOINED = f"SELECT c.*, f.facts FROM ({CAPTIONS}) c LEFT JOIN ({FACTS}) f USING (task_id)"


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return with_facts(captions(spark, d), facts(spark, d))


def _flag(name: str, sql: str, column):
    @query(name, f"{R} SELECT {KEY}, {sql} AS result FROM r")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return captions(spark, d).select("task_id", "pool_index", column().alias("result"))


@query("txt_1_sentences", f"{R} SELECT {KEY}, n_parts::INT AS n, array_to_string(parts, '|') AS sentences FROM r")
def txt_1(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).select("task_id", "pool_index", sentences(F.col("text")).alias("s")).select("task_id", "pool_index", F.size("s").alias("n"), F.array_join("s", "|").alias("sentences"))


_flag("txt_2_field_dump", "dump", lambda: t.field_dump(F.col("text"), RULES))
_flag("txt_3_incomplete", "cut", lambda: t.incomplete(F.col("text"), RULES))
_flag("txt_4_drafting", "draft", lambda: t.drafting(F.col("text"), RULES))
_flag("txt_8_hard_fail", "hard", lambda: t.hard_fail(F.col("text"), RULES))
_flag("txt_9_meta_leak", "leak", lambda: t.meta_leak(F.col("text"), RULES))
_flag("txt_11_bad_output", "bad", lambda: t.bad_output(F.col("text"), F.col("style"), RULES))
_flag("txt_12_structural_failure", "structural", lambda: t.structural_failure(F.col("text"), RULES))
_flag("txt_13_score", "score_reason", lambda: t.score_reason(F.col("text"), F.col("style"), RULES))


@query(
    "txt_5_example_echo",
    r"""
WITH e AS (SELECT regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '^[ "'']+|[ "'']+$', '', 'g') AS k FROM benchmark),
d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '^[ "'']+|[ "'']+$', '', 'g') AS k FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark))
SELECT doc_id, k <> '' AND EXISTS (SELECT 1 FROM e WHERE d.k = e.k OR (abs(length(d.k) - length(e.k)) <= 12 AND (contains(d.k, e.k) OR contains(e.k, d.k)))) AS result FROM d""",
)
def txt_5(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and the examples themselves, against the examples through their index."""
    shown = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").select("doc_id", "text").unionByName(shown.select((-1 - F.col("item_id")).alias("doc_id"), "text"))
    return example_echoes(docs, shown).select("doc_id", F.col("echo").alias("result"))


CONTENT, GROUND = sql_tokens("{}", "[a-z0-9]+", RULES.content_stopwords), sql_tokens("{}", "[a-z0-9]+", RULES.grounding_stopwords)


def _content(x: str) -> str:
    return CONTENT.replace("{}", x)


def _ground(x: str) -> str:
    return GROUND.replace("{}", x)


def _expanded(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in RULES.synonyms.items())
    return f"list_distinct(list_concat({x}, flatten(list_transform({x}, lambda w: CASE w {cases} ELSE [] END))))"


WATCH = "[" + ", ".join(f"'{w}'" for w in RULES.entities) + "]"
MATCH = rf"""
WITH c AS ({JOINED}), k AS (SELECT *, {_content("coalesce(text, '')")} AS said, {_content("coalesce(facts, '')")} AS known,
  {_content("regexp_extract(coalesce(facts, ''), '^Primary subject:([^' || chr(10) || '(\\[]*)', 1)")} AS subject FROM c),
s AS (SELECT task_id, pool_index, text, facts, {_expanded("said")} AS said2, {_expanded("known")} AS known2, {_expanded("subject")} AS subject2, list_intersect(said, {WATCH}) AS named FROM k),
o AS (SELECT *, len(list_filter(named, lambda w: NOT list_contains(known2, w))) > 0 AS foreign_entity FROM s)"""


@query("txt_6_foreign_entity", f"{MATCH} SELECT {KEY}, foreign_entity AS result FROM o WHERE facts IS NOT NULL")
def txt_6(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).where("facts IS NOT NULL").select("task_id", "pool_index", t.foreign_entity(F.col("facts"), F.col("text"), RULES).alias("result"))


@query(
    "txt_7_scene_mismatch",
    rf"{MATCH} SELECT {KEY}, coalesce(regexp_replace(facts, '\s', '', 'g'), '') <> '' AND regexp_replace(text, '\s', '', 'g') <> '' AND (foreign_entity OR (len(subject2) > 0 AND len(list_intersect(subject2, said2)) = 0 AND len(list_intersect(known2, said2)) < 2)) AS result FROM o",
)
def txt_7(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("task_id", "pool_index", t.scene_mismatch(F.col("facts"), F.col("text"), RULES).alias("result"))


@query(
    "tok_1_token_sets",
    f"SELECT {KEY}, array_to_string({_content('text')}, ' ') AS content, array_to_string({_ground('text')}, ' ') AS grounding, array_to_string({sql_tokens('text', '[a-z'']+')}, ' ') AS plain FROM ({CAPTIONS})",
)
def tok_1(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("text")
    made = (t.content_tokens(x, RULES), tokens(x, "[a-z0-9]+", RULES.grounding_stopwords), tokens(x, "[a-z']+"))
    return captions(spark, d).select("task_id", "pool_index", *[F.array_join(c, " ").alias(n) for c, n in zip(made, ("content", "grounding", "plain"), strict=True)])


VERBS = "[" + ", ".join(f"'{w}'" for w in RULES.action_verbs) + "]"
LINES = "string_split(facts, chr(10))"
BODY = "regexp_extract({}, '^[^:]*:\\s*(.*)$', 1)"
GROUNDED = f"""
WITH f AS (SELECT task_id, facts, list_sort(list_distinct(list_concat({_ground("regexp_extract(" + BODY.format(LINES + "[1]") + ", '^([^(]*)', 1)")}, {_ground(BODY.format(LINES + "[2]"))}))) AS anchors,
  list_sort(list_filter({_ground(BODY.format(LINES + "[3]"))}, lambda w: list_contains({VERBS}, w) OR w LIKE '%ing')) AS verbs FROM ({FACTS}))"""


@query("grd_1_anchors", f"{GROUNDED} SELECT task_id, array_to_string(anchors, ' ') AS anchors FROM f")
def grd_1(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("task_id", F.array_join(op.anchors(F.col("text"), RULES), " ").alias("anchors"))


@query("grd_2_action_verbs", f"{GROUNDED} SELECT task_id, array_to_string(verbs, ' ') AS verbs FROM f")
def grd_2(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("task_id", F.array_join(op.action_verbs(F.col("text"), RULES), " ").alias("verbs"))


BONUS = f"""{GROUNDED},
g AS (SELECT c.*, anchors, verbs, {_ground("coalesce(text, '')")} AS said FROM ({CAPTIONS}) c JOIN f USING (task_id)),
n AS (SELECT *, len(anchors) AS na, len(list_intersect(anchors, said)) AS hit, len(verbs) AS nv, len(list_intersect(verbs, said)) AS hitv,
  len(list_filter(list_intersect(said, {VERBS}), lambda w: NOT list_contains(verbs, w))) AS inv FROM g),
m AS (SELECT *, CASE WHEN nv > 0 THEN least(inv * 3, 8) ELSE 0 END AS pen FROM n),
bonus AS (SELECT *, (CASE WHEN na = 0 OR len(said) = 0 THEN 0 ELSE greatest(0, least(35, round_even(hit::DOUBLE / na * 20, 0) + CASE WHEN hit >= 3 THEN 5 ELSE 0 END + CASE WHEN hit >= 5 THEN 5 ELSE 0 END
    + CASE WHEN nv > 0 THEN round_even(hitv::DOUBLE / nv * 10, 0) ELSE 0 END - pen)) END)::INT AS bonus,
  CASE WHEN na = 0 THEN 'no-anchors' WHEN len(said) = 0 THEN 'empty-caption' ELSE 'grounding=' || hit || '/' || na || CASE WHEN nv > 0 THEN '+actions=' || hitv || '/' || nv ELSE '' END
    || CASE WHEN pen > 0 THEN '+mismatch=-' || pen ELSE '' END END AS reason FROM m)"""


@query("grd_3_grounding_bonus", f"{BONUS} SELECT {KEY}, bonus, reason FROM bonus")
def grd_3(spark: SparkSession, d: str) -> DataFrame:
    """Facts are tokenised once a task, before the join."""
    f = facts(spark, d).select("task_id", op.anchors(F.col("text"), RULES).alias("a"), op.action_verbs(F.col("text"), RULES).alias("v"))
    g = captions(spark, d).join(f, "task_id").withColumn("g", op.grounding(F.col("a"), F.col("v"), F.col("text"), RULES))
    return g.select("task_id", "pool_index", "g.bonus", "g.reason")


RANK = "CASE WHEN score_reason = 'ok' THEN 100 + greatest(0, 10 - (abs(n_words - 42) // 3)) ELSE CASE score_reason " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in op.PENALTIES.items()) + " ELSE 10 END END"


@query("rnk_1_rank", f"{R} SELECT {KEY}, style, ({RANK})::INT AS score_rank, score_reason FROM r")
def rnk_1(spark: SparkSession, d: str) -> DataFrame:
    return op.with_rank(captions(spark, d), RULES).select("task_id", "pool_index", "style", "score_rank", "score_reason")


MISMATCH = r"coalesce(regexp_replace(facts, '\s', '', 'g'), '') <> '' AND regexp_replace(text, '\s', '', 'g') <> '' AND (foreign_entity OR (len(subject2) > 0 AND len(list_intersect(subject2, said2)) = 0 AND len(list_intersect(known2, said2)) < 2))"
#: The rules with facts: another scene counts where no structural reason comes first.
AGAINST_FACTS = f"""
WITH a AS (SELECT * FROM ({R} SELECT task_id, pool_index, style, hard, structural, bad, score_reason, n_words FROM r)), m AS (SELECT * FROM ({MATCH} SELECT task_id, pool_index, {MISMATCH} AS mm FROM o)),
g AS (SELECT * FROM ({BONUS} SELECT task_id, pool_index, bonus, reason FROM bonus)),
z AS (SELECT a.* REPLACE (CASE WHEN structural = '' AND mm THEN 'scene-mismatch' ELSE score_reason END AS score_reason), mm, bonus, reason FROM a LEFT JOIN m USING (task_id, pool_index) LEFT JOIN g USING (task_id, pool_index))"""


@query("txt_11_bad_output_with_facts", f"{AGAINST_FACTS} SELECT {KEY}, CASE WHEN hard = '' AND mm THEN 'SceneMismatch' ELSE bad END AS result FROM z")
def txt_11_facts(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("task_id", "pool_index", t.bad_output(F.col("text"), F.col("style"), RULES, F.col("facts")).alias("result"))


@query(
    "rnk_1_rank_with_facts",
    f"{AGAINST_FACTS} SELECT {KEY}, style, (({RANK}) + CASE WHEN score_reason = 'ok' THEN coalesce(bonus, 0) ELSE 0 END)::INT AS score_rank, CASE WHEN score_reason = 'ok' THEN 'ok' || coalesce('+' || reason, '') ELSE score_reason END AS score_reason FROM z",
)
def rnk_1_facts(spark: SparkSession, d: str) -> DataFrame:
    return op.with_rank(_joined(spark, d), RULES).select("task_id", "pool_index", "style", "score_rank", "score_reason")


BEST = f"{R}, k AS (SELECT *, ({RANK})::INT AS score_rank, row_number() OVER (PARTITION BY task_id, style ORDER BY ({RANK}) DESC, score_reason = 'ok' DESC, n_words DESC, pool_index) AS pos FROM r)"


@query("win_1_best_of_n", f"{BEST} SELECT task_id, style, pool_index, score_rank FROM k WHERE pos = 1")
def win_1(spark: SparkSession, d: str) -> DataFrame:
    return op.best_of_n(op.with_rank(captions(spark, d), RULES)).select("task_id", "style", "pool_index", "score_rank")


@query(
    "win_2_tie_break",
    f"""{R}, k AS (SELECT task_id, pool_index, 95 + n_words % 20 AS score_rank, row_number() OVER (PARTITION BY task_id ORDER BY 95 + n_words % 20 DESC, n_words DESC, pool_index) AS pos FROM r),
z AS (SELECT a.task_id, a.pool_index, b.pool_index AS second_pool_index, a.pool_index * 37 % 11 AS pa, b.pool_index * 37 % 11 AS pb FROM k a JOIN k b ON a.task_id = b.task_id AND a.pos = 1 AND b.pos = 2
  WHERE a.score_rank >= 100 AND b.score_rank >= 100 AND a.score_rank - b.score_rank <= {SETTINGS.tie_margin})
SELECT task_id, pool_index, second_pool_index, CASE WHEN pb > pa THEN second_pool_index ELSE pool_index END AS winner FROM z""",
)
def win_2(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of a task compete in one style; their ranks come from their length, their judge scores from their pool index."""
    rank = F.lit(95) + word_count(F.col("text")) % 20
    pool = captions(spark, d).withColumns({"style": F.lit("formal"), "score_rank": rank, "ok": rank >= 100})
    points = pool.select("task_id", "style", "pool_index", F.lit(0.0).alias("accuracy"), (F.col("pool_index") * 37 % 11).cast("double").alias("style_match"))
    return op.break_ties(op.close_calls(pool, SETTINGS), points).select("task_id", "pool_index", "second_pool_index", "winner")


ONE = f"SELECT task_id, style, min_by(text, pool_index) AS text FROM ({CAPTIONS}) GROUP BY 1, 2"


def _one_each(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).groupBy("task_id", "style").agg(F.min_by("text", "pool_index").alias("text"))


@query(
    "jon_4_similar_styles",
    f"""WITH w AS (SELECT task_id, style, {sql_tokens("text", "[a-z'']+")} AS w FROM ({ONE})),
j AS (SELECT a.task_id, a.style AS style1, b.style AS style2, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS x, len(b.w) AS y FROM w a JOIN w b ON a.task_id = b.task_id AND a.style < b.style)
SELECT task_id, style1, style2, round(i::DOUBLE / (x + y - i), 6) AS similarity FROM j WHERE x > 0 AND y > 0 AND i::DOUBLE / (x + y - i) >= {SETTINGS.similarity_warning}""",
)
def jon_4(spark: SparkSession, d: str) -> DataFrame:
    return op.similar_styles(_one_each(spark, d), SETTINGS).withColumn("similarity", F.round("similarity", 6))


@query("agg_6_rule_score_report", f"{R} SELECT style, score_reason AS reason, count(*) AS captions, count(*) FILTER (WHERE score_reason = 'ok') AS passes FROM r GROUP BY 1, 2")
def agg_6(spark: SparkSession, d: str) -> DataFrame:
    """Rule-score totals by style and reason; ``rule_totals`` gives the one-row form."""
    scored = captions(spark, d).select("style", t.score_reason(F.col("text"), F.col("style"), RULES).alias("reason"))
    return scored.groupBy("style", "reason").agg(F.count("*").alias("captions"), F.count_if(F.col("reason") == "ok").alias("passes"))


@query("agg_6_rule_totals", f"{R} SELECT count(*) FILTER (WHERE score_reason = 'ok') AS passes, count(*) AS total FROM r")
def agg_6_totals(spark: SparkSession, d: str) -> DataFrame:
    return op.rule_totals(captions(spark, d), RULES)


@query(
    "agg_6_rule_report",
    f"""SELECT 'fail' AS kind, task_id, task_id::VARCHAR || '/' || style || ': ' || score_reason AS line FROM ({judged(ONE)} SELECT * FROM r WHERE score_reason <> 'ok')
UNION ALL SELECT 'warning', task_id, task_id::VARCHAR || '/' || style1 || ' vs ' || style2 || ': high similarity (' || round_even(s * 100, 0)::INT::VARCHAR || '%)' FROM (SELECT * FROM (
  WITH w AS (SELECT task_id, style, {sql_tokens("text", "[a-z'']+")} AS w FROM ({ONE}))
  SELECT a.task_id, a.style AS style1, b.style AS style2, len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0) AS s, len(a.w) > 0 AND len(b.w) > 0 AS ok FROM w a JOIN w b ON a.task_id = b.task_id AND a.style < b.style) WHERE ok AND s >= {SETTINGS.similarity_warning})""",
)
def agg_6_report(spark: SparkSession, d: str) -> DataFrame:
    return op.rule_report(_one_each(spark, d), RULES, SETTINGS)


@query("jon_9_caption_of", f"SELECT task_id, style, n, text AS caption FROM (SELECT task_id, style, count(*) AS n, max_by(text, pool_index) AS text FROM ({CAPTIONS}) GROUP BY 1, 2)")
def jon_9(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as clips that share an id: the last one's text counts."""
    c = captions(spark, d)
    return caption_of(c.groupBy("task_id", "style").agg(F.count("*").alias("n")), c.withColumn("clip_index", F.col("pool_index")))


@query("txt_10_truncated", rf"SELECT {KEY}, pool_index % 3 = 0 OR (text <> '' AND NOT regexp_matches(text, '[.!?)" + '"' + rf"]\z')) AS result FROM ({CAPTIONS})")
def txt_10(spark: SparkSession, d: str) -> DataFrame:
    finish = F.when(F.col("pool_index") % 3 == 0, "length").otherwise("stop")
    return captions(spark, d).select("task_id", "pool_index", t.truncated(F.col("text"), finish).alias("result"))


@query("txt_15_placeholder", f"SELECT {KEY}, pool_index % 4 = 0 AS result FROM ({CAPTIONS})")
def txt_15(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("pool_index") % 4 == 0, F.concat(F.lit("  "), F.lit(RULES.placeholders[0]), F.lit("\n"))).otherwise(F.col("text"))
    return captions(spark, d).select("task_id", "pool_index", t.placeholder(text, RULES).alias("result"))


@query("jon_1_captions_with_facts", f"SELECT {KEY}, style, coalesce(length(facts), -1)::INT AS facts_length FROM ({JOINED})")
def jon_1(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("task_id", "pool_index", "style", F.coalesce(F.length("facts"), F.lit(-1)).alias("facts_length"))


LABELS, LEAKS = any_of(RULES.label_prefixes), any_of(RULES.leak_prefixes)


def _bare(x: str) -> str:
    """Without its label, null if it has none."""
    return rf"(CASE WHEN regexp_matches(lower({trim_sql(x)}), '^(?:{LABELS})') THEN regexp_replace({trim_sql(x)}, '(?i)^(?:{LABELS})\s*', '') END)"


def _kept(x: str) -> str:
    """Its lines without those that leak."""
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\r?\n'), lambda l: {trim_sql('l')}), lambda l: l <> '' AND NOT regexp_matches(lower(l), '^(?:{LEAKS})')), ' ')"


def salvaged(source: str) -> str:
    """SAL-1 in SQL over (doc_id, text): candidates by (kind, i, j) in the operator's order; of equal ones the first stays."""
    return rf"""
WITH d AS (SELECT doc_id, {trim_sql("coalesce(text, '')")} AS t FROM {source}),
b AS (SELECT doc_id, unnest(range(len(bl))) AS i, unnest(bl) AS x FROM (
  SELECT doc_id, list_reverse(list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda y: {trim_sql('y')}), lambda y: y <> '')) AS bl FROM d) WHERE len(bl) > 1),
x AS (SELECT doc_id, 3 AS kind, i, x FROM b UNION ALL SELECT doc_id, 4, 0, t FROM d WHERE t <> ''),
p AS (SELECT doc_id, kind, i, {split_sentences("x")} AS p FROM x),
q AS (SELECT doc_id, unnest(range(len(qs))) AS i, {trim_sql('unnest(qs)')} AS s FROM (SELECT doc_id, regexp_extract_all(t, '"([^"]{{40,400}})"', 1) AS qs FROM d)),
c AS (SELECT doc_id, 0 AS kind, 0 AS i, 0 AS j, CASE WHEN t LIKE '{{%' AND json_valid(t) THEN json_extract_string(t, '$.caption') END AS c FROM d
  UNION ALL SELECT doc_id, 1, -{words_sql('s')}, i, s FROM q WHERE regexp_matches(s, '^\p{{Lu}}') AND regexp_matches(s, '[.!?]$') AND {words_sql('s')} >= 8
  UNION ALL SELECT doc_id, 2, 0, 0, {_bare('t')} FROM d UNION ALL SELECT doc_id, 2, 0, 1, {_kept('t')} FROM d
  UNION ALL SELECT doc_id, 3, i, 0, x FROM b UNION ALL SELECT doc_id, 3, i, 1, {_bare('x')} FROM b UNION ALL SELECT doc_id, 3, i, 2, {_kept('x')} FROM b
  UNION ALL SELECT doc_id, kind, i, 2 + n, array_to_string(p[len(p) - n + 1:], ' ') FROM (SELECT *, unnest([1, 2, 3]) AS n FROM p) WHERE n <= len(p)),
k AS (SELECT doc_id, kind, i, j, {trim_sql('c')} AS candidate FROM c WHERE c IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, candidate ORDER BY kind, i, j) AS copy FROM k WHERE candidate <> ''),
salvaged AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, i, j) - 1)::INT AS ord, candidate FROM f WHERE copy = 1)"""


SALVAGED = salvaged("documents")


@query("sal_1_salvage_candidates", f"{SALVAGED} SELECT doc_id, ord, candidate FROM salvaged")
def sal_1(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text as a raw reply: its candidates in order."""
    docs = table(spark, d, "documents").select("doc_id", op.salvage_candidates(F.col("text"), RULES).alias("c"))
    return docs.select("doc_id", F.posexplode("c").alias("ord", "candidate"))


#: Judged candidates come from a table, since the rules' SQL begins with a WITH of its own.
SALVAGED_ROWS = f"SELECT doc_id, ord, candidate AS text, 'sarcastic' AS style FROM ({SALVAGED} SELECT * FROM salvaged)"


@query("sal_2_first_valid", f"SELECT d.doc_id, v.caption FROM documents d LEFT JOIN (SELECT doc_id, arg_min(text, ord) AS caption FROM ({judged(SALVAGED_ROWS)} SELECT doc_id, ord, text FROM r WHERE bad = '') GROUP BY 1) v USING (doc_id)")
def sal_2(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda c: ~t.good_output(c, F.lit("sarcastic"), RULES)
    return op.first_valid_rows(table(spark, d, "documents").select("doc_id", op.salvage_candidates(F.col("text"), RULES).alias("c")), "doc_id", "c", bad)


TAILS = f"""SELECT doc_id, text, min(ord * 2 + n) AS ord, 'sarcastic' AS style FROM (
  SELECT doc_id, ord, n, array_to_string(p[len(p) - n + 1:], ' ') AS text FROM (SELECT doc_id, ord, {split_sentences("text")} AS p, unnest([1, 2]) AS n FROM ({SALVAGED_ROWS})) WHERE n <= len(p)) GROUP BY 1, 2"""


@query(
    "sal_3_longest_fit",
    f"""SELECT d.doc_id, v.caption FROM documents d LEFT JOIN (SELECT doc_id, text AS caption FROM ({judged(TAILS)} SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, ord) AS pos
  FROM r WHERE bad = '' AND n_words <= {RULES.word_limits["sarcastic"]}) WHERE pos = 1) v USING (doc_id)""",
)
def sal_3(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda c: ~t.good_output(c, F.lit("sarcastic"), RULES)
    return table(spark, d, "documents").select("doc_id", op.longest_fit(op.salvage_candidates(F.col("text"), RULES), t.word_limit(F.lit("sarcastic"), RULES), bad).alias("caption"))


#: SAL-4: texts as replies in the styles by turns, every third between quotes and every fifth a single sentence, so that good replies, salvage and failures occur.
STYLES_BY_TURN = "CASE doc_id % 4 WHEN 0 THEN 'formal' WHEN 1 THEN 'sarcastic' WHEN 2 THEN 'humorous_tech' ELSE 'humorous_non_tech' END"
RAW = f"""SELECT doc_id, {STYLES_BY_TURN} AS style, CASE WHEN doc_id % 3 = 0 THEN '"' || s || '"' ELSE s END AS raw FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substring(coalesce(text, ''), 1, strpos(coalesce(text, '') || '.', '.')) ELSE coalesce(text, '') END AS s FROM documents)"""
BARE = f"""SELECT doc_id, style, CASE WHEN length(b) >= 2 AND left(b, 1) IN ('"', chr(39)) AND left(b, 1) = right(b, 1) THEN substring(b, 2, length(b) - 2) ELSE b END AS text
  FROM (SELECT doc_id, style, {trim_sql("raw")} AS b FROM ({RAW}))"""
OFFERED = f"SELECT doc_id, ord, candidate AS text, {STYLES_BY_TURN} AS style FROM ({salvaged(f'({BARE})')} SELECT * FROM salvaged)"
ENDS = f"""SELECT doc_id, text, min(ord * 2 + n) AS ord, any_value(style) AS style FROM (
  SELECT doc_id, style, ord, n, array_to_string(p[len(p) - n + 1:], ' ') AS text FROM (SELECT doc_id, style, ord, {split_sentences("text")} AS p, unnest([1, 2]) AS n FROM ({OFFERED})) WHERE n <= len(p)) GROUP BY 1, 2"""
LIMIT = "CASE style " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RULES.word_limits.items()) + f" ELSE {RULES.default_word_limit} END"


@query(
    "sal_4_normalised_reply",
    f"""SELECT b.doc_id, CASE WHEN b.bad = '' THEN b.text ELSE coalesce(v.caption, e.caption, b.text) END AS caption FROM ({judged(BARE)} SELECT doc_id, text, bad FROM r) b
LEFT JOIN (SELECT doc_id, arg_min(text, ord) AS caption FROM ({judged(OFFERED)} SELECT doc_id, ord, text FROM r WHERE bad = '') GROUP BY 1) v USING (doc_id)
LEFT JOIN (SELECT doc_id, text AS caption FROM ({judged(ENDS)} SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, ord) AS pos
  FROM r WHERE bad = '' AND n_words <= {LIMIT}) WHERE pos = 1) e USING (doc_id)""",
)
def sal_4(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.col("doc_id") % 5 == 0, F.substring_index(F.concat(text, F.lit(".")), ".", 1)).otherwise(text)
    said = F.when((F.col("doc_id") % 5 == 0) & text.contains("."), F.concat(said, F.lit("."))).otherwise(said)
    quoted = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), said, F.lit('"'))).otherwise(said)
    docs = table(spark, d, "documents").select("doc_id", quoted.alias("raw"), F.expr(STYLES_BY_TURN).alias("style"))
    return op.normalised_replies(docs, "doc_id", "raw", "style", RULES)
