"""Grounding, ranking and choice of captions (GRD, RNK, WIN-1, WIN-2), salvage of raw replies (SAL), similarity and totals (JON-4, AGG-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RuleBook, Settings
from ..functions.text import alternation, let, sentences, size0, tokens, trimmed, with_once, word_count
from . import text_rules as rules_of


def _strings(*parts: Column) -> Column:
    return F.array(*parts).cast("array<string>")


def anchors(facts: Column, rules: RuleBook) -> Column:
    """GRD-1: tokens of the subjects' names, colours and marks, of background, moments and setting; sorted."""
    lines = F.transform(F.split(F.coalesce(facts, F.lit("")), r"\r?\n"), trimmed)

    def of_line(line: Column) -> Column:
        body = F.regexp_extract(line, r"^[^:]*:\s*(.*)$", 1)
        colours = F.regexp_extract(body, r"(?i)\(colors:\s*([^)]+)\)", 1)
        marks = F.regexp_extract(body, r"\[([^\]]+)\]", 1)
        subject = F.concat_ws(" ", F.regexp_extract(body, r"^([^(]*)", 1), colours, marks)
        low = F.lower(line)
        return (
            F.when(low.rlike("^(?:primary subject:|subject )"), tokens(subject, "[a-z0-9]+", rules.grounding_stopwords))
            .when(low.rlike("^(?:background|notable moments|setting):"), tokens(body, "[a-z0-9]+", rules.grounding_stopwords))
            .otherwise(_strings())
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(lines, of_line))))


def action_verbs(facts: Column, rules: RuleBook) -> Column:
    """GRD-2: tokens of the action lines that are known verbs or end in `ing`; sorted."""
    lines = F.transform(F.split(F.coalesce(facts, F.lit("")), r"\r?\n"), trimmed)
    acting = F.filter(lines, lambda x: F.lower(x).rlike(r"^(?:actions \((?:early|late)\)|notable moments):"))
    words = F.flatten(F.transform(acting, lambda x: tokens(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), "[a-z0-9]+", rules.grounding_stopwords)))
    return F.array_sort(F.array_distinct(F.filter(words, lambda t: t.isin(*rules.action_verbs) | t.endswith("ing"))))


def grounding(anchor: Column, verbs: Column, caption: Column, rules: RuleBook) -> Column:
    """GRD-3: struct(bonus from 0 to 35, reason). ``anchor`` and ``verbs`` are those of the facts, taken once a task."""
    known = F.array(*map(F.lit, rules.action_verbs)).cast("array<string>")

    def scored(said: Column) -> Column:
        n, hit = F.size(anchor), F.size(F.array_intersect(anchor, said))
        n_verbs, hit_verbs = F.size(verbs), F.size(F.array_intersect(verbs, said))
        invented = F.size(F.array_except(F.array_intersect(said, known), verbs))
        penalty = F.when(n_verbs > 0, F.least(invented * 3, F.lit(8))).otherwise(0)
        acted = F.when(n_verbs > 0, F.bround(hit_verbs / n_verbs * 10, 0).cast("int")).otherwise(0)
        bonus = F.bround(hit / n * 20, 0).cast("int") + F.when(hit >= 3, 5).otherwise(0) + F.when(hit >= 5, 5).otherwise(0) + acted - penalty
        reason = F.concat_ws(
            "+",
            F.format_string("grounding=%d/%d", hit, n),
            F.when(n_verbs > 0, F.format_string("actions=%d/%d", hit_verbs, n_verbs)),
            F.when(penalty > 0, F.format_string("mismatch=-%d", penalty)),
        )
        made = lambda b, r: F.struct(b.cast("int").alias("bonus"), r.alias("reason"))
        return (
            F.when(size0(anchor) == 0, made(F.lit(0), F.lit("no-anchors")))
            .when(F.size(said) == 0, made(F.lit(0), F.lit("empty-caption")))
            .otherwise(made(F.greatest(F.lit(0), F.least(bonus, F.lit(35))), reason))
        )

    return let(tokens(F.coalesce(caption, F.lit("")), "[a-z0-9]+", rules.grounding_stopwords), scored)


#: Rank of a caption that fails, by reason; 10 otherwise.
PENALTIES = {"too-long": 45, "meta-leak": 25, "truncated": 30, "too-short": 20, "no-tech-joke": 35, "tech-jargon": 35, "neutral-copy": 15, "error": 0, "placeholder": 0, "empty": 0}


def with_rank(captions: DataFrame, rules: RuleBook) -> DataFrame:
    """RNK-1: adds ok, score_rank, score_reason to (text, style, and facts if there)."""
    facts = F.col("facts") if "facts" in captions.columns else None
    penalties = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])
    scored = captions.withColumn("_reason", rules_of.score_reason(F.col("text"), F.col("style"), rules, facts))
    scored = scored.withColumn("_held", rules_of.placeholder(F.coalesce("text", F.lit("")), rules))
    length_bonus = F.greatest(F.lit(0), 10 - F.floor(F.abs(word_count(F.coalesce("text", F.lit(""))) - 42) / 3)).cast("int")
    base = F.lit(100) + length_bonus
    if facts is None:
        rank, reason = base, F.lit("ok")
    else:
        has = F.coalesce(facts, F.lit("")) != ""
        scored = scored.withColumn("_g", grounding(anchors(facts, rules), action_verbs(facts, rules), F.col("text"), rules))
        rank = base + F.when(has, F.col("_g.bonus")).otherwise(0)
        reason = F.when(has, F.concat(F.lit("ok+"), F.col("_g.reason"))).otherwise("ok")
    ok = (F.col("_reason") == "ok") & ~F.col("_held")
    return (
        scored.withColumn("ok", ok)
        .withColumn("score_rank", F.when(F.col("_held"), 0).when(ok, rank).otherwise(F.coalesce(F.try_element_at(penalties, F.col("_reason")), F.lit(10))))
        .withColumn("score_reason", F.when(F.col("_held"), "friendly-placeholder").when(ok, reason).otherwise(F.col("_reason")))
        .drop("_reason", "_held", "_g")
    )


def _by_rank() -> Window:
    words = word_count(F.coalesce("text", F.lit("")))
    return Window.partitionBy("task_id", "style").orderBy(F.desc("score_rank"), F.desc("ok"), words.desc(), "pool_index")


def best_of_n(candidates: DataFrame) -> DataFrame:
    """WIN-1: the best candidate of each (task_id, style); ties go to the lowest pool index."""
    return candidates.withColumn("_r", F.row_number().over(_by_rank())).where("_r = 1").drop("_r")


def close_calls(candidates: DataFrame, settings: Settings) -> DataFrame:
    """WIN-2, first half: best and runner-up, both at 100 or more and within the margin."""
    second = lambda c: F.lead(c).over(_by_rank()).alias(f"second_{c}")
    both = candidates.select("*", F.row_number().over(_by_rank()).alias("_r"), second("pool_index"), second("score_rank"), second("text"))
    near = (F.col("score_rank") >= 100) & (F.col("second_score_rank") >= 100) & (F.col("score_rank") - F.col("second_score_rank") <= settings.tie_margin)
    return both.where((F.col("_r") == 1) & near).drop("_r")


def break_ties(calls: DataFrame, scores: DataFrame) -> DataFrame:
    """WIN-2, second half: the winning pool index by 2 * accuracy + style_match of ``scores`` (task_id, style, pool_index, accuracy, style_match).

    Equal or both missing: the best stays; one missing: the other wins.
    """
    points = scores.select("task_id", "style", "pool_index", (2 * F.col("accuracy") + F.col("style_match")).alias("points"))
    first = points.withColumnRenamed("points", "first_points")
    second = points.select("task_id", "style", F.col("pool_index").alias("second_pool_index"), F.col("points").alias("second_points"))
    joined = calls.join(first, ["task_id", "style", "pool_index"], "left").join(second, ["task_id", "style", "second_pool_index"], "left")
    wins = F.col("second_points").isNotNull() & (F.col("first_points").isNull() | (F.col("second_points") > F.col("first_points")))
    return joined.withColumn("winner", F.when(wins, F.col("second_pool_index")).otherwise(F.col("pool_index")))


def similar_styles(captions: DataFrame, settings: Settings) -> DataFrame:
    """JON-4: pairs of styles of a task whose content words overlap by the warning bar (Jaccard); one row a (task_id, style) is expected."""
    words = captions.select("task_id", "style", tokens(F.coalesce("text", F.lit("")), "[a-z']+").alias("w"))
    other = words.select(F.col("task_id").alias("_t"), F.col("style").alias("style2"), F.col("w").alias("w2"))
    pairs = words.join(other, (F.col("task_id") == F.col("_t")) & (F.col("style") < F.col("style2")))
    jaccard = F.when((F.size("w") == 0) | (F.size("w2") == 0), 0.0).otherwise(F.size(F.array_intersect("w", "w2")) / F.size(F.array_union("w", "w2")))
    return pairs.withColumn("similarity", jaccard).where(F.col("similarity") >= settings.similarity_warning).select("task_id", F.col("style").alias("style1"), "style2", "similarity")


def rule_totals(captions: DataFrame, rules: RuleBook) -> DataFrame:
    """AGG-6: one row: passes and captions."""
    reason = rules_of.score_reason(F.col("text"), F.col("style"), rules)
    return captions.agg(F.count_if(reason == "ok").alias("passes"), F.count("*").alias("total"))


def rule_report(captions: DataFrame, rules: RuleBook, settings: Settings) -> DataFrame:
    """AGG-6: (kind, task_id, line): a `fail` line for each caption that breaks a rule and a `warning` line for each two styles of a task that are too alike."""
    reason = rules_of.score_reason(F.col("text"), F.col("style"), rules)
    failed = captions.withColumn("_r", reason).where("_r <> 'ok'").select(F.lit("fail").alias("kind"), "task_id", F.format_string("%s/%s: %s", F.col("task_id").cast("string"), "style", "_r").alias("line"))
    share = F.bround(F.col("similarity") * 100, 0).cast("int")
    alike = similar_styles(captions, settings).select(F.lit("warning").alias("kind"), "task_id", F.format_string("%s/%s vs %s: high similarity (%d%%)", F.col("task_id").cast("string"), "style1", "style2", share).alias("line"))
    return failed.unionByName(alike)


# --- salvage -------------------------------------------------------------------------------------------------------


def _tails(text: Column, most: int) -> Column:
    """The last one to ``most`` sentences."""
    return let(
        sentences(text),
        lambda parts: F.when(F.size(parts) == 0, _strings()).otherwise(
            F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.greatest(F.size(parts), F.lit(1)))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), " "))
        ),
    )


def _without_label(text: Column, rules: RuleBook) -> Column:
    return F.when(F.lower(trimmed(text)).rlike(rf"^(?:{alternation(rules.label_prefixes)})"), F.regexp_replace(trimmed(text), rf"(?i)^(?:{alternation(rules.label_prefixes)})\s*", ""))


def _without_leaks(text: Column, rules: RuleBook) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: (x != "") & ~F.lower(x).rlike(rf"^(?:{alternation(rules.leak_prefixes)})"))
    return F.array_join(lines, " ")


def salvage_candidates(raw: Column, rules: RuleBook) -> Column:
    """SAL-1: captions that may hide in a reply, cheapest first, distinct: JSON, quoted spans, without label, without notes, paragraphs from the end, last sentences."""

    def found(t: Column, blocks: Column) -> Column:
        whole = F.when(t.startswith("{"), F.get_json_object(t, "$.caption"))
        inner = F.get_json_object(F.regexp_extract(t, r'(?s)(\{"caption".*\})', 1), "$.caption")
        quoted = F.transform(F.regexp_extract_all(t, F.lit(r'"([^"]{40,400})"'), F.lit(1)), trimmed)
        quoted = F.filter(quoted, lambda s: s.rlike(r"^\p{Lu}") & s.rlike(r"[.!?]$") & (word_count(s) >= 8))
        by_words = F.array_sort(F.transform(quoted, lambda s, i: F.struct((-word_count(s)).alias("n"), i.alias("i"), s.alias("s"))))
        of_blocks = F.flatten(F.transform(blocks, lambda b: F.concat(F.array(b, _without_label(b, rules), _without_leaks(b, rules)), _tails(b, 3))))
        every = F.concat(F.array(trimmed(F.coalesce(whole, inner))), F.transform(by_words, lambda x: x["s"]), F.array(_without_label(t, rules), _without_leaks(t, rules)), of_blocks, _tails(t, 3))
        return F.array_distinct(F.filter(F.transform(every, trimmed), lambda c: c.isNotNull() & (c != "")))

    def of_text(t: Column) -> Column:
        blocks = F.filter(F.transform(F.split(t, r"\n\s*\n"), trimmed), lambda b: b != "")
        several = let(blocks, lambda b: F.when(F.size(b) > 1, F.reverse(b)).otherwise(_strings()))
        return F.when(t == "", _strings()).otherwise(let(several, lambda b: found(t, b)))

    return let(trimmed(F.coalesce(raw, F.lit(""))), of_text)


def first_valid(candidates: Column, bad) -> Column:
    """SAL-2: the first candidate that ``bad`` (Column -> boolean Column) does not refuse."""
    return F.get(F.filter(candidates, lambda c: ~bad(c)), F.lit(0))


def first_valid_rows(rows: DataFrame, key: str, candidates: str, bad) -> DataFrame:
    """SAL-2 for a table with one row a ``key``: (key, caption). Candidates become rows, so the rules run as compiled code; a partial aggregate brings them together."""
    flat = rows.select(key, F.posexplode_outer(candidates).alias("_ord", "_c"))
    found = flat.groupBy(key).agg(F.min(F.when(F.col("_c").isNotNull() & ~bad(F.col("_c")), F.struct("_ord", "_c"))).alias("_f"))
    return found.select(key, F.col("_f._c").alias("caption"))


def longest_fit(candidates: Column, limit: Column, bad) -> Column:
    """SAL-3: the longest valid tail of one or two sentences within the limit of words; ties go to the first."""
    tails = F.array_distinct(F.flatten(F.transform(candidates, lambda c: _tails(c, 2))))
    ranked = F.transform(tails, lambda s, i: F.struct(word_count(s).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(F.filter(ranked, lambda x: (x["n"] <= limit) & ~bad(x["s"])))["s"]


def _bare(raw: Column) -> Column:
    return F.regexp_replace(trimmed(F.coalesce(raw, F.lit(""))), r"""(?s)^(["'])(.*)\1$""", "$2")


def normalised_reply(raw: Column, style: Column, rules: RuleBook) -> Column:
    """SAL-4: without one pair of quotes around; if bad, the first valid candidate, else the longest fit, else the reply itself."""
    bare = _bare(raw)
    bad = lambda c: ~rules_of.good_output(c, style, rules)
    found = salvage_candidates(bare, rules)
    return F.when(~bad(bare), bare).otherwise(F.coalesce(first_valid(found, bad), longest_fit(found, rules_of.word_limit(style, rules), bad), bare))


def normalised_replies(rows: DataFrame, key: str, raw: str, style: str, rules: RuleBook) -> DataFrame:
    """SAL-4 for a table with one row a ``key``: (key, caption).

    What a reply may become is one list in order of preference: valid candidates by place, then fitting tails from the longest, then the reply itself. Its entries are rows, so
    the rules run as compiled code, and a partial aggregate takes the least that they don't refuse. A good reply has one entry and salvages nothing.
    """
    option = lambda kind, a, b, text: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), text.alias("text"))
    itself = F.array(option(3, F.lit(0), F.lit(0), F.col("_bare")))

    def salvaged(found: Column) -> Column:
        tails = F.array_distinct(F.flatten(F.transform(found, lambda c: _tails(c, 2))))
        return F.concat(F.transform(found, lambda c, i: option(1, i, F.lit(0), c)), F.transform(tails, lambda s, i: option(2, -word_count(s), i, s)), itself)

    bare = with_once(rows.select(key, style, _bare(F.col(raw)).alias("_bare")), _good=rules_of.good_output(F.col("_bare"), F.col(style), rules))
    options = F.when(F.col("_good"), itself).otherwise(let(salvage_candidates(F.col("_bare"), rules), salvaged))
    flat = bare.select(key, style, F.explode(options).alias("_o"))
    fits = (F.col("_o.kind") == 1) | (-F.col("_o.a") <= rules_of.word_limit(F.col(style), rules))
    kept = (F.col("_o.kind") == 3) | (fits & rules_of.good_output(F.col("_o.text"), F.col(style), rules))
    return flat.groupBy(key).agg(F.min(F.when(kept, F.col("_o"))).alias("_o")).select(key, F.col("_o.text").alias("caption"))
