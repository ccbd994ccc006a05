"""Rules on captions, branch by branch."""

import pytest
from pyspark.sql import functions as F

from clipwright.config import RuleBook, Settings
from clipwright.functions.text import sentences, tokens, trimmed, word_count
from clipwright.operators import captions as op
from clipwright.operators import text_rules as t

RULES, SETTINGS = RuleBook(), Settings()
GOOD = "A small boat crosses the quiet bay at dawn. Gulls circle above the wooden mast."
FACTS = "Primary subject: boat (colors: white, blue) [torn sail]\nSetting: quiet bay\nActions (early): drifting past rocks\nBackground: grey cliffs"


def col(spark, column, *rows, names=("text", "style", "facts")):
    df = spark.createDataFrame([tuple(r) + (None,) * (len(names) - len(r)) for r in rows], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("", "empty"),
        (None, "empty"),
        ("  \n ", "empty"),
        ("Setting: a bay. More words follow here.", "describe-dump"),
        ("First the camera: pans, then background: cliffs.", "describe-dump"),
        ("Outline: two lines about a boat on the water.", "meta-leak"),
        ("- a boat on the bay near the rocks today.", "meta-leak"),
        ('He said "row and left the bay in the evening light.', "meta-leak"),
        ("A white boat crosses the wide bay and then it goes to the.", "meta-leak"),
        ("A white boat crosses the wide quiet bay at", "incomplete"),
        ("A boat sails.", "incomplete"),
        ("The white boat crosses the bay on a backgr.", "incomplete"),
        ("## A heading about a boat on the quiet bay.", "meta-leak"),
        ("2) A boat on the quiet bay near the rocks.", "meta-leak"),
        ("A boat (7) drifts past the rocks and rope (3) lies about.", "meta-leak"),
        ("A white boat crosses the wide quiet bay today,.", "meta-leak"),
        (GOOD, ""),
    ],
)
def test_hard_fail(spark, text, reason):
    assert col(spark, t.hard_fail(F.col("text"), RULES), (text,)) == [reason]


@pytest.mark.parametrize(
    "text, style, reason",
    [
        ("Failed to write anything at all here.", "formal", "error"),
        ("Video caption (missing) for this clip of ours.", "formal", "placeholder"),
        ("Footage of a boat that crosses the bay at dawn.", "formal", "neutral-copy"),
        (GOOD, "formal", "ok"),
        (GOOD, "humorous_tech", "no-tech-joke"),
        ("The boat wants a firmware patch before Friday. Nobody on deck minds that.", "humorous_tech", "ok"),
        ("The boat needs a reboot before it meets the rocks. Nobody on deck minds it.", "humorous_non_tech", "tech-jargon"),
        ("word " * 60 + "end.", "formal", "too-long"),
    ],
)
def test_score_reason(spark, text, style, reason):
    assert col(spark, t.score_reason(F.col("text"), F.col("style"), RULES), (text, style)) == [reason]


def test_bad_output_and_limits(spark):
    rows = [("", "formal"), ("As requested, a boat rests on the quiet bay.", "formal"), ("word " * 59 + "end.", "formal"), ("word " * 59 + "end.", "sarcastic"), (GOOD, "formal")]
    assert col(spark, t.bad_output(F.col("text"), F.col("style"), RULES), *rows) == ["EmptyResponse", "MetaLeak", "TooLong", "", ""]


def test_last_characters_differ(spark):
    assert col(spark, t.truncated(F.col("text")), ("the boats'",), ("boats.",), ("",)) == [True, False, False]


def test_scene_mismatch(spark):
    rows = [("A goat sleeps on the deck of the boat today.", "", FACTS), ("The boat drifts on.", "", FACTS), ("A red car races through a tunnel.", "", FACTS), ("A red car races.", "", ""), ("A red car races.", "", None)]
    assert col(spark, t.scene_mismatch(F.col("facts"), F.col("text"), RULES), *rows) == [True, False, True, False, False]


def test_example_echo(spark):
    examples = F.array(F.lit("a boat crosses the bay at dawn."))
    assert col(spark, t.example_echo(F.col("text"), examples), (' "A boat  crosses the bay at dawn." ',), ("A boat crosses the bay at dawn. Yes",), ("A boat.",), ("",)) == [True, True, False, False]


def test_sentences_words_tokens(spark):
    assert col(spark, sentences(F.col("text")), ("One. Two!  Three",), ("",)) == [["One.", "Two!", "Three."], []]
    assert col(spark, word_count(F.col("text")), ("",), (" a\nb  c ",)) == [0, 3]
    assert col(spark, tokens(F.col("text"), stopwords=("the",)), ("The boat, the BOAT at 100",)) == [["100", "boat"]]


def test_grounding(spark):
    bonus = op.grounding(op.anchors(F.col("facts"), RULES), op.action_verbs(F.col("facts"), RULES), F.col("text"), RULES)["bonus"]
    near, vague, none = col(spark, bonus, ("The white boat is drifting past the quiet bay", "", FACTS), ("Something happens here", "", FACTS), ("A boat", "", ""))
    assert near > vague == none == 0 and near <= 35


def test_rank_best_and_ties(spark):
    rows = [("t", "formal", k, x) for k, x in enumerate([GOOD, GOOD, "bad", RULES.placeholders[0]])]
    df = op.with_rank(spark.createDataFrame(rows, "task_id string, style string, pool_index int, text string"), RULES)
    got = {r.pool_index: (r.ok, r.score_rank) for r in df.collect()}
    assert all((rank >= 100) == ok for ok, rank in got.values()) and got[3][1] == 0
    assert op.best_of_n(df).first().pool_index == 0
    calls = op.close_calls(df, SETTINGS)
    scores = lambda a, b: spark.createDataFrame([("t", "formal", k, x, x) for k, x in ((0, a), (1, b)) if x is not None], "task_id string, style string, pool_index int, accuracy double, style_match double")
    winner = lambda a, b: op.break_ties(calls, scores(a, b)).first().winner
    assert (winner(0.5, 0.9), winner(0.9, 0.5), winner(0.5, 0.5), winner(None, 0.1), winner(0.1, None)) == (1, 0, 0, 1, 0)


def test_salvage(spark):
    raw = 'Caption: Notes first.\n\nI wrote "A small boat crosses the quiet bay at the first dawn." today.\n\n' + GOOD
    (found,) = col(spark, op.salvage_candidates(F.col("text"), RULES), (raw,))
    assert found[0] == "A small boat crosses the quiet bay at the first dawn." and GOOD in found and len(found) == len(set(found))
    assert col(spark, op.salvage_candidates(F.col("text"), RULES), ('{"caption": "A boat."}',), ("",), (None,)) == [["A boat.", '{"caption": "A boat."}', '{"caption": "A boat."}.'], [], []]
    assert col(spark, op.normalised_reply(F.col("text"), F.lit("formal"), RULES), (f'"{GOOD}"',), (f"Outline: words\n\n{GOOD}",)) == [GOOD, GOOD]


def test_no_python_in_plans(spark):
    df = op.with_rank(spark.createDataFrame([("a", "formal", "x")], "text string, style string, facts string"), RULES)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_words_and_ends(spark):
    rows = [("",), (" \t\n\x0b\f\r",), ("  a  b\tc\n",), ("x",), (None,), ("\u00a0a\u00a0",)]
    assert col(spark, word_count(F.col("text")), *rows) == [0, 0, 3, 1, None, 1]
    assert col(spark, trimmed(F.col("text")), *rows) == ["", "", "a  b\tc", "x", None, "\u00a0a\u00a0"]
    assert col(spark, sentences(F.col("text")), ("A b.  C d!\n\nE",), ("A.B c?d",), ("... .x",)) == [["A b.", "C d!", "E."], ["A.B c?d."], ["...", ".x."]]


def test_replies_as_a_table_agree_with_the_column(spark):
    texts = [None, "", '"', '""', f'"{GOOD}"', f"Outline: words\n\n{GOOD}", f"Caption: {GOOD}", "word " * 300, GOOD + " " + "and then it " * 40 + "stops. " + GOOD, "no end"]
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate((t, s) for t in texts for s in ("formal", "sarcastic"))], "id long, raw string, style string")
    one = df.select("id", op.normalised_reply(F.col("raw"), F.col("style"), RULES).alias("caption"))
    many = op.normalised_replies(df, "id", "raw", "style", RULES)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert op.normalised_replies(df.limit(0), "id", "raw", "style", RULES).count() == 0
