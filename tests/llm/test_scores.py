"""Toxicity, quality and language: held-out accuracy on small invented corpora, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwright.llm import language, quality, toxicity
from clipwright.llm.common import TokenTable

WORDS = "river stone lantern meadow copper window garden basket thunder market ladder pepper silver orange castle button".split()
ODD = [(None,), ("",), ("!!! ...",), ("a",), ("stone " * 40_000,), ("d o l t",)]


def sentence(rng, n=30):
    return " ".join(rng.choices(WORDS, k=n))


def test_unit_kernel():
    f = lambda u: toxicity.subsequences([toxicity.codes(u)])

    def kernel(a, b):
        (fa, wa), (fb, wb) = f(a), f(b)
        return sum(x * y for i, x in zip(fa[0], wa[0], strict=True) for j, y in zip(fb[0], wb[0], strict=True) if i and i == j)

    assert kernel("dolt", "dolt") == pytest.approx(1, abs=1e-5)
    assert kernel("d.o.l.t", "dolt") > 0.3 > kernel("meadow", "dolt")
    assert kernel("do1t", "doit") > kernel("doxlt", "meadow")
    assert toxicity.codes("...") == b"" and len(toxicity.windows("x" * 100)) > 3


def test_toxicity(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        text, bad = sentence(rng), k % 4 == 0
        if bad:
            text = text.replace(" ", f" {rng.choice(['wretchling', 'doltface'])} ", 1)
        rows.append((text + f" {k}", int(bad)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, label int"), landmarks=40)
    fresh = [sentence(rng) for _ in range(40)]
    tests = [(x, 0) for x in fresh] + [(x.replace(" ", f" {w} ", 1), 1) for x, w in zip(fresh, ["wretchling", "w.r.e.t.c.h.l.i.n.g", "dolt-face", "doltxface"] * 10, strict=True)]
    got = toxicity.score_toxicity(spark.createDataFrame(tests, "text string, y int"), model).collect()
    assert len(got) == 80 and np.mean([(r.score >= 0.5) == r.y for r in got]) > 0.9


def test_toxicity_odd_inputs(spark):
    empty = toxicity.fit_toxicity(spark.createDataFrame([], "text string, label int"))
    df = spark.createDataFrame(ODD, "text string").withColumn("score", F.lit("old")).withColumn("_tox", F.lit(1))
    rows = toxicity.score_toxicity(df.union(df), empty).collect()
    assert len(rows) == 2 * len(ODD) and all(0 <= r.score < 0.5 and r["_tox"] == 1 for r in rows)
    assert toxicity.score_toxicity(df.limit(0), empty).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: sentence(rng).capitalize() + ". " + sentence(rng).capitalize() + "."
    bad = lambda: rng.choice([sentence(rng).upper().replace(" ", "!! "), " ".join(w + "%%%" for w in sentence(rng).split()), "stone stone stone " * 15])
    rows = [(good(), 1) if k % 3 else (bad(), 0) for k in range(300)]
    model = quality.fit_quality(spark.createDataFrame(rows, "text string, label int"))
    tests = [(good(), 1) for _ in range(40)] + [(bad(), 0) for _ in range(40)]
    got = quality.score_quality(spark.createDataFrame(tests, "text string, y int"), model).collect()
    assert np.mean([(r.score >= 0.5) == r.y for r in got]) > 0.95
    odd = spark.createDataFrame(ODD, "text string").withColumn("score", F.lit("old"))
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd.union(odd), model).collect())
    alone = quality.fit_quality(spark.createDataFrame([("x", 1)], "text string, label int"))
    none = quality.fit_quality(spark.createDataFrame([], "text string, label int"))
    assert quality.score_quality(odd, alone).first().score > 0.5 and quality.score_quality(odd, none).first().score == 0.5


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    dims = quality.BUCKETS + len(quality.STATS)
    fm = quality.FactorMachine(0.3, rng.normal(size=dims), rng.normal(size=(dims, quality.RANK)), np.zeros(1), np.ones(1))
    idx, val = rng.choice(dims, 7, replace=False), rng.normal(size=7)
    pairs = sum(fm.factor[idx[i]] @ fm.factor[idx[j]] * val[i] * val[j] for i in range(7) for j in range(i))
    assert fm.raw(idx, val, np.array([0]))[0][0] == pytest.approx(0.3 + fm.weight[idx] @ val + pairs)


LANGS = {"aa": "the river runs over old stones and under the bridge", "bb": "der fluss fliesst unter die alte bruecke und das ufer", "cc": "la riviere coule sous le vieux pont avec les pierres"}


def test_language(spark):
    rng = random.Random(1)
    say = lambda lang, n=40: " ".join(rng.choices(LANGS[lang].split(), k=n))
    docs = [(k, say(lang), lang) for k in range(60) for lang in LANGS] + [(900, None, "aa"), (901, "x", None)]
    model = language.fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    tests = [(say(lang, 8), lang) for lang in LANGS for _ in range(10)] + [(None, "und"), ("", "und"), ("12 !!", "und")]
    df = spark.createDataFrame(tests, "text string, y string").withColumn("score", F.lit(1))
    got = language.identify(df, model).collect()
    assert all(r.lang_pred == r.y for r in got) and all((r.score == 0) == (r.y == "und") for r in got)
    assert language.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert language.identify(df, None).first().lang_pred == "und"


def test_language_learns_from_every_document(spark):
    """Far more documents of a language than 600, each with a word of its own: the model holds the n-grams of all that don't calibrate it."""
    letters = lambda k: "".join(chr(97 + int(d)) for d in f"{k:04d}")
    df = spark.createDataFrame([(k, f"{letters(k)}z", "aa") for k in range(2000)], "doc_id long, text string, lang string")
    model = language.fit_languages(df)
    trains = [r.doc_id for r in df.where(~language.calibrating(df)).collect()]
    last = np.array([language.grams([f"{letters(k)}z"])[2][4][5] for k in trains])
    assert len(trains) > 1400 and (model.find(last) < len(model.keys)).all() and np.isfinite(model.times).all()


def test_language_with_more_grams_than_a_task_holds(spark):
    """Beyond the bound no n-gram is left out: all scores are those of the model that holds them all, by the dictionary, by joins and in small blocks."""
    rng = random.Random(2)
    rare = [(k, " ".join(rng.choices(LANGS[lang].split(), k=30)) + f" {lang}{'éßñz'[k % 4]}q{chr(97 + k % 26)}ux{chr(97 + k // 26)} 12,x", lang) for k in range(160) for lang in LANGS]
    docs = spark.createDataFrame(rare + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    tests = [(t.split()[-2], None) for _, t, _ in rare[:60]] + [(t, "z") for _, t, _ in rare[:30]] + [(t, t) for t in (None, "", "12 !!", "x" * 900, "Ünseen ωords", "x", "x")]
    df = spark.createDataFrame(tests, "text string, score string")
    whole, wide = language.fit_languages(docs), language.fit_languages(docs, most_grams=10)
    assert isinstance(wide, language.WideModel) and wide.grams.count() == len(whole.keys)
    assert (wide.model.usual, wide.model.times, wide.model.calibration) == tuple(pytest.approx(x, rel=1e-3) for x in (whole.usual, whole.times, whole.calibration))
    key = lambda rows: sorted((str(r.text), r.lang_pred, r.rejected, r.score, r.cross_entropy) for r in rows)
    wanted = key(language.identify(df, whole).collect())
    fields = "lang_pred string, score double, cross_entropy double, rejected boolean, size double"
    for got in (language.identify(df, wide), language.wide_scores(df.drop("score"), "text", wide, fields, hot=20, block_grams=300), language.wide_scores(df.drop("score"), "text", wide, fields, hot=0)):
        for a, b in zip(key(got.collect()), wanted, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=2e-3)
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([("12 !!",)], "text string"), wide).collect()] == ["und"]


def brute_kneser_ney(words):
    """Interpolated Kneser-Ney by definition, with dictionaries: the log probability of a word between boundary signs."""
    raw = {}
    for w, n in words.items():
        t = f" {w} "
        for i in range(1, len(t)):
            for k in range(1, min(language.ORDER, i + 1) + 1):
                raw[t[i - k + 1 : i + 1]] = raw.get(t[i - k + 1 : i + 1], 0) + n
    counts = {}
    for g, n in raw.items():
        left = len({h for h in raw if len(h) == len(g) + 1 and h[1:] == g})
        counts[g] = n if len(g) == language.ORDER or (len(g) > 1 and g[0] == " ") else left or 1
    discount = {}
    for k in range(1, language.ORDER + 1):
        of = [c for g, c in counts.items() if len(g) == k]
        ones, twos = of.count(1), of.count(2)
        discount[k] = min(max(ones / max(1, ones + 2 * twos), 0.1), 0.9)

    def p(context, ch):
        k = len(context) + 1
        of = [c for g, c in counts.items() if len(g) == k and g[:-1] == context]
        d, c = discount[k], counts.get(context + ch, 0)
        lower = p(context[1:], ch) if context else 1 / language.CHARACTERS
        return (max(c - d, 0) + d * len(of) * lower) / sum(of) if of else lower

    return lambda w: sum(np.log(p(t[max(0, i - language.ORDER + 1) : i], t[i])) for t in [f" {w} "] for i in range(1, len(t)))


def test_language_model_by_definition(spark):
    import pandas as pd

    words = {"a": {"abab": 3, "abc": 2, "cab": 1, "abcabd": 1, "b": 5}, "b": {"bca": 4, "bcaa": 1, "dd": 2}}
    model = language.train(pd.DataFrame([(k, w, n) for k, of in words.items() for w, n in of.items()], columns=["lang", "word", "n"]))
    for w in ("abab", "abc", "b", "cabab", "dd", "abcabd", "xa", "bcaz"):
        assert model.word_logp([w])[0] == pytest.approx([brute_kneser_ney(words[k])(w) for k in ("a", "b")], rel=2e-4)
    texts = [("Abab, abc_abc! 12 É é", "a"), ("abc-É\u0131x", "a"), ("漢字 b", "b"), ("", "b")]
    counted = {(r.lang, r.word): r.n for r in language.word_counts(spark.createDataFrame(texts, "text string, lang string")).collect()}
    assert counted == {("a", "abab"): 1, ("a", "abc"): 3, ("a", "é"): 2, ("a", "éıx"): 1, ("b", "漢字"): 1, ("b", "b"): 1}


def test_rare_grams_go_first(spark):
    rows = spark.createDataFrame([(k, float(n)) for k, n in enumerate([1] * 50 + [2] * 20 + [9] * 5)], "key long, n double")
    assert [language.frequent(rows, m).count() for m in (75, 74, 25, 24, 5, 4)] == [75, 25, 25, 5, 5, 0]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_right_texts_are_seldom_rejected(spark, sf):
    import os

    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("needs the given tables")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    found = language.op3_language_id(spark, f"/root/testdata/{sf}").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred = lang")
    n, refused = found.count(), found.where("rejected").count()
    assert n > 200 and refused < 0.01 * n
    model = language.fit_languages(docs.where(language.crc_fold("doc_id", 4) != 2))
    junk = spark.createDataFrame([("xkq zzvw qqpx wkjx zzqk pqxz vvwk xxqj zkzk qqww",), ("Это совсем другой язык и другие буквы",), ("漢字の文章はここにあります",)], "text string")
    assert all(r.rejected for r in language.identify(junk, model).collect())


def test_language_model_sums_to_one():
    import pandas as pd

    words = pd.DataFrame({"lang": ["a", "a", "a", "b"], "word": ["abab", "abc", "cab", "bca"], "n": [3, 2, 1, 4]})
    model = language.train(words)
    after = lambda start, ch: np.exp(model.word_logp([start + ch])[0] - model.word_logp([start])[0] + _end(model, start) - _end(model, start + ch))
    for start in ("", "a", "ab", "cab"):
        seen = sum(after(start, ch) for ch in "abc") + np.exp(_end(model, start))
        assert seen + (language.CHARACTERS - 4) * after(start, "z") == pytest.approx(np.ones(2), abs=2e-3)


def _end(model, word):
    """Log probability of the closing sign after ``word``."""
    owner, place, hashes = language.grams([word])
    lp, before = None, None
    for n, h in enumerate(hashes):
        at = model.find(h)
        lp = model.logp[at] if lp is None else np.where((place >= n)[:, None], np.where((at < len(model.keys))[:, None], model.logp[at], lp + model.backoff[before]), lp)
        before = np.concatenate([[len(model.keys)], at[:-1]])
    return lp[-1].astype(float)


def test_token_table_forgets_without_harm():
    calls = []
    t = TokenTable(lambda names: calls.append(len(names)) or np.array([len(x) for x in names], float), most=3)
    for words in (["a", "bb"], ["ccc", "dddd", "a"], ["a", "eeeee"], []):
        ids, rows = t(words)
        assert [rows[i] for i in ids] == [len(w) for w in words]
