"""Language identification: an interpolated Kneser-Ney character model for each language.

A word is read between two boundary signs, and no character looks back past its word; so a text costs one lookup for each of its
tokens once a distinct token has been scored.  All n-grams of all languages lie in one sorted array of 64-bit hashes, with the full
log probability and the back-off weight of every language beside each.  The language with the least cross-entropy, in nats
a character, is chosen.  `rejected` tells texts whose cross-entropy is further above the language's mean than texts of that length are: the spread of
rightly named texts is fitted as a variance between texts plus one that falls with their length, and the limit lies where LIMIT of them end, by the
language's own texts where there are SURE of them, by those of all languages else, and never below LEAST of that spread.

More n-grams than MOST_GRAMS stay in a table (`WideModel`): their probabilities come from joins, an order at a time, distinct tokens meet the n-grams they
hold in blocks, and documents meet the scores of their tokens.  It is the same model with the same scores, without any n-gram left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TokenTable, chunks, crc_fold, fresh, small_batches, stage, table, with_scores

ORDER = 5
#: Characters that the model reserves probability for.
CHARACTERS = 65_536
#: Share of right texts within the limit, texts from which a quantile is taken for it, and the least limit in standard deviations.
LIMIT, SURE, LEAST = 0.999, 1_000, 4.5
#: One of so many documents, by a hash of its id, calibrates the model, but about so many a language at most; the others train it.
CALIBRATES, CALIBRATE_MOST = 5, 2_000
#: Tokens that a scoring task keeps, n-grams of all languages up to which a task holds them all, and those of a block of tokens beyond.
TOKENS, MOST_GRAMS, BLOCK_GRAMS = 300_000, 3_000_000, 2_000_000
RUNS = re.compile(r"[^\W\d_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word of each position, position within it, hashes by order) of words between boundary signs; 0: no such n-gram there.

    The opening sign itself is no position to predict, but it belongs to contexts.
    """
    text = "".join(f" {w} " for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    place = np.arange(len(chars)) - np.repeat(starts, sizes)
    hashes, h = [], np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        code = chars * np.uint64(0xD6E8FEB86659FD93)
        for n in range(1, ORDER + 1):
            before = np.zeros_like(h)
            before[1:] = h[:-1]
            h = (before ^ (before >> np.uint64(29))) * FACTOR + code + np.uint64(n)
            h[place < n - 1] = 0
            hashes.append(h)
    return np.repeat(np.arange(len(words)), sizes), place, hashes


@dataclass
class LanguageModel:
    langs: list[str]
    keys: np.ndarray  #: sorted hashes of all n-grams
    logp: np.ndarray  #: by key and language
    backoff: np.ndarray
    usual: np.ndarray  #: by language, the mean cross-entropy of its texts
    times: np.ndarray  #: by language, how many standard deviations above it are refused
    spread: tuple[float, float] = (1.0, 0.0)  #: variance between texts, and that of a text of one sign
    calibration: tuple[float, float] = (60.0, 0.0)

    def limit(self, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which texts of so many signs are rejected."""
        return self.usual[lang] + self.times[lang] * np.sqrt(self.spread[0] + self.spread[1] / np.maximum(size, 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or the last row, which stands for what is missing."""
        at = np.searchsorted(self.keys, h)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == h, at, len(self.keys))

    def word_logp(self, words: list[str]) -> np.ndarray:
        owner, place, hashes = grams(words)
        lp, before = None, None
        for n, h in enumerate(hashes):
            at = self.find(h)
            if lp is None:
                lp = self.logp[at]
            else:
                there = at < len(self.keys)
                lower = lp + self.backoff[before]
                step = np.where(there[:, None], self.logp[at], lower)
                lp = np.where((place >= n)[:, None], step, lp)
            before = np.concatenate([[len(self.keys)], at[:-1]])
        lp[place == 0] = 0
        starts = np.flatnonzero(place == 0)
        return np.add.reduceat(lp, starts, axis=0)

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """Sum of log probabilities by language, and characters, of the letters in each token."""
        out = np.zeros((len(tokens), len(self.langs) + 1), np.float32)
        words, owner = [], []
        for k, t in enumerate(tokens):
            for w in (t,) if t.isalpha() else RUNS.findall(t):
                words.append(w)
                owner.append(k)
        for at in range(0, len(words), 50_000):
            part, own = words[at : at + 50_000], np.array(owner[at : at + 50_000])
            np.add.at(out, own, np.hstack([self.word_logp(part), np.array([[len(w) + 1] for w in part])]).astype(np.float32))
        return out

    def entropies(self, texts: list[str | None], cache: TokenTable) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by text and language, letters and word ends of each text)."""
        total = np.zeros((len(texts), len(self.langs) + 1))
        for at, run in chunks(texts):
            split = [t.lower().split() for t in run]
            n = np.array([len(x) for x in split])
            if n.any():
                ids, rows = cache([w for x in split for w in x])
                full, starts = np.flatnonzero(n), np.concatenate([[0], np.cumsum(n)[:-1]])
                total[at + full] = np.add.reduceat(rows[ids].astype(np.float64), starts[full], axis=0)
        return -total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]

    def scorer(self):
        cache = TokenTable(self.token_rows, TOKENS)

        return lambda texts: self.verdict(*self.entropies(texts, cache))

    def verdict(self, ce: np.ndarray, size: np.ndarray) -> tuple:
        """(language, chance of being right, its cross-entropy, rejected, size) of each text."""
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        rest = ce.copy()
        rest[np.arange(len(ce)), best] = np.inf
        margin = np.minimum(rest.min(1) - low, 20) if len(self.langs) > 1 else np.full(len(ce), 20.0)
        a, b = self.calibration
        sure = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        none = size == 0
        langs = np.where(none, "und", np.array(self.langs, object)[best])
        return langs, np.where(none, 0.0, sure), np.where(none, 0.0, low), none | (low > self.limit(best, size)), size


GRAM_FIELDS = "ord int, key long, ctx long, suffix long, begins boolean, lang string, n double"


def counted(words: pd.DataFrame) -> pd.DataFrame:
    """Rows of GRAM_FIELDS, one for each n-gram and language of ``words`` (lang, word, n): the hashes of itself, its context and its suffix, whether it begins a word, its count."""
    owner, place, hashes = grams(words["word"].tolist())
    weight, lang = words["n"].to_numpy(float)[owner], words["lang"].to_numpy(object)[owner]
    parts = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero((place >= n - 1) & ((place > 0) | (n > 1)))
        key = hashes[n - 1][at].view(np.int64)
        lower = hashes[n - 2].view(np.int64) if n > 1 else np.zeros(len(owner), np.int64)
        parts.append(pd.DataFrame({"ord": n, "key": key, "ctx": lower[at - 1] if n > 1 else lower[at], "suffix": lower[at], "begins": place[at] == n - 1, "lang": lang[at], "n": weight[at]}))
    rows = pd.concat(parts, ignore_index=True)
    return rows.groupby(["ord", "key", "lang"], as_index=False, sort=False).agg({"ctx": "first", "suffix": "first", "begins": "first", "n": "sum"})[[f.split()[0] for f in GRAM_FIELDS.split(", ")]]


def train(words: pd.DataFrame) -> LanguageModel:
    """From ``words`` (lang, word, n)."""
    return smoothed(counted(words))


def smoothed(rows: pd.DataFrame) -> LanguageModel:
    """From ``rows`` of GRAM_FIELDS, one for each n-gram and language: probabilities from the lowest order up."""
    langs = sorted(rows["lang"].unique())
    lang = rows["lang"].astype("category").cat.set_categories(langs).cat.codes.to_numpy()
    hashed = {c: rows[c].to_numpy().view(np.uint64) for c in ("key", "ctx", "suffix")}
    order, begins, n_of = rows["ord"].to_numpy(), rows["begins"].to_numpy(), rows["n"].to_numpy()
    keys, counts, ctx, suffix = [], [], [], []
    opening = grams([""])[2][0][0]
    starts_word = []
    for n in range(1, ORDER + 1):
        pick = np.flatnonzero(order == n)
        uniq, first, inv = np.unique(hashed["key"][pick], return_index=True, return_inverse=True)
        c = np.zeros((len(uniq), len(langs)))
        np.add.at(c, (inv, lang[pick]), n_of[pick])
        at = pick[first]
        keys.append(uniq)
        counts.append(c)
        ctx.append(hashed["ctx"][at] if n > 1 else None)
        suffix.append(hashed["suffix"][at] if n > 1 else None)
        starts_word.append(begins[at])
    where = [lambda h, k=k: np.minimum(np.searchsorted(k, h), len(k) - 1) for k in keys]
    for n in range(ORDER - 1):  # below the highest order: in how many different contexts to the left; raw where a word begins
        cont = np.zeros_like(counts[n])
        np.add.at(cont, where[n](suffix[n + 1]), counts[n + 1] > 0)
        counts[n] = np.where(starts_word[n][:, None] & (n > 0), counts[n], np.where(cont > 0, cont, (counts[n] > 0) * 1.0))
    logp, backoff = [], [np.zeros_like(c) for c in counts]
    prob = []
    for n in range(ORDER):
        c = counts[n]
        ones, twos = (c == 1).sum(0), (c == 2).sum(0)
        d = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.9)
        if n == 0:
            total, kinds = c.sum(0), (c > 0).sum(0)
            p = np.maximum(c - d, 0) / total + d * kinds / total / CHARACTERS
            floor = d * kinds / total / CHARACTERS
        else:
            # The context is an n-gram of the order below, or the opening sign, which has no row of its own there.
            at = where[n - 1](ctx[n]) if n > 1 else np.where(ctx[n] == opening, len(keys[0]), where[0](ctx[n]))
            total, kinds = np.zeros((len(keys[n - 1]) + 1, len(langs))), np.zeros((len(keys[n - 1]) + 1, len(langs)))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
            backoff[n - 1] = gamma[:-1]
            if n == 1:  # the closing sign is the same character, so its row serves the opening one as a context
                backoff[0][where[0](opening)] = gamma[-1]
            lower = prob[n - 1][where[n - 1](suffix[n])]
            p = np.where(total[at] > 0, np.maximum(c - d, 0) / np.maximum(total[at], 1e-9), 0) + gamma[at] * lower
        prob.append(p)
        logp.append(np.log(p))
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    lp = np.vstack(logp)[order]
    bo = np.log(np.where((b := np.vstack(backoff)) > 0, b, 1.0))[order]
    return LanguageModel(langs, flat, np.vstack([lp, np.log(floor)]).astype(np.float32), np.vstack([bo, np.zeros(len(langs))]).astype(np.float32), np.zeros(len(langs)), np.full(len(langs), np.inf))


#: ASCII signs that are no letters: they part tokens, of which only the different ones are searched for words.
_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalpha())


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): the runs of letters of all ``rows`` (lang, text), in lower case, and how often each occurs."""
    tokens = rows.select("lang", F.explode(F.split(F.translate("text", _SIGNS, " " * len(_SIGNS)), " ", -1)).alias("token")).where("token <> ''")
    once = tokens.groupBy("lang", "token").agg(F.count("*").alias("n"))
    words = once.select("lang", "n", F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class WideModel:
    """A model whose n-grams stay in a table."""

    model: LanguageModel  #: without n-grams: languages, what an unknown character costs, and the limits
    grams: DataFrame  #: key, logp and backoff (arrays by language)


def smoothed_wide(rows: DataFrame) -> WideModel:
    """As ``smoothed``, on Spark: ``rows`` of GRAM_FIELDS, one for each n-gram and language, of any number."""
    langs = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]  # a row a language
    each = range(len(langs))
    by_lang = lambda x, name: [F.sum(F.when(F.col("lang") == lang, F.lit(x) if isinstance(x, float) else F.col(x)).otherwise(0.0)).alias(f"{name}{k}") for k, lang in enumerate(langs)]
    raw = rows.groupBy("ord", "key").agg(*[F.first(c).alias(c) for c in ("ctx", "suffix", "begins")], *by_lang("n", "c"))
    left = rows.where("ord > 1").groupBy((F.col("ord") - 1).alias("ord"), F.col("suffix").alias("key")).agg(*by_lang(1.0, "l"))
    seen = (F.col("ord") == ORDER) | (F.col("begins") & (F.col("ord") > 1))
    kinds = lambda k: F.when(F.coalesce(F.col(f"l{k}"), F.lit(0.0)) > 0, F.col(f"l{k}")).otherwise((F.col(f"c{k}") > 0).cast("double"))
    counts = stage(raw.join(left, ["ord", "key"], "left").select("ord", "key", "ctx", "suffix", *[F.when(seen, F.col(f"c{k}")).otherwise(kinds(k)).alias(f"c{k}") for k in each]))
    of = lambda test, name: [F.sum(test(F.col(f"c{k}")).cast("double")).alias(f"{name}{k}") for k in each]
    stats = {r["ord"]: r for r in counts.groupBy("ord").agg(*of(lambda c: c == 1, "ones"), *of(lambda c: c == 2, "twos"), *of(lambda c: c, "t"), *of(lambda c: c > 0, "k")).collect()}  # a row an order
    column = lambda n, name: np.array([stats[n][f"{name}{k}"] for k in each])
    d = {n: np.clip(column(n, "ones") / np.maximum(1, column(n, "ones") + 2 * column(n, "twos")), 0.1, 0.9) for n in stats}
    floor = d[1] * column(1, "k") / column(1, "t") / CHARACTERS
    lower = stage(counts.where("ord = 1").select("key", *[(F.greatest(F.col(f"c{k}") - float(d[1][k]), F.lit(0.0)) / float(column(1, "t")[k]) + float(floor[k])).alias(f"p{k}") for k in each]))
    probabilities, weights = [lower], []
    for n in range(2, max(stats) + 1):
        now = counts.where(F.col("ord") == n)
        gamma = lambda k, n=n: F.when(F.col(f"t{k}") > 0, float(d[n][k]) * F.col(f"k{k}") / F.col(f"t{k}")).otherwise(1.0)
        after = now.groupBy(F.col("ctx").alias("before")).agg(*of(lambda c: c, "t"), *of(lambda c: c > 0, "k"))
        after = stage(after.select("before", *[F.col(f"t{k}") for k in each], *[gamma(k).alias(f"g{k}") for k in each]))
        own = lambda k, n=n: F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"c{k}") - float(d[n][k]), F.lit(0.0)) / F.col(f"t{k}")).otherwise(0.0)
        below = lower.withColumnRenamed("key", "ends")
        lower = stage(now.join(after, F.col("ctx") == F.col("before")).join(below, F.col("suffix") == F.col("ends")).select("key", *[(own(k) + F.col(f"g{k}") * F.col(f"p{k}")).alias(f"p{k}") for k in each]))
        probabilities.append(lower)
        weights.append(after)
    parts = []
    for n, p in enumerate(probabilities):
        backoff = F.array(*[F.log(F.coalesce(F.col(f"g{k}"), F.lit(1.0))) for k in each]) if n < len(weights) else F.array(*[F.lit(0.0) for _ in each])
        p = p.join(weights[n], F.col("key") == F.col("before"), "left") if n < len(weights) else p
        parts.append(p.select("key", F.array(*[F.log(f"p{k}") for k in each]).cast("array<float>").alias("logp"), backoff.cast("array<float>").alias("backoff")))
    table_ = parts[0]
    for part in parts[1:]:
        table_ = table_.unionByName(part)
    return WideModel(LanguageModel(langs, *_held(np.zeros(0, np.uint64), np.zeros((0, len(langs))), np.zeros((0, len(langs))), np.log(floor)), np.zeros(len(langs)), np.full(len(langs), np.inf)), stage(table_))


def _held(keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted arrays of a model with a last row for what is missing; without n-grams the hash 0, which none has, stands for them."""
    if not len(keys):
        keys, logp, backoff = np.zeros(1, np.uint64), floor[None], np.zeros((1, len(floor)))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.vstack([logp[order], floor]).astype(np.float32), np.vstack([backoff[order], np.zeros(len(floor))]).astype(np.float32)


def token_scores(tokens: DataFrame, wide: WideModel, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(token, row) of all distinct ``tokens`` (token): what ``LanguageModel.token_rows`` gives, a block of tokens with the n-grams they hold in a task."""
    letters = tokens.agg(F.sum(F.length("token") + 2)).first()[0] or 0
    blocked = tokens.select("token", F.pmod(F.xxhash64("token"), F.lit(max(1, -(-letters * ORDER // block_grams)))).cast("int").alias("block"))

    def needed(batches):
        for batch in batches:
            for block, part in batch.groupby("block"):
                if words := [w for t in part["token"] for w in RUNS.findall(t)]:
                    yield pd.DataFrame({"key": np.unique(np.concatenate(grams(words)[2])).view(np.int64)}).assign(block=np.int32(block))

    held = blocked.mapInPandas(needed, "key long, block int").distinct().join(wide.grams, "key")
    model = wide.model

    def rows(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"token": [], "row": []})
        shape = (len(found), len(model.langs))
        arrays = [np.array(found[c].tolist(), float).reshape(shape) for c in ("logp", "backoff")]
        own = LanguageModel(model.langs, *_held(found["key"].to_numpy(np.int64).view(np.uint64), *arrays, model.logp[-1]), model.usual, model.times)
        said = part["token"].tolist()
        return pd.DataFrame({"token": said, "row": list(own.token_rows(said))})

    return blocked.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(rows, "token string, row array<float>")


def wide_scores(df: DataFrame, text_col: str, wide: WideModel, fields: str, hot: int = TOKENS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``with_scores`` of a wide model: the most frequent tokens' scores go to all tasks, rows meet those of their other tokens by joins."""
    small_batches(df.sparkSession)
    width = len(wide.model.langs) + 1
    key, out = fresh(df, "row"), fresh(df, "scored")
    rows = stage(df.withColumn(key, F.monotonically_increasing_id()))
    texts = rows.select(F.col(key).alias("id"), F.col(f"`{text_col}`").alias("text"))

    def counted_tokens(batches):
        for batch in batches:
            for _, run in chunks(batch["text"].tolist()):
                found = pd.Series([w for t in run for w in t.lower().split()], dtype=object).value_counts()
                yield pd.DataFrame({"token": found.index.to_numpy(object), "n": found.to_numpy(float)})

    tokens = stage(texts.mapInPandas(counted_tokens, "token string, n double").groupBy("token").agg(F.sum("n").alias("n")))
    scores = stage(token_scores(tokens.select("token"), wide, block_grams))
    usual = frequent(tokens.where(F.length("token") < 64), hot).join(scores, "token").select("token", "row").toArrow()  # at most ``hot`` rows
    known = df.sparkSession.sparkContext.broadcast((usual["token"].to_pylist(), np.array(usual["row"].to_pylist(), np.float32).reshape(-1, width)))

    def half(batches):
        """The sum over known tokens, and the others."""
        words, held = known.value
        index = dict(zip(words, range(len(words)), strict=True))
        for batch in batches:
            sums, rare = [], []
            for text in batch["text"]:
                said = (text or "").lower().split()
                at = [index.get(t, -1) for t in said]
                sums.append(held[[k for k in at if k >= 0]].sum(0, dtype=float))
                rare.append([t for t, k in zip(said, at, strict=True) if k < 0])
            yield pd.DataFrame({"id": batch["id"], "sums": sums, "rare": rare})

    halves = stage(texts.mapInPandas(half, "id long, sums array<double>, rare array<string>"))
    others = halves.select("id", F.explode("rare").alias("token")).groupBy("id", "token").agg(F.count("*").alias("n")).join(scores, "token")
    summed = others.groupBy("id").agg(*[F.sum(F.col("n") * F.get("row", F.lit(k))).alias(f"_s{k}") for k in range(width)])
    both = halves.join(summed, "id", "left").select(F.col("id").alias("_id"), F.array(*[F.get("sums", F.lit(k)) + F.coalesce(f"_s{k}", F.lit(0.0)) for k in range(width)]).alias("_sums"))
    names = [x.split()[0] for x in fields.split(",")]
    model = wide.model

    def told(sums: pd.Series) -> pd.DataFrame:
        total = np.array(sums.tolist(), float).reshape(-1, width)
        return pd.DataFrame(dict(zip(names, model.verdict(-total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]), strict=True)))

    told.__annotations__ = {"sums": pd.Series, "return": pd.DataFrame}
    verdicts = both.select(F.col("_id").alias(key), F.pandas_udf(told, fields)("_sums").alias(out))
    return rows.join(verdicts, key).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{out}.{n}").alias(n) for n in names])


def scored_by(df: DataFrame, text_col: str, model: LanguageModel | WideModel, fields: str) -> DataFrame:
    if isinstance(model, WideModel):
        return wide_scores(df, text_col, model, fields)
    sent = df.sparkSession.sparkContext.broadcast(model)
    return with_scores(df, text_col, lambda: sent.value.scorer(), fields)


def calibrating(rows: DataFrame, most: int = CALIBRATE_MOST) -> Column:
    """Whether a row calibrates: one of CALIBRATES of each language, and of a large one as many as make about ``most``; by a hash of doc_id."""
    sizes = rows.groupBy("lang").count().collect()  # a row a language
    share = F.lit(1.0 / CALIBRATES)
    for r in sizes:
        if r["count"] > most * CALIBRATES:
            share = F.when(F.col("lang") == r["lang"], F.lit(most / r["count"])).otherwise(share)
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000


def frequent(found: DataFrame, most: int) -> DataFrame:
    """``found`` (..., n) without its rarest rows, if it has more than ``most``: those of fewer than the least count that leaves no more."""
    total = found.count()
    if total <= most:
        return found
    least = found.groupBy(F.least("n", F.lit(1_000_000.0)).alias("n")).count().orderBy("n")
    for r in least.toLocalIterator():  # in order of counts, of which few are needed
        total -= r["count"]
        if total <= most:
            return found.where(F.col("n") > r["n"])
    return found.limit(0)


def fit_languages(docs: DataFrame, most_grams: int = MOST_GRAMS) -> LanguageModel | WideModel | None:
    """Fit on all of ``docs`` (doc_id, text, lang): about one in CALIBRATES, at most some CALIBRATE_MOST a language, calibrates the model that the others train.

    Words and n-grams are counted on Spark. Up to ``most_grams`` rows of an n-gram and language go to the driver; more stay in a table, none is left out.
    Rows with null text or lang are left out; None if nothing is left.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    held = calibrating(rows)

    def counts(part: DataFrame) -> DataFrame:
        found = word_counts(part).mapInPandas(lambda batches: (counted(b) for b in batches if len(b)), GRAM_FIELDS)
        of = [F.first(c).alias(c) for c in ("ctx", "suffix", "begins")]  # the same for all rows of a key
        return stage(found.groupBy("ord", "key", "lang").agg(*of, F.sum("n").alias("n")))

    def collected(found: DataFrame) -> pd.DataFrame:
        # One order at a time, as numbers without Python objects: the driver's memory goes to the model alone.
        langs = [r.lang for r in found.select("lang").distinct().orderBy("lang").collect()]
        numbers = found.withColumn("lang", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("short") - F.lit(1).cast("short")).withColumn("ord", F.col("ord").cast("byte"))
        parts = [numbers.where(F.col("ord") == n).toArrow().to_pandas(split_blocks=True, self_destruct=True) for n in range(1, ORDER + 1)]
        out = pd.concat(parts, ignore_index=True)
        out["lang"] = pd.Categorical.from_codes(out["lang"].to_numpy(), langs)
        return out

    grams_ = counts(rows.where(~held))
    if not (n_grams := grams_.count()):
        grams_ = counts(rows)
        n_grams = grams_.count()
    if not n_grams:
        return None
    fitted = smoothed(collected(grams_)) if n_grams <= most_grams else smoothed_wide(grams_)
    model = fitted.model if isinstance(fitted, WideModel) else fitted
    judged = stage(scored_by(rows.where(held), "text", fitted, "p string, s double, ce double, no boolean, size double").where("p <> 'und'").select("lang", "p", "s", "ce", "size"))
    right = F.col("p") == F.col("lang")
    set_limits(model, judged.where(right).select("lang", "ce", "size"))
    s = F.least(F.greatest("s", F.lit(1e-9)), F.lit(1 - 1e-9))
    margin = F.log(s / (1 - s)) / F.lit(model.calibration[0])
    # Margins lie within 0.35, so there are at most some thousands of steps of 0.0001, whatever the input.
    steps = judged.select(margin.alias("m"), right.cast("double").alias("ok")).groupBy(F.round(F.col("m") * 10_000), "ok").agg(F.avg("m").alias("m"), F.count("*").cast("double").alias("n")).select("m", "ok", "n").toPandas()
    if len(steps):
        n, ok = steps["n"].to_numpy(), steps["ok"].to_numpy()
        x, w = np.column_stack([steps["m"].to_numpy(), np.ones(len(steps))]), np.array([10.0, 0.0])
        for _ in range(50):  # logistic regression of being right on the margin, held near its start
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-1]), (x * (n * (ok - p))[:, None]).sum(0) - np.array([1e-2, 1e-1]) * (w - np.array([10.0, 0.0])))
        if w[0] > 0:
            model.calibration = (float(w[0]), float(w[1]))
    return fitted


def set_limits(model: LanguageModel, right: DataFrame) -> None:
    """Sets where ``model`` rejects, from ``right`` (lang, ce, size), texts that it named rightly; a language without any rejects nothing."""
    weight = F.least("size", F.lit(500.0))
    means = {r.lang: r.mean for r in right.groupBy("lang").agg((F.sum(F.col("ce") * weight) / F.sum(weight)).alias("mean")).collect()}  # a row a language
    if not means:
        return
    mean = F.try_element_at(F.create_map(*[F.lit(x) for pair in means.items() for x in pair]), F.col("lang"))
    off = right.withColumn("d", F.col("ce") - mean)
    # A row for each doubling of the length: the mean square of the deviation over the mean of 1 / size.
    steps = off.groupBy(F.floor(F.log2("size")).alias("step")).agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("y"), F.avg(1 / F.col("size")).alias("x")).toPandas()
    n, x, y = (steps[c].to_numpy(float) for c in ("n", "x", "y"))
    weights = n / np.maximum(y, 1e-9) ** 2  # as the variance of a mean square goes
    a = np.column_stack([np.ones(len(x)), x])
    between, within = np.linalg.lstsq(a * np.sqrt(weights)[:, None], y * np.sqrt(weights), rcond=None)[0] if len(x) > 1 else (float(y.mean()), 0.0)
    if between < 0 or within < 0:  # one of both explains it alone
        between, within = (0.0, float((weights * x * y).sum() / (weights * x * x).sum())) if between < 0 else (float((weights * y).sum() / weights.sum()), 0.0)
    z = F.col("d") / F.sqrt(F.lit(max(between, 1e-6)) + F.lit(within) / F.col("size"))
    ends = off.select("lang", z.alias("z")).agg(F.count("*").alias("n"), F.percentile_approx("z", LIMIT, 100_000).alias("q")).first()
    own = {r.lang: (r.n, r.q) for r in off.select("lang", z.alias("z")).groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("z", LIMIT, 100_000).alias("q")).collect()}
    pooled = max(LEAST, ends.q)
    times = {k: max(LEAST, q) if n >= SURE else pooled for k, (n, q) in own.items()}
    model.usual = np.array([means.get(k, 0.0) for k in model.langs])
    model.times = np.array([times.get(k, np.inf) for k in model.langs])
    model.spread = (max(float(between), 1e-6), float(within))


def identify(df: DataFrame, model: LanguageModel | WideModel | None, text_col: str = "text") -> DataFrame:
    """Every row of ``df`` with lang_pred, score (chance of being right), cross_entropy and rejected.

    Texts that are null or have no letter get `und`, score 0 and rejected. Ties go to the language first in order. Rows, repeated rows and
    extra columns stay; columns already called as the new ones are replaced.
    """
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new or c == text_col])
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(0.0), "rejected": F.lit(True)})
    names = [fresh(df, f"language_{n}") for n in [*new, "size"]]
    out = scored_by(df, text_col, model, ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "double", "double", "boolean", "double"), strict=True)))
    return out.drop(names[-1]).withColumnsRenamed(dict(zip(names, new, strict=False)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and cross_entropy and rejected, for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(crc_fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
