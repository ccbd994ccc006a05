"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Labelled documents are split into sentences, which carry their document's label, and sentences into units (tokens, and runs of single characters written
apart). Two units are compared by the subsequences of three letters that they share, each weighted by DECAY to the power of the width it covers,
at most WIDTH characters; the kernel is scaled by the size of both units. So `idiot`, `i.d.i.o.t` and `idxiot` stay near each other.
The machine is trained by multiple instances: most sentences of a toxic document aren't toxic themselves, so of the toxic sentences only the units that
best explain the label are positive, and the units of clean sentences that score highest come back as negatives. Of a unit longer than WINDOW the window that
scores highest stands for it.

With landmarks z_1..z_m and the machine's weights a, a unit u scores  sum_i a_i k(u, z_i) + b.  The feature space has
ALPHABET**3 dimensions, so the sum over landmarks is folded into one table and a unit costs a handful of lookups.
A document's score is a logistic function of its two best units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TokenTable, chunks, crc_fold, fresh, labelled_sample, stage, table, with_scores

DECAY, WIDTH, ALPHABET = 0.7, 7, 48
#: The symbol put before and after a unit.
EDGE = ALPHABET - 1
#: Units longer than this are scored in overlapping windows, the best of which counts.
WINDOW = 24
#: Digits and signs commonly written for letters.
LOOKALIKES = dict(zip("013457@$", "oieastas", strict=True))
#: What ends a sentence, for Spark.
SENTENCE_END = r"(?<=[.!?…。！？])\s+|\n+"
APART = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s){2,}\w[^\w\s]?(?!\S)")
OFFSETS = [(i, j) for j in range(2, WIDTH) for i in range(1, j)]


def units(text: str) -> list[str]:
    """Lower-cased tokens of a text, and each run of three or more characters written apart as one more unit."""
    low = text.lower()
    return low.split() + [" ".join(m.split()) for m in APART.findall(low)]


class _Letters(dict):
    """Code of each character: letters 1..26, other letters hashed into the rest of the alphabet, anything else 0 (a gap)."""

    def __missing__(self, point: int) -> int:
        ch = LOOKALIKES.get(chr(point), chr(point))
        code = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % (EDGE - 27) if ch.isalpha() else 0
        self[point] = code
        return code


LETTERS = _Letters()


def codes(unit: str) -> bytes:
    """The codes of a unit between two edges, without the gaps around it."""
    out = unit.translate(LETTERS).encode("latin-1").strip(b"\0")
    return b"%c%b%c" % (EDGE, out, EDGE) if out else out


def windows(unit: str) -> list[bytes]:
    c = codes(unit)
    return [c] if len(c) <= WINDOW else [c[k : k + WINDOW] for k in range(0, len(c) - WINDOW // 2, WINDOW // 2)]


def subsequences(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of each piece: every occurrence of a subsequence, scaled so that the weights' squares sum to 1; 0 fills up."""
    wide = max([WIDTH, *map(len, pieces)])
    c = np.frombuffer(b"".join(p.ljust(wide + WIDTH, b"\0") for p in pieces), np.uint8).reshape(len(pieces), -1).astype(np.int32)
    feats, weights = [], []
    for i, j in OFFSETS:
        a, b, d = c[:, : wide - j], c[:, i : i + wide - j], c[:, j:wide]
        feats.append(np.where((a > 0) & (b > 0) & (d > 0), (a * ALPHABET + b) * ALPHABET + d, 0))
        weights.append(np.full(wide - j, DECAY ** (j + 1), np.float32))
    feat = np.concatenate(feats, 1)
    weight = np.where(feat > 0, np.concatenate(weights), np.float32(0))
    norm = np.sqrt((weight * weight).sum(1, keepdims=True))
    return feat, weight / np.where(norm > 0, norm, 1)


@dataclass
class ToxicModel:
    table: np.ndarray  #: the machine's weight of each subsequence, folded over the landmarks
    bias: float
    calibration: tuple[float, float, float]  #: of the best unit, the second best, and the constant

    def unit_scores(self, names: list[str]) -> np.ndarray:
        out = np.full(len(names), self.bias, np.float32)
        for at in range(0, len(names), 4096):
            pieces, owner = [], []
            for k, name in enumerate(names[at : at + 4096]):
                for p in windows(name):
                    if len(p) >= 5:
                        pieces.append(p)
                        owner.append(at + k)
            for short in (True, False):
                pick = [k for k, p in enumerate(pieces) if (len(p) <= 12) == short]
                if pick:
                    feat, weight = subsequences([pieces[k] for k in pick])
                    score = (self.table[feat] * weight).sum(1) + self.bias
                    np.maximum.at(out, [owner[k] for k in pick], score)
        return out

    def best_two(self, texts: list[str | None], cache: TokenTable) -> np.ndarray:
        """The two best distinct units of each text; a text without units has twice the machine's constant."""
        out = np.full((len(texts), 2), self.bias, np.float32)
        for at, run in chunks(texts):
            found = [units(t) for t in run]
            ids, rows = cache([u for x in found for u in x])
            start = 0
            for k, x in enumerate(found):
                if x:
                    score = rows[ids[start : start + len(x)]]
                    best = int(score.argmax())
                    out[at + k, 0] = score[best]
                    rest = score[ids[start : start + len(x)] != ids[start + best]]
                    if len(rest):
                        out[at + k, 1] = rest.max()
                start += len(x)
        return out

    def scorer(self):
        cache = TokenTable(self.unit_scores)

        def score(texts):
            two = self.best_two(texts, cache).astype(float)
            a, b, c = self.calibration
            return (1 / (1 + np.exp(-np.clip(a * two[:, 0] + b * two[:, 1] + c, -30, 30))),)

        return score


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted alike, by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y) * cost
    w = np.zeros(x1.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        if not inside.any():
            break
        xi, wi = x1[inside], weight[inside]
        step = np.linalg.solve(reg + (xi * wi[:, None]).T @ xi, (xi * wi[:, None]).T @ y[inside])
        if np.abs(step - w).max() < 1e-6:
            break
        w = w + 0.7 * (step - w)
    return w[:-1], w[-1]


def fit_machine(positive: list[bytes], negative: list[bytes], landmarks: int, seed: int = 7) -> ToxicModel:
    """Nystroem features against landmarks drawn from both classes, then the linear machine, folded into one table; from the codes of units or windows."""
    rng = np.random.default_rng(seed)
    pos, neg = list(dict.fromkeys(positive)), list(dict.fromkeys(negative))
    marks = [pos[k] for k in rng.permutation(len(pos))[: landmarks * 2 // 3]]
    marks += [neg[k] for k in rng.permutation(len(neg))[: landmarks - len(marks)]]
    dense = np.zeros((len(marks), ALPHABET**3), np.float32)
    feat, weight = subsequences(marks)
    np.add.at(dense, (np.arange(len(marks))[:, None], feat), weight)
    dense[:, 0] = 0
    lam, vec = np.linalg.eigh((dense @ dense.T).astype(float) + 1e-6 * np.eye(len(marks)))
    root = vec @ np.diag(np.maximum(lam, 1e-3) ** -0.5) @ vec.T
    feat, weight = subsequences(pos + neg)
    # 32 rows at a time: each takes landmarks x features x 4 bytes, some 200 KB, on the driver.
    k = np.vstack([np.einsum("nf,mnf->nm", weight[a : a + 32], dense[:, feat[a : a + 32]]) for a in range(0, len(feat), 32)])
    w, b = svm(k @ root, np.array([1.0] * len(pos) + [-1.0] * len(neg)))
    return ToxicModel((root @ w).astype(np.float32) @ dense, float(b), (4.0, 0.0, 0.0))


def windows_of(units_: list[str], model: ToxicModel | None = None) -> list[bytes]:
    """The codes of units as instances: of a long unit all windows, or the one that ``model`` scores highest."""
    out: list[bytes] = []
    for u in units_:
        pieces = windows(u)
        if model is not None and len(pieces) > 1:
            feat, weight = subsequences(pieces)
            pieces = [pieces[int((model.table[feat] * weight).sum(1).argmax())]]
        out += [p for p in pieces if p]
    return out


def calibrate(two: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two best units."""
    x = np.hstack([two.astype(float), np.ones((len(two), 1))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.linalg.solve(h, (x * (y - p)[:, None]).sum(0) - 0.1 * w)
    return tuple(map(float, w))


def fit_toxicity(sample: DataFrame, landmarks: int = 160, rounds: int = 4, most_positive: int = 1500, most_clean: int = 4000, most_common: int = 1000, most_hard: int = 1500) -> ToxicModel:
    """Fit on the sentences of ``sample`` (text, label 0 or 1), a bounded table of labelled documents without copies.

    Of units, at most ``most_positive`` are positive, with as many again that the machine finds itself; negative are at most ``most_clean`` drawn ones, ``most_common``
    frequent ones, and ``most_hard`` a round that score highest. Without both labels there is nothing to learn, and the model scores every text below 0.5.
    """
    # A document's sentences are one bag: a word that its sentences repeat is evidence once.
    sentences = sample.select(F.xxhash64("text").alias("bag"), F.explode(F.split("text", SENTENCE_END)).alias("sentence"), "label").where(F.length("sentence") > 0)
    counts = (
        sentences.select("bag", "label", F.explode(F.split(F.lower("sentence"), r"\s+")).alias("unit"))
        .where(F.length("unit") >= 3)
        .distinct()
        .groupBy("unit")
        .agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
        .withColumn("good", F.col("n") - F.col("bad"))
    )
    counts = stage(counts)
    n_bad, n = (int(v or 0) for v in sentences.select("bag", "label").distinct().agg(F.sum("label"), F.count("*")).first())
    if not n_bad or n_bad == n:
        return ToxicModel(np.zeros(ALPHABET**3, np.float32), -1.0, (1.0, 0.0, -4.0))
    # Units that the label speaks for: a log-likelihood ratio against what the share of toxic bags would give.
    share = n_bad / n
    rate = (F.col("bad") + 0.02) / (F.col("n") + 0.04)
    gain = F.col("bad") * F.log(rate / share) + F.col("good") * F.log((1 - rate) / (1 - share))
    explained = counts.where(rate > share).withColumn("gain", gain).withColumn("rate", rate).orderBy(F.desc("gain"), "unit").limit(most_positive).collect()
    # Beyond chance at a rate of one in 20,000 a unit; with too few labels for that, the best ones.
    known = [r["unit"] for r in explained if r["gain"] > 10 and r["rate"] > 0.8] or [r["unit"] for r in explained[:50]]
    clean = [r["unit"] for r in counts.where("good > 0 AND bad <= good").orderBy(F.xxhash64("unit"), "unit").limit(most_clean).collect()]
    common = [r["unit"] for r in counts.where("good > 0 AND bad <= good").orderBy(F.desc("good"), "unit").limit(most_common).collect()]
    positive, negative = known, list(dict.fromkeys(clean + common))
    if not windows_of(positive) or not windows_of(negative):
        return ToxicModel(np.zeros(ALPHABET**3, np.float32), -1.0, (1.0, 0.0, -4.0))
    model = fit_machine(windows_of(positive), windows_of(negative), landmarks)
    pure = counts.where("good > 0").select("unit")
    for _ in range(rounds):
        # Instances: the clean units that look worst come back as negatives, positives that the machine can't support go.
        hard = with_scores(pure, "unit", _unit_scorer(model), "s double").where("s > -0.5").orderBy(F.desc("s"), "unit").limit(most_hard)
        found = [r["unit"] for r in hard.collect()]
        more = with_scores(counts.where("good = 0 AND bad > 0").select("unit", "bad"), "unit", _unit_scorer(model), "s double")
        gained = [r["unit"] for r in more.where("s > 1 AND bad > 1").orderBy(F.desc("bad"), F.desc("s"), "unit").limit(most_positive).collect()]
        positive, negative = list(dict.fromkeys(known + gained)), list(dict.fromkeys(negative + found))
        positive = [u for u in positive if u not in set(negative)] or positive
        model = fit_machine(windows_of(positive, model), windows_of(negative, model), landmarks)
    two = with_scores(sample, "text", _two_scorer(model), "a double, b double").select("a", "b", "label").collect()
    got = np.array([[r["a"], r["b"]] for r in two])
    model.calibration = calibrate(got, np.array([float(r["label"]) for r in two]))
    return model


def _unit_scorer(model: ToxicModel):
    return lambda: lambda names: (model.unit_scores(list(names)).astype(float),)


def _two_scorer(model: ToxicModel):
    def make():
        cache = TokenTable(model.unit_scores)

        def score(texts):
            two = model.best_two(texts, cache).astype(float)
            return two[:, 0], two[:, 1]

        return score

    return make


def score_toxicity(df: DataFrame, model: ToxicModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row of ``df`` with a score from 0 to 1 of its whole text; null and empty texts score as texts without units.

    Rows, repeated rows and extra columns stay; a column that is already called ``score_col`` is replaced.
    """
    df = df.drop(score_col) if score_col != text_col else df
    sent = df.sparkSession.sparkContext.broadcast(model)
    name = fresh(df, "tox")
    return with_scores(df, text_col, lambda: sent.value.scorer(), f"{name} double").withColumnRenamed(name, score_col)


def toxicity_model(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_clean: int = 8000) -> ToxicModel:
    """Fit on at most ``most_toxic`` + ``most_clean`` labelled documents whose crc32 fold of 5 is not 0."""
    return fit_toxicity(labelled_sample(docs, labels, "toxic", 5, 0, {1: most_toxic, 0: most_clean}))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
