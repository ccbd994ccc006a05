"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features has an interaction <v_i, v_j> of rank RANK.  The sum over pairs is taken in linear time:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ].
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TokenTable, chunks, crc_fold, fresh, labelled_sample, table, with_scores

BUCKETS, RANK = 1 << 15, 8
STATS = [
    "log words", "log characters", "mean word length", "upper-case words", "words with signs", "signs a word", "words with digits",
    "sentence ends", "distinct words", "log lines", "words a line", "repeated lines", "pipes", "capitalised words", "longest word", "one-letter words",
    "words like the one before",
]


def token_rows(tokens: list[str]) -> np.ndarray:
    """Bucket and shape of each token, case kept."""
    out, crc = [], zlib.crc32
    for t in tokens:
        core = t[:-1] if t[-1] in ".," else t
        if core.isalpha():
            out.append((crc(core.lower().encode()) % BUCKETS, len(t), len(core) > 1 and core.isupper(), 0, 0, 0, t[-1] == ".", 0, core[0].isupper(), len(t) == 1))
            continue
        word = "".join(filter(str.isalnum, t))
        signs = sum(not c.isalnum() and c not in ".,;:?'\"()-" for c in t)
        bucket = crc((word.lower() or t).encode("utf-8", "replace")) % BUCKETS
        out.append((bucket, len(t), len(word) > 1 and word.isupper(), signs > 0, signs, any(c.isdigit() for c in t), t[-1] in ".?!", t == "|", t[0].isupper(), len(t) == 1))
    return np.array(out, np.float32).reshape(-1, 10)


def features(texts: list[str | None], cache: TokenTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, their buckets, their values, statistics of each text); a word counts by the log of its copies."""
    sizes, buckets, values = np.zeros(len(texts), np.int64), [], []
    stats = np.zeros((len(texts), len(STATS)), np.float32)
    for at, run in chunks(texts):
        split = [t.split() for t in run]
        n = np.array([len(x) for x in split])
        ids, rows = cache([w for x in split for w in x])
        full = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        lines = [[y for y in t.split("\n") if y.strip()] for t in run]
        s = stats[at : at + len(run)]
        s[:, 0], s[:, 1] = np.log1p(n), np.log1p([len(t) for t in run])
        s[:, 9] = np.log1p([len(x) for x in lines])
        s[:, 10] = np.log1p(n / np.maximum(1, [len(x) for x in lines]))
        s[:, 11] = [1 - len(set(x)) / max(1, len(x)) for x in lines]
        if not len(full):
            continue
        got = rows[ids]
        mean = np.add.reduceat(got[:, 1:], starts[full], axis=0) / n[full, None]
        s[full, 2:8] = mean[:, :6]
        s[full, 12:14], s[full, 15] = mean[:, 6:8], mean[:, 8]
        s[full, 14] = np.log1p(np.maximum.reduceat(got[:, 1], starts[full]))
        doc = np.repeat(np.arange(len(run)), n)
        again = np.flatnonzero((ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]))
        s[:, 16] = np.bincount(doc[again], minlength=len(run)) / np.maximum(1, n)
        pair, copies = np.unique(doc * BUCKETS + got[:, 0].astype(np.int64), return_counts=True)
        owner = pair // BUCKETS
        value = np.log1p(copies).astype(np.float32)
        size = np.bincount(owner, minlength=len(run))
        value /= np.sqrt(np.bincount(owner, value * value, len(run)))[owner]
        s[:, 8] = size / np.maximum(1, n)
        sizes[at : at + len(run)] = size
        buckets.append(pair % BUCKETS)
        values.append(value)
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate(buckets or [none]), np.concatenate(values or [none.astype(np.float32)]), stats


@dataclass
class FactorMachine:
    base: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, sizes, buckets, values, stats):
        """One list of features for each text: its words, then its statistics in units of their spread."""
        wide = np.clip((stats - self.mean) / self.spread, -5, 5).astype(np.float32) * np.float32(0.3)
        ends = np.cumsum(sizes)
        idx = np.insert(buckets, np.repeat(ends, len(STATS)), np.tile(BUCKETS + np.arange(len(STATS)), len(sizes)))
        val = np.insert(values, np.repeat(ends, len(STATS)), wide.ravel())
        n = sizes + len(STATS)
        return idx, val, np.concatenate([[0], np.cumsum(n)[:-1]]), n

    def raw(self, idx, val, starts):
        vx = self.factor[idx] * val[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx * vx, starts, axis=0)).sum(1)
        return self.base + np.add.reduceat(self.weight[idx] * val, starts) + pairs, vx, total

    def scorer(self):
        cache = TokenTable(token_rows)

        def score(texts):
            out = np.zeros(len(texts))
            for at, run in chunks(texts):
                idx, val, starts, _ = self.rows(*features(run, cache))
                out[at : at + len(run)] = self.raw(idx, val, starts)[0]
            return (1 / (1 + np.exp(-np.clip(out, -30, 30))),)

        return score


def train(sizes, buckets, values, stats, y, epochs: int = 6, rate: float = 0.15, seed: int = 5) -> FactorMachine:
    """AdaGrad on the logistic loss over small batches."""
    rng = np.random.default_rng(seed)
    dims = BUCKETS + len(STATS)
    share = min(max(y.mean(), 0.01), 0.99)
    fm = FactorMachine(float(np.log(share / (1 - share))), np.zeros(dims, np.float32), rng.normal(0, 0.05, (dims, RANK)).astype(np.float32), stats.mean(0), stats.std(0) + 1e-3)
    sum_w, sum_v, sum_b = np.full(dims, 1e-2, np.float32), np.full((dims, RANK), 1e-2, np.float32), 1e-2
    ends = np.cumsum(sizes)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            take = np.concatenate([np.arange(ends[k] - sizes[k], ends[k]) for k in part])
            idx, val, starts, n = fm.rows(sizes[part], buckets[take], values[take], stats[part])
            out, vx, total = fm.raw(idx, val, starts)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]).astype(np.float32) / len(part)
            gi = np.repeat(g, n) * val
            gv = gi[:, None] * (np.repeat(total, n, axis=0) - vx)
            order = np.argsort(idx, kind="stable")
            uniq, first = np.unique(idx[order], return_index=True)
            gw = np.add.reduceat(gi[order], first) + 1e-5 * fm.weight[uniq]
            gv = np.add.reduceat(gv[order], first, axis=0) + 1e-5 * fm.factor[uniq]
            sum_w[uniq] += gw * gw
            sum_v[uniq] += gv * gv
            fm.weight[uniq] -= rate * gw / np.sqrt(sum_w[uniq])
            fm.factor[uniq] -= rate * 0.5 * gv / np.sqrt(sum_v[uniq])
            sum_b += float(g.sum()) ** 2
            fm.base -= rate * float(g.sum()) / sum_b**0.5
    return fm


def fit_quality(sample: DataFrame) -> FactorMachine:
    """Fit on ``sample`` (text, label 0 or 1), a bounded table of labelled documents without copies; its features go to the driver.

    With one label only, the model gives every text that label; with none, 0.5.
    """

    def featured(batches):
        import pandas as pd

        cache = TokenTable(token_rows)
        for batch in batches:
            sizes, buckets, values, stats = features(batch["text"].tolist(), cache)
            cut = np.cumsum(sizes)[:-1]
            yield pd.DataFrame({"b": np.split(buckets.astype(np.int32), cut), "v": np.split(values, cut), "s": list(stats), "label": batch["label"]})

    rows = sample.mapInPandas(featured, "b array<int>, v array<float>, s array<float>, label int").toPandas()
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        side = 0.0 if not len(y) else 20.0 * (2 * y[0] - 1)
        dims = BUCKETS + len(STATS)
        return FactorMachine(side, np.zeros(dims, np.float32), np.zeros((dims, RANK), np.float32), np.zeros(len(STATS)), np.ones(len(STATS)))
    sizes = rows["b"].str.len().to_numpy()
    return train(sizes, np.concatenate(rows["b"].tolist()).astype(np.int64), np.concatenate(rows["v"].tolist()).astype(np.float32), np.array(rows["s"].tolist(), np.float32), y)


def quality_model(docs: DataFrame, labels: DataFrame, most_bad: int = 2500, most_good: int = 6500) -> FactorMachine:
    """Fit on at most ``most_bad`` + ``most_good`` labelled documents whose crc32 fold of 3 is not 1."""
    return fit_quality(labelled_sample(docs, labels, "quality", 3, 1, {0: most_bad, 1: most_good}))


def score_quality(df: DataFrame, model: FactorMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row of ``df`` with a score from 0 to 1 of its whole text; null texts score as empty ones.

    Rows, repeated rows and extra columns stay; a column that is already called ``score_col`` is replaced.
    """
    df = df.drop(score_col) if score_col != text_col else df
    sent = df.sparkSession.sparkContext.broadcast(model)
    name = fresh(df, "quality")
    return with_scores(df, text_col, lambda: sent.value.scorer(), f"{name} double").withColumnRenamed(name, score_col)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
