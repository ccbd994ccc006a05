"""Search over vectors: exact top k through a paged M-tree of two routing levels, and nearest neighbours by a block matrix join.

Both compare blocks of queries with pages or blocks of candidates, one task each, of bounded size; rows go to blocks by a hash of their id, so equal
vectors don't gather.  What comes out of a task is at most k rows a query, and Spark's ranked window merges them.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part.  Vectors are compared with those of the same number of
components.  A repeated candidate counts as often as it occurs, a repeated query once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Most candidates of a page or block, and most queries of a block, on average.
PAGE, BLOCK = 6_000, 2_048
#: Entries that a leaf should have, and the most leaves and bytes of leaf centres; centres are drawn by hash, every row is indexed.
LEAF, LEAVES, CENTRE_BYTES = 1_500, 32_768, 64 << 20
#: Leaves that each wave of a search takes from the front of a query's queue; the last takes all that are left.
WAVES = (1, 4)
#: Components of a float32 product of int8 vectors: 1,024 * 127 * 127 is below 2**24, so its sums stay whole.
STRIP = 1_024


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, dim) of the rows that take part."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad).withColumn("dim", F.size("v"))


def spread(n: int, most: int) -> Column:
    """A block for each row, by a hash of its id."""
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // most)))).cast("int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query, ties to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(score) > k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


# --- exact top k: M-tree ---------------------------------------------------------------------------------------------


def tree_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each of ``queries`` with the other ``vectors``, exactly.

    Both have (id, v array<double>, dim) with whole numbers in v, so products are exact in double precision.

    Largest product becomes least distance: with M the largest norm, a candidate x is the point (x, sqrt(M^2 - |x|^2)), a query q is (q, 0), and their
    squared distance is |q|^2 + M^2 - 2 q.x.  The tree has two levels of routing vectors: inner nodes, and below each its leaves, with covering radii and
    the distance to the parent; a leaf's entries keep their distance to its centre.  A query's queue holds the leaves by the least distance
    that an entry there can have, d(q, centre) - radius.  Waves take leaves from its front; the k-th best product so far, renewed between waves, gives the radius that ends
    the queue.  Distances to the leaves of a node are computed only if d(q, node) - radius is within it, to a leaf only if
    |d(q, node) - d(leaf, node)| - radius is, to an entry only if |d(q, leaf) - d(entry, leaf)| is.
    """
    spark = vectors.sparkSession
    measured = stage(vectors.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    stats = {r["dim"]: (r["n"], r["m2"]) for r in measured.groupBy("dim").agg(F.count("*").alias("n"), F.max("n2").alias("m2")).collect()}  # a row for each length of vector
    out = None
    for dim, (n, m2) in sorted(stats.items()):
        part = measured.where(F.col("dim") == dim)
        asked = queries.where(F.col("dim") == dim).dropDuplicates(["id"])
        n_asked = asked.count()
        if n_asked:
            found = _search_tree(spark, part, asked, n, n_asked, dim, float(m2), k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(out, k)


def _lifted(v: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(0, m2 - (v * v).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)))


@dataclass
class Routing:
    """The tree above its entries: inner nodes, and the leaves' centres sorted by node."""

    nodes: np.ndarray
    centres: np.ndarray
    first: np.ndarray  #: of each node, the number of its first leaf; one more at the end
    away: np.ndarray  #: of each leaf, its distance to its node
    node_radius: np.ndarray
    radius: np.ndarray
    parts: np.ndarray  #: pages of each leaf

    @classmethod
    def over(cls, centres: np.ndarray) -> Routing:
        nodes = centres[: math.isqrt(len(centres) - 1) + 1]
        d = _distances(centres, nodes)
        near = d.argmin(1)
        order = np.argsort(near, kind="stable")
        none = np.full(0, 0.0)
        return cls(nodes, centres[order], np.searchsorted(near[order], np.arange(len(nodes) + 1)), d[np.arange(len(d)), near][order], none, none, none.astype(int))

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to its centre, distance to its node) of each point: the nearest node, then its nearest leaf."""
        d = _distances(x, self.nodes)
        d[:, self.first[1:] == self.first[:-1]] = np.inf
        near = d.argmin(1)
        leaf, away = np.zeros(len(x), np.int64), np.zeros(len(x))
        for node in np.unique(near):
            mine = np.flatnonzero(near == node)
            below = _distances(x[mine], self.centres[self.first[node] : self.first[node + 1]])
            leaf[mine], away[mine] = self.first[node] + below.argmin(1), below.min(1)
        return leaf, away, d[np.arange(len(x)), near]

    def queue(self, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, distance to its centre, place in the query's queue) of the leaves within reach."""
        d = _distances(q, self.nodes)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        for node in range(len(self.nodes)):
            mine = np.flatnonzero(d[:, node] - self.node_radius[node] <= reach)
            leaves = np.arange(self.first[node], self.first[node + 1])
            if len(mine) and len(leaves):
                may = np.abs(d[mine, node][:, None] - self.away[leaves][None]) - self.radius[leaves][None] <= reach[mine, None]
                asked, below = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                exact = _distances(q[mine[asked]], self.centres[leaves[below]])
                low = exact - self.radius[leaves[below]][None]
                i, j = np.nonzero(may[np.ix_(asked, below)] & (low <= reach[mine[asked], None]))
                found.append((mine[asked][i], leaves[below][j], exact[i, j], low[i, j]))
        who, leaf, away, low = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((leaf, low, who))
        who, leaf, away = who[order], leaf[order], away[order]
        return who, leaf, away, np.arange(len(who)) - np.searchsorted(who, who)


def _search_tree(spark: SparkSession, part: DataFrame, asked: DataFrame, n: int, n_asked: int, dim: int, m2: float, k: int) -> DataFrame:
    most = max(1, min(LEAVES, CENTRE_BYTES // (8 * (dim + 1)), n // LEAF))
    drawn = part.orderBy(F.xxhash64("id", F.lit(13)), "id").limit(most).select("v").toArrow()["v"].to_pylist()
    _, once = np.unique(np.array(drawn), axis=0, return_index=True)
    tree = Routing.over(_lifted(np.array(drawn)[np.sort(once)], m2))
    grown = spark.sparkContext.broadcast(tree)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                leaf, away, above = grown.value.descend(_lifted(np.array(batch["v"].tolist()), m2))
                yield batch[["id", "v"]].assign(leaf=leaf.astype(np.int32), away=away, above=above)

    indexed = stage(part.select("id", "v").mapInPandas(entries, "id long, v array<double>, leaf int, away double, above double"))
    made = indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("above").alias("above")).toPandas()  # a row a leaf
    leaves = len(tree.centres)
    tree.radius, tree.parts = np.full(leaves, -np.inf), np.zeros(leaves, np.int64)
    tree.radius[made["leaf"]], tree.parts[made["leaf"]] = made["radius"], -(-made["n"] // PAGE)
    above = np.full(leaves, -np.inf)
    above[made["leaf"]] = made["above"]
    tree.node_radius = np.array([above[a:b].max(initial=-np.inf) for a, b in zip(tree.first, tree.first[1:], strict=False)])
    routing = spark.sparkContext.broadcast(tree)
    parts = spark.createDataFrame(pd.DataFrame({"of": made["leaf"], "parts": -(-made["n"] // PAGE)}))  # at most LEAVES rows of two numbers
    paged = indexed.join(F.broadcast(parts), F.col("leaf") == F.col("of")).withColumn("page", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    slack = 1e-6 * (1 + math.sqrt(m2))

    def reach_of(v: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (v * v).sum(1) + m2 - 2 * bound)) + slack

    def routed(batches: Iterator[pd.DataFrame], start: int, end: int | None) -> Iterator[pd.DataFrame]:
        """A row for each query and page of the leaves from place ``start`` of its queue to ``end``."""
        tree = routing.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = batch.iloc[at : at + 64]
                v = np.array(rows["v"].tolist())
                q, leaf, away, place = tree.queue(np.hstack([v, np.zeros((len(v), 1))]), reach_of(v, rows["bound"].to_numpy()))
                pick = (place >= start) & (place < (end if end is not None else np.inf))
                q, leaf, away = q[pick], leaf[pick], away[pick]
                many = tree.parts[leaf]
                page = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                q, leaf, away = np.repeat(q, many), np.repeat(leaf, many), np.repeat(away, many)
                yield pd.DataFrame({c: rows[c].to_numpy()[q] for c in ("id", "v", "bound", "block")} | {"leaf": leaf.astype(np.int32), "page": page.astype(np.int32), "away": away})

    def on_page(asking: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        ids, scores, owners = [], [], []
        if len(asking) and len(page):
            page = page.sort_values(["away", "id"])
            x, away, own = np.array(page["v"].tolist()), page["away"].to_numpy(), page["id"].to_numpy()
            v = np.array(asking["v"].tolist())
            reach = reach_of(v, asking["bound"].to_numpy())
            low = np.searchsorted(away, asking["away"].to_numpy() - reach, "left")
            high = np.searchsorted(away, asking["away"].to_numpy() + reach, "right")
            for i, (a, b, me, bound) in enumerate(zip(low, high, asking["id"], asking["bound"], strict=True)):
                score, names = x[a:b] @ v[i], own[a:b]
                keep = (score >= bound) & (names != me)
                score, names = score[keep], names[keep]
                best = best_first(score, names, k)
                owners.append(np.full(len(best), me))
                ids.append(names[best])
                scores.append(score[best])
        none = [np.zeros(0)]
        return pd.DataFrame({"query_id": np.concatenate(owners or none).astype(np.int64), "vec_id": np.concatenate(ids or none).astype(np.int64), "score": np.concatenate(scores or none)})

    tile = ["leaf", "page", "block"]

    def search(asking: DataFrame, start: int, end: int | None) -> DataFrame:
        routes = stage(asking.mapInPandas(lambda b: routed(b, start, end), "id long, v array<double>, bound double, block int, leaf int, page int, away double"))
        needed = routes.select(*[F.col(c).alias(f"for_{c}") for c in tile]).distinct()
        right = paged.join(needed, (F.col("leaf") == F.col("for_leaf")) & (F.col("page") == F.col("for_page"))).select("id", "v", "away", *[f"for_{c}" for c in tile])
        return routes.groupBy(*tile).cogroup(right.groupBy(*[f"for_{c}" for c in tile])).applyInPandas(on_page, "query_id long, vec_id long, score double")

    # The least product possible is above -|q| M, so an unbounded query reaches everything.
    asking = asked.select("id", "v", spread(n_asked, BLOCK).alias("block"))
    bounded, found, taken = asking.withColumn("bound", F.lit(-1e300)), None, 0
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for width in WAVES:
        if taken < leaves:
            new = stage(search(bounded, taken, taken + width))
            found, taken = new if found is None else found.unionByName(new), taken + width
            bounds = found.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
            bounded = stage(asking.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1e300))))
    return found if taken >= leaves else found.unionByName(search(bounded, taken, None))


def op5_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 best for every query row of ``embeddings``, on components floor(64 x)."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 64).cast("double")))
    return tree_top_k(rows, rows.where("id % 20 = 0"), 20).withColumn("score", F.col("score").cast("long"))


# --- nearest neighbours: block matrix join ---------------------------------------------------------------------------


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers from -127 to 127, scale of each row, norm of what rounding left of each row)."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exactly: float32 products of at most STRIP components, added in double precision."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], STRIP):
        out += a[:, at : at + STRIP].astype(np.float32) @ b[:, at : at + STRIP].astype(np.float32).T
    return out


def unit_sized(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(``x`` divided by the power of two above its largest component, the power), so that norms are finite."""
    power = int(np.frexp(np.abs(x).max(initial=0))[1])
    return np.ldexp(x, -power), power


def block_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each of ``queries`` with the other ``vectors``; zero vectors take no part.

    A tile multiplies a block of queries with a block of candidates as int8.  With a = s A + e the rounding of a vector, the
    product q.x differs from the tile's by at most |q| |e_x| + |e_q| |s_x X|, and by the rounding of double precision; pairs whose upper bound reaches the
    k-th greatest lower bound of their query survive, are computed in double precision, and a heap keeps the k best.  So no neighbour is lost.
    Products beyond the range of double precision are infinite or zero and rank as such; one that is undefined ranks last.
    """
    alive = F.exists("v", lambda x: x != 0)
    vectors, queries = stage(vectors.where(alive)), queries.where(alive).dropDuplicates(["id"])
    n, n_asked = vectors.count(), queries.count()
    ours, theirs = max(1, -(-n_asked // BLOCK)), max(1, -(-n // PAGE))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select("id", "v", "dim", spread(n_asked, BLOCK).alias("ours"), every(theirs).alias("theirs"))
    right = vectors.select("id", "v", "dim", spread(n, PAGE).alias("theirs"), every(ours).alias("ours"))

    def tile(asking: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(asking) and len(page):
            q, x = np.array(asking["v"].tolist()), np.array(page["v"].tolist())
            (q1, p), (x1, r) = unit_sized(q), unit_sized(x)
            q8, qs, qe = quantised(q1)
            x8, xs, xe = quantised(x1)
            q_norm, x_norm, x_round = np.linalg.norm(q1, axis=1), np.linalg.norm(x1, axis=1), np.linalg.norm(x8 * xs[:, None], axis=1)
            # Where products may leave the range of double precision, all pairs of the tile are computed.
            rounding = 1e-15 * (q.shape[1] + 8) if -900 < p + r < 1000 else np.inf
            ids, me = page["id"].to_numpy(), asking["id"].to_numpy()
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                about = whole_product(q8[part], x8) * qs[part, None] * xs[None]
                error = q_norm[part, None] * xe[None] + qe[part, None] * x_round[None] + rounding * (q_norm[part, None] * x_norm[None] + 1e-30)
                low, high = about - error, about + error
                low[me[part, None] == ids[None]] = high[me[part, None] == ids[None]] = -np.inf
                kth = np.partition(low, low.shape[1] - k, 1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
                for row in range(len(low)):  # one query's survivors at a time: of equal vectors all survive
                    j = np.flatnonzero((high[row] >= kth[row]) & (me[at + row] != ids))
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = np.nan_to_num(np.cumsum(x[j] * q[at + row], axis=1)[:, -1], nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # in the order of components
                    best = heapq.nsmallest(k, zip((-exact).tolist(), ids[j].tolist(), strict=True))
                    rows += [(int(me[at + row]), name, -score) for score, name in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ["dim", "ours", "theirs"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, "query_id long, vec_id long, score double")
    return ranked(found, k)


def op6_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 nearest of every query row of ``embeddings``."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return block_nearest(rows, rows.where("id % 20 = 0"), 20)


QUERIES = {"op5_mtree_top_k": op5_mtree_top_k, "op6_block_nearest": op6_block_nearest}
ORACLES = {
    "op5_mtree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
""",
    "op6_block_nearest": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
""",
}
