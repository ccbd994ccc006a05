"""Near-duplicates: BagMinHash signatures of multisets of word shingles, banding, exact verification, components.

A shingle with weight w (its copies in the text) is the union of the weight intervals (0,1], (1,2], (2,4], (4,8], ... up to w.  Each interval is a
Poisson process of points in time, with a rate equal to its width; a point also draws a weight level within the interval and
counts only if that level is at most w, which is how an interval that w only partly covers is split.  Every point falls on one of
the signature's places, and a place keeps the earliest.  Two texts agree at a place with the probability of their weighted Jaccard
similarity.  A shingle's points are drawn in order of time and no further than the latest place of its text, so a text costs about
as many points as it has shingles.

Links between different texts: texts sharing a band are linked to the least text of the band first.  Then, in bands where that left more than one
component, pairs across components are compared by their whole signatures, in tiles of bounded size; only those whose agreement could come
from a similarity of THRESHOLD are verified, each text's best pair first, then those that still lie across components.  A pair within one component can't change the result, so copies are never expanded into all pairs.
A pair at exactly 0.8 is missed with a chance of about 0.0003 (no common band) plus 0.0004 (agreement below NEAR), one at 0.85 practically never.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TokenTable, chunks, fresh, small_batches, stage, table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 7
#: Places of a signature; the first BANDS * ROWS make the bands. Each is kept as one byte.
PLACES = 504
#: Least agreement of signatures that is verified: 3.4 standard deviations below that of a pair at THRESHOLD.
NEAR = 0.74
#: Texts of one band that a tile compares with as many others, on average.
TILE = 1_024
#: Most rows of a side that is broadcast; at most 40 bytes each.
BROADCAST_ROWS = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each token without the signs around it; 0 where nothing is left."""
    out = np.zeros(len(tokens), np.uint64)
    for k, t in enumerate(tokens):
        if not (t[0].isalnum() and t[-1].isalnum()):
            a, b = 0, len(t)
            while a < b and not t[a].isalnum():
                a += 1
            while b > a and not t[b - 1].isalnum():
                b -= 1
            t = t[a:b]
        if t:
            out[k] = xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) | 1
    return out


def shingles(texts: list[str], cache: TokenTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, copies) of the distinct shingles of each text, in order; a text of fewer than WORDS words is one shingle."""
    split = [t.lower().split() for t in texts]
    ids, rows = cache([w for x in split for w in x])
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none.astype(np.uint64), none
    h = rows[ids]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    doc, h = doc[h > 0], h[h > 0]
    if not len(h):
        return none, none.astype(np.uint64), none
    n = np.bincount(doc, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(h)) - starts[doc]
    with np.errstate(over="ignore"):
        s = np.zeros(len(h), np.uint64)
        length = np.minimum(n[doc], WORDS)
        for k in range(WORDS):
            there = k < length
            at = np.minimum(np.arange(len(h)) + k, len(h) - 1)
            s = np.where(there, mixed((s ^ h[at]) * FACTOR + np.uint64(k + 1)), s)
    whole = place <= n[doc] - length
    doc, s = doc[whole], s[whole]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]))
    return doc[first], s[first], np.diff(np.concatenate([first, [len(s)]]))


def signatures(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, m: int = PLACES) -> np.ndarray:
    """BagMinHash: the earliest time of each place, by text; infinite for texts without shingles."""
    parts = [(doc, mixed(elem), np.ones(len(doc)), np.zeros(len(doc), np.int64), weight)]
    low = 1
    while (more := weight > low).any():  # the interval (low, 2 low]
        with np.errstate(over="ignore"):
            parts.append((doc[more], mixed(elem[more] + FACTOR * np.uint64(low)), np.full(more.sum(), float(low)), np.full(more.sum(), low), weight[more]))
        low *= 2
    doc, seed, rate, lower, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    sig, bound = np.full(n_docs * m, np.inf), np.full(n_docs, np.inf)
    t, step = np.zeros(len(doc)), 1
    while len(doc):
        k = max(1, min(64, 200_000 // len(doc)))
        with np.errstate(over="ignore"):
            draw = mixed(seed[:, None] + FACTOR * np.arange(step, step + k, dtype=np.uint64)[None])
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
            times = np.cumsum(np.concatenate([t[:, None], gap], 1), 1)[:, 1:]
            other = mixed(draw ^ FACTOR)
        slot = (other % np.uint64(m)).astype(np.int64)
        width = rate.astype(np.int64)
        level = lower[:, None] + 1 + ((other >> np.uint64(32)) % width[:, None].astype(np.uint64)).astype(np.int64)
        use = (times < bound[doc][:, None]) & (level <= weight[:, None])
        np.minimum.at(sig, (doc[:, None] * m + slot)[use], times[use])
        bound = sig.reshape(n_docs, m).max(1)
        t = times[:, -1]
        on = t < bound[doc]
        doc, seed, rate, lower, weight, t = doc[on], seed[on], rate[on], lower[on], weight[on], t[on]
        step += k
    return sig.reshape(n_docs, m)


def signature_bytes(sig: np.ndarray) -> np.ndarray:
    """One byte for each place."""
    bits = np.ascontiguousarray(sig.astype(np.float32)).view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mixed(bits * FACTOR + np.arange(sig.shape[1], dtype=np.uint64)) & np.uint64(255)).astype(np.uint8)


def bands(small: np.ndarray) -> np.ndarray:
    """Each band's bytes and number as one integer, by text."""
    flat = np.zeros((len(small), BANDS, 8), np.uint8)
    flat[:, :, :ROWS] = small[:, : BANDS * ROWS].reshape(len(small), BANDS, ROWS)
    flat[:, :, ROWS] = np.arange(BANDS)
    return flat.view(np.int64)[:, :, 0]


def _signed(batches):
    cache = TokenTable(word_hashes)
    for batch in batches:
        texts = batch["text"].tolist()
        size, band, small = [], [], []
        for _, run in chunks(texts):
            doc, elem, weight = shingles(run, cache)
            total = np.bincount(doc, weight, len(run)).astype(np.int64)
            size += total.tolist()
            part = signature_bytes(signatures(doc, elem, weight, len(run)))
            b = bands(part)
            band += [b[k] if total[k] else None for k in range(len(run))]
            small += [part[k].tobytes() if total[k] else None for k in range(len(run))]
        node = [None if t is None else hashlib.md5(t.encode("utf-8", "replace")).digest() for t in texts]
        yield pd.DataFrame({"id": batch["id"], "node": node, "size": size, "band": band, "sig": small})


def _similar(batches):
    """Keeps pairs whose multisets overlap by THRESHOLD or more."""
    cache = TokenTable(word_hashes)
    for batch in batches:
        texts = pd.unique(pd.concat([batch["ta"], batch["tb"]]))
        number = {t: k for k, t in enumerate(texts)}
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        for _, run in chunks(list(texts)):
            doc, elem, weight = shingles(run, cache)
            cut = np.searchsorted(doc, np.arange(1, len(run)))
            sets += list(zip(np.split(elem, cut), np.split(weight, cut), strict=True))
        keep = []
        for x, y in zip(batch["ta"], batch["tb"], strict=True):
            (ea, wa), (eb, wb) = sets[number[x]], sets[number[y]]
            _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
            both = int(np.minimum(wa[i], wb[j]).sum())
            keep.append(both >= THRESHOLD * (int(wa.sum()) + int(wb.sum()) - both))
        yield batch.loc[keep, ["a", "b"]]


def _agreeing(batches, best_only: bool):
    """Pairs of a tile from different components whose sizes and signatures allow THRESHOLD, each in the first band that both share only.

    With ``best_only`` just the best pair of each text.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        lo, number = rows["lo"].iloc[0], int(rows["band"].iloc[0] >> 56)
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), PLACES)
        root, size, block = pd.factorize(rows["root"])[0], rows["size"].to_numpy(), rows["block"].to_numpy()
        same = lo == rows["hi"].iloc[0]
        a, b = [], []
        top, partner = np.zeros(len(rows)), np.full(len(rows), -1)
        for i in range(len(rows)) if same else np.flatnonzero(block == lo):
            j = np.arange(i + 1, len(rows)) if same else np.flatnonzero(block != lo)
            j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) >= THRESHOLD * np.maximum(size[j], size[i]))]
            if len(j):
                agree = sig[j] == sig[i]
                share = agree.mean(1)
                near = share >= NEAR
                if best_only:
                    j, share = j[near], share[near]
                    better = share > top[j]
                    top[j[better]], partner[j[better]] = share[better], i
                    if len(j) and share.max() > top[i]:
                        top[i], partner[i] = share.max(), j[share.argmax()]
                    continue
                j, agree = j[near], agree[near, : number * ROWS]
                if len(j):
                    j = j[~agree.reshape(len(j), number, ROWS).all(2).any(1)]
                    a += [i] * len(j)
                    b += j.tolist()
        if best_only:
            ends = {(min(i, j), max(i, j)) for i, j in enumerate(partner.tolist()) if j >= 0}
            kept = [(i, j) for i, j in sorted(ends) if not (sig[i, : number * ROWS] == sig[j, : number * ROWS]).reshape(number, ROWS).all(1).any()]
            a, b = [i for i, _ in kept], [j for _, j in kept]
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = rows[["band", "lo", "hi"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        groups = np.split(np.arange(len(rows)), cuts)
        for g in groups[:-1]:
            if len(g) > 1:
                yield compare(rows.iloc[g[0] : g[-1] + 1])
        held = rows.iloc[groups[-1][0] :] if len(rows) else None
    if held is not None and len(held) > 1:
        yield compare(held)


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has at most BROADCAST_ROWS rows; ``df`` is a staged table of narrow rows, so counting reads it once."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near-duplicates, from the whole texts of both.

    A text is fetched once, from the document that stands for it, so copies of one text don't meet in one task.
    """
    ends = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    wanted = stage(nodes.join(few(ends), "node").select("node", F.coalesce("id", F.lit(-1)).alias("rep")))
    md5 = F.unhex(F.md5(F.col("text").cast("binary")))
    held = docs.select(F.coalesce("id", F.lit(-1)).alias("rep"), md5.alias("node"), "text")
    texts = stage(held.join(few(wanted), ["rep", "node"]).select("node", "text").dropDuplicates(["node"]))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return stage(both.select("a", "b", "ta", "tb").mapInPandas(_similar, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each linked node reaches; nodes without links are left out.

    Star contraction: every node moves its greater neighbours, then its smaller ones, to the least, until nothing changes.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = stage(small)
        # Done when every node hangs on one node that hangs on none.
        roots = small.select("v").distinct()
        deep = small.select("u", "v").join(roots.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        many = small.groupBy("u").count().where("count > 1").limit(1).count()
        edges = small
        if not deep and not many:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))


def across(members: DataFrame, signed: DataFrame, root: DataFrame, best_only: bool) -> DataFrame:
    """(a, b), a < b: pairs of texts of one band but different components whose signatures agree enough to be verified."""
    flat = members.join(root, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), "band")
    several = flat.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    several = stage(several.where("lo <> hi").select("band", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")))
    # Each text of such a band meets every block of it: tiles (lower block, higher block).
    placed = flat.join(few(several), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stage(placed.select("band", "block", "blocks", "node", "size", "root"))
    needed = stage(placed.select("node").distinct())
    signs = stage(signed.select("node", "sig").join(few(needed), "node").dropDuplicates(["node"]))
    tiles = placed.join(signs, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "size", "root", "sig")
    dealt = tiles.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    found = dealt.mapInPandas(lambda batches: _agreeing(batches, best_only), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, node, size) of every row, (node, root) of every text with words): texts of one root are one class."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = stage(rows.mapInPandas(_signed, "id long, node binary, size long, band array<long>, sig binary"))
    worded = signed.where("size > 0")
    nodes = stage(worded.groupBy("node").agg(F.min("id").alias("id"), F.max("size").alias("size")))
    # Bands that different texts share; only their texts go on. Copies of one text add nothing here.
    shared = worded.select(F.xxhash64("node").alias("h"), F.explode("band").alias("band")).groupBy("band").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    shared = stage(shared.where("x <> y").select("band"))
    held = worded.select("node", F.explode("band").alias("band")).join(few(shared), "band").distinct()
    members = stage(held.join(nodes, "node").select("band", "node", "id", "size"))
    stars = members.groupBy("band").agg(F.min(F.struct("id", "node", "size")).alias("star"))
    close: Column = F.least("size", "star.size") >= F.lit(THRESHOLD) * F.greatest("size", "star.size")
    first = members.join(stars, "band").where((F.col("node") != F.col("star.node")) & close)
    pairs = stage(first.select(F.col("star.node").alias("a"), F.col("node").alias("b")).distinct())
    links = verify(pairs, nodes, rows)
    root = components(links)
    for best_only in (True, False):
        found = across(members, signed, root, best_only)
        tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = stage(found.join(tested, ["a", "b"], "left_anti"))
        if not found.isEmpty():
            pairs = stage(pairs.unionByName(found))
            more = verify(found, nodes, rows)
            if not more.isEmpty():
                links = links.unionByName(more)
                root = components(links)
    rooted = nodes.select("node", "id").join(root, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    return signed.select("id", "node", "size"), stage(rooted)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, kept) for every row: the class of near-duplicates, named by its least id, and whether the row has that id.

    Similarity is the weighted Jaccard of the multisets of five-word shingles of the lower-cased text; classes are the components of
    pairs at 0.8 or more. Null texts and texts without a word are alone in their class. Repeated rows share a class; all rows with the class's id are kept.
    A null id is never the name of a class unless all of its ids are null; then class_id is null and kept is true.
    Ids are expected to name one text: different texts under one id are told apart, but classes of one least id have the same name.
    """
    rows, rooted = _classes(docs, id_col, text_col)
    named = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    classed = stage(rooted.join(named, "root").select("node", "class_id"))
    alone = rows.where("size = 0").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    found = rows.where("size > 0").select("id", "node").join(classed, "node")
    return found.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")).unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of the least id, null ids last; all columns stay.

    Rows without a word stay. The class decides by id and text together, so an id that names two texts loses neither. Of rows that repeat both, the one with
    the least hash of all its columns stays.
    """
    rows, rooted = _classes(docs, id_col, text_col)
    order = lambda c: F.struct(F.col(c).isNull(), F.col(c), F.col("node"))
    chosen = rooted.groupBy("root").agg(F.min(order("id")).alias("c")).select("c.node", F.col("c.id").alias("rep"))
    node, key, rep, pick, mine = (fresh(docs, x) for x in ("node", "key", "rep", "pick", "mine"))
    kept = chosen.unionByName(rows.where("size = 0").select("node", F.col("id").alias("rep")).distinct())
    marked = docs.withColumn(node, F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))))
    same = F.col(node).eqNullSafe(F.col(key)) & F.col(f"`{id_col}`").eqNullSafe(F.col(rep))
    out = marked.join(few(stage(kept.select(F.col("node").alias(key), F.col("rep").alias(rep)))), same, "left_semi")
    again = stage(rows.where("size > 0").groupBy("id", "node").count().where("count > 1").select(F.col("id").alias(rep), F.col("node").alias(key)))
    if not again.isEmpty():
        repeated = out.join(again, same, "left_semi").withColumn(mine, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]))
        least = repeated.groupBy(F.col(node).alias(key), F.col(f"`{id_col}`").alias(rep)).agg(F.min(mine).alias(pick))
        once = repeated.join(least, same & (F.col(mine) == F.col(pick)), "left_semi").dropDuplicates([id_col, node]).drop(mine)
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.drop(node)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
