"""Byte-level BPE: encoding by ranked merges, decoding by concatenation.

A word (a match of the split pattern) is an array of its bytes' ids; `aggregate` folds over it, each step joining the neighbouring pair of least
rank, until no pair has one.  Ranks are a literal: a hash map from pair of ids to the rank of the joined bytes, laid out as two arrays in which a pair
has one place each, so a look-up is two reads.  The fold keeps the pairs' ranks and renews only the two beside a merge.

Folding each occurrence of a word would repeat most of the work.  The words of a bounded sample of documents are folded once, and the
HOT most frequent go to the tasks as a dictionary; it only saves time, results don't depend on it.  A task looks words up, merges rarer ones of more than
SHORT bytes where it splits, since such a fold costs some three times as much, and leaves holes for the others; the same fold runs over the distinct short
words of each document, and the holes are filled.  Texts are never shuffled.

Ids are carried as a text of decimal numbers joined by one space.  Decoding looks up each id's bytes in a literal and concatenates them in Spark.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, stage, table

#: Words in the dictionary, and documents whose words are counted for it.
HOT, SAMPLE = 600_000, 25_000
#: A rare match of more bytes is merged where it is split: the fold's cost grows with the square of a match's length. From LONG on with a heap.
SHORT, LONG = 6, 64
ALL = 1_000_000_000
#: Texts of these characters only can be split by the standard library's faster matcher, with the same result.
PLAIN = re.compile("[^\\t\\n\\r -~\\xa1-\\xa9\\xab-\\xb1\\xb4-\\xb8\\xbb\\xbf-\\u024f]")
QUICK = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The split pattern for which QUICK stands.
QUICK_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class RankMap:
    """The ranks as one literal, for ``fold``: array of four arrays of whole numbers.

    The first two hold the map from (left id, right id) to rank: with P = left << bits | right, an entry P << bits | rank stands at P modulo the length
    of one of them.  XOR with P << bits leaves the rank where the entry is P's, and more than any rank elsewhere.  The others have the part of each
    byte and the rank of each two bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = (max(ranks.values(), default=0) + 2).bit_length()
        self.edge = (1 << self.bits) - 1  # an id that no piece has, and the least value that is no rank
        self.part = 1 << 3 * self.bits  # what tells a part from a rank
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << self.bits | b] = rank
        first = _prime(max(3, len(pairs) * 13 // 10))
        self.sizes = (first, _prime(first + 2))
        places: tuple[list, list] = ([None] * self.sizes[0], [None] * self.sizes[1])
        for pair in pairs:
            side = 0
            for _ in range(500):  # the one that stands there moves to its place in the other array
                at = pair % self.sizes[side]
                pair, places[side][at] = places[side][at], pair
                if pair is None:
                    break
                side = 1 - side
            else:
                raise ValueError("no room for a pair of ranks")
        entries = [[self.part - 1 if x is None else x << self.bits | pairs[x] for x in side] for side in places]
        single = [ranks[bytes([b])] | self.part for b in range(256)]
        double = [ranks.get(bytes([a, b]), self.edge) for a in range(256) for b in range(256)]
        self.literal = F.from_json(F.lit(json.dumps([*entries, single, double])), "array<array<bigint>>")


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(words: Column, ranks: RankMap) -> Column:
    """For an array of words, the ids of each: array<array<bigint>>. An empty word has none.

    The state is one array: a part, the rank of joining it with the next part, the next part, ...; parts are larger than ranks, so the least element
    is the next merge.
    """
    number = lambda x: F.lit(x).cast("long")
    edge, none = number(ranks.edge | ranks.part), number(ranks.edge)
    id_of = lambda part: part.bitwiseXOR(number(ranks.part))

    def folded(word: Column, literal: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            pair = F.shiftleft(a, ranks.bits) + b
            sides = [F.get(literal[k], (pair % F.lit(n)).cast("int")) for k, n in enumerate(ranks.sizes)]
            return F.least(*[x.bitwiseXOR(F.shiftleft(pair, ranks.bits)) for x in sides])

        def step(acc: Column, _: Column) -> Column:
            def merged(i: Column) -> Column:
                new = F.get(acc, i - 1)
                beside = rank(id_of(F.get(acc, i - 4)), new), rank(new, id_of(F.get(acc, i + 2)))
                return F.concat(F.slice(acc, F.lit(1), i - 3), F.array(beside[0], new.bitwiseOR(number(ranks.part)), beside[1]), F.slice(acc, i + 3, F.lit(ALL)))

            return _let(F.array_min(acc), lambda least: F.when(least >= ranks.edge, acc).otherwise(_let(F.array_position(acc, least).cast("int"), merged)))

        def begun(codes: Column) -> Column:
            both = lambda a, b: F.array(F.get(literal[2], a), F.coalesce(F.get(literal[3], F.shiftleft(a, 8) + b), none))
            start = F.concat(F.array(edge, none), F.flatten(F.zip_with(codes, F.slice(codes, F.lit(2), F.lit(ALL)), both)), F.array(edge))
            parts = lambda acc: F.transform(F.filter(acc, lambda x: (x >= ranks.part) & (x != edge)), id_of)
            return F.aggregate(F.slice(codes, F.lit(2), F.lit(ALL)), start, step, parts)

        # Read as Latin-1, every byte is a character.
        chars = F.split(F.decode(F.encode(word, "utf-8"), "iso-8859-1"), "")
        return F.when(word == "", F.array().cast("array<bigint>")).otherwise(_let(F.transform(chars, F.ascii), begun))

    return _let(ranks.literal, lambda literal: F.transform(words, lambda word: folded(word, literal)))


def spelled(ids: Column) -> Column:
    """Ids as decimal numbers joined by one space."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def list_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one short match: the same merges, the least rank looked for in a list."""
    parts, get, none = [piece[k : k + 1] for k in range(len(piece))], ranks.get, len(ranks) + (1 << 60)
    of = [get(piece[k : k + 2], none) for k in range(len(piece) - 1)]
    while of and (least := min(of)) < none:
        k = of.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del of[k]
        if k < len(of):
            of[k] = get(parts[k] + parts[k + 1], none)
        if k:
            of[k - 1] = get(parts[k - 1] + parts[k], none)
    return [ranks[x] for x in parts]


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the same merges as the fold's, least rank first and leftmost among equals, in n log n."""
    end, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))

    def offer(at: int) -> None:
        if end[at] < len(piece) and (rank := ranks.get(piece[at : end[end[at]]])) is not None:
            heapq.heappush(heap, (rank, at, end[end[at]]))

    heap: list[tuple[int, int, int]] = []
    for at in range(len(piece) - 1):
        offer(at)
    gone = bytearray(len(piece) + 1)
    while heap:
        rank, at, to = heapq.heappop(heap)
        if gone[at] or end[at] >= to or end[end[at]] != to:  # a part of it was merged meanwhile
            continue
        gone[end[at]] = 1
        end[at] = to
        if to < len(piece):
            before[to] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < len(piece):
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


def splitter(pattern: str):
    """text -> its matches of ``pattern``."""
    whole = regex.compile(pattern).findall
    if pattern != QUICK_FOR:
        return whole
    return lambda text: whole(text) if PLAIN.search(text) else QUICK.findall(text)


class Dictionary:
    """Words and their spelled ids; travels as two texts, and becomes a dictionary where it is used, once in a worker."""

    def __init__(self, words: list[str], ids: list[str]):
        self.words, self.ids, self._known = "\0".join(words), "\0".join(ids), None

    def known(self) -> dict[str, str]:
        if self._known is None:
            self._known = dict(zip(self.words.split("\0"), self.ids.split("\0"), strict=True)) if self.ids else {}
            self.words = self.ids = ""
        return self._known


def hot_words(docs: DataFrame, pattern: str, ranks: RankMap, hot: int = HOT, sample: int = SAMPLE) -> Dictionary:
    """The spelled ids of at most ``hot`` words, the most frequent in at most ``sample`` documents. ``docs``: (id, text)."""
    ids = docs.select(F.col("id").alias("_id")).where("id IS NOT NULL").orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(sample).distinct()
    drawn = docs.join(F.broadcast(ids), F.col("id") == F.col("_id")).select("text")  # at most ``sample`` ids of 8 bytes

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = splitter(pattern)
        for batch in batches:
            for _, run in chunks(batch["text"].tolist()):
                found = pd.Series([w for t in run for w in split(t)], dtype=object).value_counts()
                yield pd.DataFrame({"word": found.index.to_numpy(object), "n": found.to_numpy()})

    counted = drawn.mapInPandas(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = stage(counted.where((F.length("word") < 64) & ~F.contains("word", F.lit("\0"))).orderBy(F.desc("n"), "word").limit(hot).select("word"))
    width = max(4, docs.sparkSession.sparkContext.defaultParallelism)
    told = chosen.repartition(width).select("word", spelled(F.element_at(fold(F.array("word"), ranks), 1)).alias("ids"))
    rows = stage(told).toArrow()
    return Dictionary(rows["word"].to_pylist(), rows["ids"].to_pylist())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids string) of every row: its ids as decimal numbers joined by one space; null and empty texts have the empty text.

    A match that is a piece of the vocabulary gets that piece's id. Repeated rows are encoded as often as they occur, extra columns are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ranks = read_ranks(ranks_path)
    ranked = RankMap(ranks)
    context = docs.sparkSession.sparkContext
    sent, pieces = context.broadcast(hot_words(rows, pattern, ranked)), context.broadcast(ranks)

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ids of known words; a word that isn't known leaves the number of its place in ``rare`` between two tildes."""
        get, split, ranks = sent.value.known().get, splitter(pattern), pieces.value

        def told(word: str, holes: dict[str, int]) -> str:
            raw = word.encode("utf-8", "replace")
            if raw in ranks:
                return str(ranks[raw])
            if len(raw) > SHORT:
                return " ".join(map(str, (heap_merge if len(raw) > LONG else list_merge)(raw, ranks)))
            return f"~{holes.setdefault(word, len(holes))}~"

        for batch in batches:
            known, rare = [], []
            for text in batch["text"]:
                words = split(text or "")
                ids, holes = list(map(get, words)), {}
                if None in ids:
                    for k, x in enumerate(ids):
                        if x is None:
                            ids[k] = told(words[k], holes)
                known.append(" ".join(ids))
                rare.append(list(holes))
            yield pd.DataFrame({"id": batch["id"], "known": known, "rare": rare})

    kind = rows.schema["id"].dataType.simpleString()
    half = rows.mapInPandas(looked_up, f"id {kind}, known string, rare array<string>")

    def filled(rare: Column) -> Column:
        # Between tildes, every second piece is the number of a hole.
        return F.array_join(F.transform(F.split("known", "~"), lambda x, i: F.when(i % 2 == 1, F.get(rare, F.when(i % 2 == 1, x).cast("int"))).otherwise(x)), "")

    held = F.transform(fold(F.col("rare"), ranked), spelled)
    return half.select(F.col("id").alias(id_col), F.when(F.size("rare") == 0, F.col("known")).otherwise(_let(held, filled)).alias("ids"))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded binary) of rows from ``encode``: the concatenated pieces of the ids."""
    ranks = read_ranks(ranks_path)
    piece = [""] * (max(ranks.values(), default=-1) + 1)
    for b, k in ranks.items():
        piece[k] = b.hex()
    literal = F.from_json(F.lit(json.dumps(piece)), "array<string>")

    def joined(pieces: Column) -> Column:
        return _let(F.split("ids", " "), lambda ids: F.struct(F.size(ids).cast("long").alias("n"), F.unhex(F.array_join(F.transform(ids, lambda x: F.get(pieces, x.cast("int"))), "")).alias("bytes")))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.unhex(F.lit("")).alias("bytes"))
    back = encoded.select(F.col(f"`{id_col}`"), "ids", F.when(F.col("ids") == "", none).otherwise(_let(literal, joined)).alias("back"))
    return back.select(F.col(f"`{id_col}`"), F.col("back.n").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.col("back.bytes").alias("decoded"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
