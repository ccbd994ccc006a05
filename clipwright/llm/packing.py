"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Documents are cut only where they are longer than a sequence: into full pieces, of which the first may be shorter.  The plan sees how many pieces there
are of each length, never the pieces: it goes through lengths from the longest down and puts as many pieces as fit into the open sequences with the
least room that still takes them, all sequences with equal room at once.  A placement says: pieces of this length with ranks from a to b go, one each, into
sequences from s on, at this offset.  Then every piece finds its slot by its rank among the pieces of its length.

Ranks are taken without bringing a length together in one task: pieces are spread over blocks by a hash, ranked within (length, block), and
moved up by the number of pieces in the blocks before.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, small_batches, stage, table

LENGTH = 2048
#: Most pieces that one rank task should sort.
BLOCK = 20_000
#: Texts that the fast reading of the vocabulary splits as the vocabulary file's own library does, whatever their Unicode versions.
PLAIN = re.compile("[^\\t\\n\\r -~\\xa0-\\u024f]|<\\|")
_encoders: dict[str, object] = {}


def encoder(file: str):
    """text -> ids by the tokenizer file with this content, no special tokens added; one for each worker process.

    Byte-level files are read into a byte-pair encoder that gives the same ids several times faster; texts with characters on which
    Unicode versions may differ, or with a special token's text, go through the tokenizers library itself.
    """
    name = hashlib.md5(file.encode()).hexdigest()
    if name not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(file)
        own: list[Tokenizer] = []  # some 40 MB, so it is read when the first text needs it

        def own_ids(text: str) -> list[int]:
            if not own:
                own.append(Tokenizer.from_str(file))
            return own[0].encode(text, add_special_tokens=False).ids

        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab") or {}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        bytewise = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"].get("merges", [])]
        ordered = bytewise and all(vocab[a + b] < vocab[c + d] for (a, b), (c, d) in zip(merges, merges[1:], strict=False))
        if ordered:
            # Bytes of the printable stand-ins that byte-level vocabularies use.
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _encoders[name] = lambda text: own_ids(text) if PLAIN.search(text) else fast(text)
        else:
            _encoders[name] = own_ids
    return _encoders[name]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of n tokens: full pieces at the end, what remains at the front."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def tokenised(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and with ``with_ids`` ids) of every document: its ids, then the id ``end``.

    Null texts count as empty: one piece of one id.
    """

    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "")
                ids.append(end)
                raw = struct.pack(f"<{len(ids)}I", *ids)
                for k, (s, n) in enumerate(cut(len(ids), length)):
                    part = raw[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(part), *((np.frombuffer(part, np.uint32).astype(np.int32),) if with_ids else ())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInPandas(pieces, fields)


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(piece length, first rank, pieces, first sequence, offset)], sequences) for so many pieces of each length.

    Best fit, longest pieces first; open sequences with equal room lie in runs of neighbouring numbers.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # runs (first sequence, how many) by room left
    placed, used = [], 0
    for size in sorted(counts, reverse=True):
        left, rank, free = counts[size], 0, size
        while left:
            while free <= length and not room[free]:
                free += 1
            if free > length:  # none has room: open as many as the rest fills
                n = -(-left // (length // size)) if size else left
                room[length].append((used, n))
                used += n
                free = length
            s, n = room[free].pop()
            if n > left:
                room[free].append((s + left, n - left))
                n = left
            placed.append((size, rank, n, s, length - free))
            room[free - size].append((s, n))
            left, rank = left - n, rank + n
            free = size
    return placed, used


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (with a column length, from 1 to ``length``) with sequence_id and offset; other columns stay. Reads ``pieces`` three times."""
    blocks, rank, block, before = (fresh(pieces, x) for x in ("blocks", "rank", "block", "before"))
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    placed, _ = plan(sizes, length)
    spread = max(1, -(-max(sizes.values(), default=1) // BLOCK))
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread))
    kept = pieces.withColumn(block, key)
    counts = kept.groupBy(F.col("length").alias(blocks), block).agg(F.count("*").alias(before))
    lower = Window.partitionBy(blocks).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(lower), F.lit(0))).withColumnRenamed(block, f"{block}_c")
    within = Window.partitionBy("length", block).orderBy("doc_id", "piece", "ids_crc32")
    ranked = kept.withColumn(rank, F.row_number().over(within) - 1).join(counts, (F.col("length") == F.col(blocks)) & (F.col(block) == F.col(f"{block}_c")))
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before))
    # The plan's size depends on ``length`` alone: each placement uses up a length or a run of sequences.
    slot = [fresh(pieces, f"slot{k}") for k in range(5)]
    slots = pieces.sparkSession.createDataFrame(placed, ", ".join(f"{c} long" for c in slot))
    at = (F.col("length") == F.col(slot[0])) & (F.col(rank) >= F.col(slot[1])) & (F.col(rank) < F.col(slot[1]) + F.col(slot[2]))
    out = ranked.join(F.broadcast(slots), at)
    return out.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col(slot[3]) + F.col(rank) - F.col(slot[1])).alias("sequence_id"), F.col(slot[4]).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Every document tokenised, cut and packed: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    An empty table gives an empty result; repeated rows are packed as often as they occur; extra columns of ``docs`` are left out.
    """
    return pack(stage(tokenised(docs, tokenizer, length, with_ids=with_ids)), length)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
