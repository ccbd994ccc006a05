"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions alone.

The index is a written table of postings (document, text hash, position, term) of those corpus words that test items ask for; a posting is made where its
text lies, so building it shuffles nothing.  Every window of an item names its rarest terms by the index's own counts; their postings, moved back by the
term's place in the item, are intersected: where enough of them meet on one start, the item may lie.  Only those documents are read again to
compare all words of the windows.  The same lists answer proximity: documents that hold an item's rarest terms within some words of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, stage, table
from .near_dedup import few

#: Words of a window, and rarest terms of each whose lists are intersected.
WINDOW, RAREST = 10, 3
#: Most bytes of a table of candidates that is broadcast; beyond it is shuffled.
BROADCAST_BYTES = 48 << 20


@dataclass
class PositionalIndex:
    """Postings of the corpus for the terms of some items, and what the items consist of."""

    postings: DataFrame  #: doc, h, pos, term
    items: DataFrame  #: item, part, w array<string>, t array<struct<n, p, term>> with n the term's postings, in the order of places


def term_of(word: Column) -> Column:
    return F.xxhash64(word)


def positional_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> PositionalIndex:
    """Index of all ``docs`` for the words of ``items`` (item_col, text_col).

    A document is known by its id and a hash of its text, so repeated rows share their postings. Items without an id or without a word take no part.
    """
    asked = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), ascii_words(F.col(f"`{text_col}`")).alias("w"))
    asked = asked.where(F.col("item").isNotNull() & (F.size("w") > 0)).withColumn("part", F.xxhash64("w")).dropDuplicates(["item", "part"])
    placed = stage(asked.select("item", "part", F.posexplode("w").alias("p", "word")).withColumn("term", term_of(F.col("word"))))
    wanted = few(stage(placed.select(F.col("term").alias("of")).distinct()))
    said = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.posexplode(ascii_words(F.col(f"`{text_col}`"))).alias("pos", "word"))
    postings = stage(said.select("doc", "h", "pos", term_of(F.col("word")).alias("term")).join(wanted, F.col("term") == F.col("of")).drop("of"))
    counts = stage(postings.groupBy("term").agg(F.count("*").alias("n")))
    known = placed.join(few(counts), "term", "left").select("item", "part", "p", "word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "p", "term").alias("t"))
    whole = known.groupBy("item", "part").agg(F.array_sort(F.collect_list(F.struct("p", "word", "t"))).alias("x"))
    return PositionalIndex(postings, stage(whole.select("item", "part", F.transform("x", lambda x: x["word"]).alias("w"), F.transform("x", lambda x: x["t"]).alias("t"))))


def windows_of(words: Column, window: int) -> Column:
    """First places of the windows: all runs of ``window`` words, or the whole of a shorter item."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0)))


def phrase_starts(index: PositionalIndex, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc, h, item, part, start): where in a document an item may begin: as many of its windows' rarest terms as one window names meet there.

    ``start`` is the position of the item's first word, negative where only its end can lie in the document. Every occurrence of a window is among them.
    """
    terms = F.transform(windows_of(F.col("t"), window), lambda s: F.slice(F.array_sort(F.slice("t", s + 1, window)), 1, rarest))
    # A window with a term that has no postings occurs nowhere.
    named = index.items.select("item", "part", F.least(F.size("t"), F.lit(min(window, rarest))).alias("need"), F.explode(F.filter(terms, lambda x: x[0]["n"] > 0)).alias("x"))
    named = stage(named.select("item", "part", "need", F.explode("x").alias("x")).select("item", "part", "need", F.col("x.p").alias("p"), F.col("x.term").alias("of")).distinct())
    moved = index.postings.join(few(named), F.col("term") == F.col("of")).select("doc", "h", "item", "part", "need", (F.col("pos") - F.col("p")).alias("start"))
    met = moved.groupBy("doc", "h", "item", "part", "need", "start").agg(F.count("*").alias("n"))
    return met.where("n >= need").drop("need", "n")


def phrase_matches(docs: DataFrame, index: PositionalIndex, window: int = WINDOW, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, item, part, start, hit array<int>): the positions of ``docs`` inside occurrences of an item's windows, all words compared."""
    starts = stage(phrase_starts(index, window, rarest))
    of_doc = stage(starts.groupBy("doc", "h").agg(F.collect_list(F.struct("item", "part", "start")).alias("may")))
    size = of_doc.agg(F.coalesce(F.sum(F.size("may")), F.lit(0)) * 64 + F.count("*") * 64).first()[0]
    held = (F.broadcast(of_doc) if size <= BROADCAST_BYTES else of_doc).withColumnsRenamed({"doc": "_doc", "h": "_h"})
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    both = texts.join(held, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).select("doc", "h", "may", ascii_words(F.col("text")).alias("said"))
    items = index.items.select(F.col("item").alias("_item"), F.col("part").alias("_part"), "w")
    lengths = items.agg(F.coalesce(F.sum(F.aggregate("w", F.lit(64), lambda a, x: a + F.length(x) + 24)), F.lit(0))).first()[0]
    items = F.broadcast(items) if lengths <= BROADCAST_BYTES else items
    one = both.select("doc", "h", F.explode("may").alias("m"), "said").select("doc", "h", "m.*", "said").join(items, (F.col("item") == F.col("_item")) & (F.col("part") == F.col("_part")))
    n = F.least(F.size("w"), F.lit(window))
    fits = lambda s: (F.col("start") + s >= 0) & (F.col("start") + s + n <= F.size("said"))
    same = lambda s: F.when(fits(s), F.slice("said", F.col("start") + s + 1, n) == F.slice("w", s + 1, n)).otherwise(False)
    found = one.select("doc", "h", "item", "part", "start", n.alias("n"), F.filter(windows_of(F.col("w"), window), same).alias("at")).where(F.size("at") > 0)
    covered = F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(F.col("start") + s, F.col("start") + s + F.col("n") - 1))))
    return found.select("doc", "h", "item", "part", "start", covered.alias("hit")).distinct()


def proximity_matches(index: PositionalIndex, within: int, rarest: int = RAREST) -> DataFrame:
    """(doc, h, item, part, pos): where an item's ``rarest`` rarest different terms all lie within ``within`` words of position ``pos`` of the rarest of them, in any order.

    Items of fewer different terms need all of theirs; items with a term that the corpus lacks among them match nowhere.
    """
    terms = F.array_sort(F.array_distinct(F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term")))))
    named = index.items.select("item", "part", F.slice(terms, 1, rarest).alias("x")).where(F.col("x")[0]["n"] > 0)
    named = stage(named.select("item", "part", F.size("x").alias("need"), F.posexplode("x").alias("rank", "y")).select("item", "part", "need", "rank", F.col("y.term").alias("of")))
    near = index.postings.join(few(named), F.col("term") == F.col("of")).select("doc", "h", "item", "part", "need", "rank", "pos").distinct()
    around = Window.partitionBy("doc", "h", "item", "part").orderBy("pos").rangeBetween(-within, within)
    return near.withColumn("got", F.size(F.collect_set("rank").over(around))).where("rank = 0 AND got = need").select("doc", "h", "item", "part", "pos")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items array<string>, contaminated), a row for each row of ``docs``.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of a whole shorter item. ``items`` holds the ids of the items with an
    occurrence, as sorted texts. Null and empty texts have no words and no hits; repeated rows each get a row; items without an id or a word take
    no part. Either table empty: no hits.
    """
    index = positional_index(docs, items, id_col, text_col, item_col)
    found = phrase_matches(docs, index, window, rarest, id_col, text_col)
    totals = found.select("doc", "h", "item", F.explode("hit").alias("pos")).groupBy("doc", "h").agg(F.count_distinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    totals = stage(totals.withColumnsRenamed({"doc": "_doc", "h": "_h"}))
    size = totals.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)) * 32 + F.count("*") * 64).first()[0]
    totals = F.broadcast(totals) if size <= BROADCAST_BYTES else totals
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.size(ascii_words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"))
    both = rows.join(totals, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    none = F.array().cast("array<string>")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(F.col("doc").alias(id_col), "n_words", n.alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), (n > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document, against ``benchmark``."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op11_decontamination": op11_decontamination}
ORACLES = {
    "op11_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
said AS (
  SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
), found AS (SELECT r, item, n, s FROM said JOIN windows USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
""",
}
