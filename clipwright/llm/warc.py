"""WARC archives and their capture index.

Writing: every page becomes a WARC/1.1 record, `response` or, if a page with a smaller id has the same payload, `revisit`.  A record is a gzip member of its own, so
it can be read by its offset alone.  Members go to the shared folder through Spark's text writer, which writes bytes as they are and commits files as for any other
table; the line end that it adds is the zero byte that a member ends in.  Files hold so many records that an average one has ARCHIVE_BYTES of payload; no page is moved
to fill them.
Reading: an archive is read member by member, and a record is cut by Content-Length, never by searching for a boundary that a payload might contain.
Index: each archive gives a run of captures sorted by (URL key, time, record).  Runs are cut at the same range bounds, and each range, of about RANGE rows, is merged from
its slices of all runs by a loser tree that holds one head a run; the ranges in order are the whole index in order, with each capture's place in its URL's history.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, small_batches, stage, table

#: Bytes that an archive file should hold before compression.
ARCHIVE_BYTES = 8 << 20
#: Most payloads with several pages that are broadcast; more meet the pages in a shuffle.
BROADCAST_ROWS = 200_000
#: Captures of a range of the index, which one task merges.
RANGE = 100_000
HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes: 40 hexadecimal digits make 32 letters of five bits."""
    bits = F.array_join(F.transform(F.regexp_extract_all(F.sha1(payload), F.lit("."), F.lit(0)), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    letter = lambda x: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(x, 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.regexp_extract_all(bits, F.lit("....."), F.lit(0)), letter), "")


def described(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, ts, html, payload_bytes, payload_digest, record_type, refers_to), null html as empty.

    Of equal payloads of at least ``least_bytes`` bytes the one with the least page_id is the response; a page without id can't be referred to and is a
    response. Repeated rows of one page_id: they share its type.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", "ts", body.alias("html")).withColumn("payload", F.encode("html", "UTF-8"))
    rows = rows.select("page_id", "url", "ts", "html", F.length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest"))
    # The least id of a payload is a partial aggregate, so a payload of a third of all pages costs one row a task.
    least = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    several = stage(least.agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("d", "b", "first"))
    if several.count() <= BROADCAST_ROWS:  # some 60 bytes a row: a size that is checked; pages then stay where they are
        several = F.broadcast(several)
    joined = rows.join(several, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") > F.col("first"))
    return joined.select(
        *rows.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def records(described_pages: DataFrame) -> DataFrame:
    """(value): the text of each record."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    name = lambda col: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(col).cast("string"), F.lit("none")), F.lit(">"))
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    # A revisit's block ends after the HTTP head: its payload is in the record that it refers to.
    block = F.concat(status, F.when(F.col("record_type") == "response", F.col("html")).otherwise(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.length(F.encode(block, "UTF-8")).cast("string")),
    )
    return described_pages.select(F.concat(head, F.lit("\r\n"), block, F.lit("\r\n\r\n")).alias("value"))


def member(record: bytes) -> bytes:
    """A gzip member with the record, which ends in a zero byte: the last of its length, or of an empty member after it where the record has 16 MiB or more."""
    out = b""
    for data in (record, b""):
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        out += packer.compress(data) + packer.flush()
        if not out[-1]:
            break
    return out


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each member of an archive, one at a time; empty members are passed over."""
    at = 0
    while at < len(data):
        unpacker, end, parts = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            if end >= len(data):
                raise ValueError(f"the member at byte {at} is cut")
            parts.append(unpacker.decompress(data[end : end + 65_536]))
            end += 65_536
        if record := b"".join(parts):
            yield at, record
        at = min(end, len(data)) - len(unpacker.unused_data)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> str:
    """Writes a record for each of ``pages`` (page_id, url, ts, html) and returns the folder of archives in the shared storage."""
    path = shared_dir(pages.sparkSession)
    small_batches(pages.sparkSession)
    size = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit("")))).alias("mean")).first()["mean"] or 0
    records_a_file = max(1, int(ARCHIVE_BYTES // (size + 600)))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [member(x.encode("utf-8", "surrogatepass"))[:-1] for x in batch["value"]]})

    rows = records(described(pages, least_bytes)).mapInPandas(packed, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_a_file).text(path)
    return path


def parse_record(record: bytes) -> tuple:
    """(page_id, url, ts, record_type, refers_to, payload_digest, payload_bytes, payload) of one record.

    Payload, its digest and its length come from a response's bytes, and from a revisit's head, whose payload lies elsewhere (None here).
    """
    head = HEAD.match(record)
    if not head:
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in head[1].decode().split("\r\n"))
    payload = record[head.end() : head.end() + int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    refers, own = (re.sub(r"^<urn:page:(.*)>$", r"\1", fields.get(x, "")) for x in ("WARC-Refers-To", "WARC-Record-ID"))
    known = (None if own == "none" else int(own), fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Type"], int(refers) if refers else None)
    if fields["WARC-Type"] != "response":
        return *known, fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"]), None
    return *known, base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, position, page_id, url, ts, record_type, refers_to, payload_digest, payload_bytes, payload) of every record; position is its member's offset."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for at, record in members(data):
                    rows.append((archive, at, *parse_record(record)))
                    size += len(record)
                    if size > 4 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    fields = "archive string, position long, page_id long, url string, ts string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(parsed, fields)


def url_key(url: str | None) -> str:
    """The URL in the order of its host's labels: `org,example)/path?query`, lower case, without user, port 80 or 443, `www.`, or fragment."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


class LoserTree:
    """Merges sorted iterators: a node keeps the loser of its match, so a step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.size = runs, max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.loser = [-1] * self.size
        for leaf in range(self.size):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; the unplayed (-1) come before all, ended runs last."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node > 0:
            if self._before(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (best := self.head[self.loser[0]]) is not None:
            yield best
            run = self.loser[0]
            self.head[run] = next(self.runs[run], None)
            self._play(run)


def capture_index(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """All columns of ``captures`` (archive, position, url, ts, ...) with url_key, part and capture, in global order of (url_key, ts, archive, position).

    Rows of a lower ``part`` come before those of a higher, and each part is in order; ``capture`` is the row's place, from 1, in the history of its URL key.
    Runs are the archives, each sorted where it was read. Ranges cut between any two rows, so a URL with a third of all captures lies in many of them.
    """
    key = F.pandas_udf(lambda s: s.map(url_key), T.StringType())
    ordered = ["url_key", "ts", "archive", "position"]
    runs = stage(captures.withColumn("url_key", key("url")).sortWithinPartitions(*ordered))
    ranges = ranges or max(runs.rdd.getNumPartitions(), -(-runs.count() // RANGE))
    names = runs.columns
    longs = {f.name: "Int64" for f in runs.schema if f.dataType == T.LongType()}

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The slices come one run after another, each in order. They stay columns; only the head of each is a row of Python's."""
        held = [b.astype(longs) for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        keys = [rows[c].to_numpy(object) for c in ordered]
        cuts = [0, *(np.flatnonzero(keys[2][1:] != keys[2][:-1]) + 1).tolist(), len(rows)]
        heads = lambda a, b: ((*(k[i] for k in keys), i) for i in range(a, b))
        order, before, n = [], None, 0
        for *this, i in LoserTree([heads(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]):
            n = n + 1 if this[0] == before else 1
            before = this[0]
            order.append((i, n))
            if len(order) == 10_000:
                yield told(rows, order)
                order = []
        if order:
            yield told(rows, order)

    def told(rows: pd.DataFrame, order: list[tuple[int, int]]) -> pd.DataFrame:
        out = rows.iloc[[i for i, _ in order]].reset_index(drop=True)
        return out[names].assign(capture=[n for _, n in order])

    # Each range gets its slice of each run, run by run.
    dealt = runs.repartitionByRange(ranges, *ordered).sortWithinPartitions("archive", *ordered)
    whole = T.StructType([*runs.schema.fields, T.StructField("capture", T.LongType())])
    index = stage(dealt.mapInPandas(merged, whole).withColumn("part", F.spark_partition_id()))
    # A key that goes on in another part: its places there start after those of the parts before. At most one such key lies across each bound of parts.
    counts = index.groupBy("url_key", "part").agg(F.count("*").alias("n"))
    last = counts.withColumn("parts", F.count("*").over(Window.partitionBy("url_key"))).where("parts > 1")
    before = F.sum("n").over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = stage(last.select(F.col("url_key").alias("_key"), F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_n")).where("_n > 0"))
    joined = index.join(F.broadcast(moved), (F.col("url_key") == F.col("_key")) & (F.col("part") == F.col("_part")), "left")  # fewer rows than parts
    return joined.withColumn("capture", F.col("capture") + F.coalesce("_n", F.lit(0))).drop("_key", "_part", "_n")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, capture for every page, from the archives' merged index.

    Pages have no time of capture; it is taken as the page_id in seconds from the year 2000.
    """
    pages = table(spark, sf_dir, "pages")
    when = F.timestamp_seconds(F.lit(946_684_800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    path = write_archives(pages.select("page_id", "url", when.alias("ts"), "html"))
    captures = read_archives(spark, path).drop("payload")
    return capture_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture")


_HOST = r"regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_PORT = r"regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)', 1)"
_PATH = r"regexp_extract(low, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(low, '^[^?#]*[?]([^#]+)', 1)"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": f"""
WITH b AS (SELECT page_id, lower(trim(coalesce(url, ''))) AS low, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, low, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM b),
k AS (SELECT *, array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www[0-9]*[.]', ''), '.')), ',') || CASE WHEN {_PORT} IN ('', '80', '443') THEN '' ELSE ':' || {_PORT} END || ')'
  || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS url_key FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: '{_LETTERS}'[((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, url_key,
  row_number() OVER (PARTITION BY url_key ORDER BY coalesce(page_id, 0) % 1000000000, page_id) AS capture
FROM k"""
}
