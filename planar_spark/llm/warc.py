"""WARC archives, and the external merge of their capture index.

Writing: a record per page, in files that Spark's own writers commit. Each file's records are sorted by url key and
time. A payload of at least ``least`` bytes that an earlier page holds becomes a revisit record without payload.

Reading: files are parsed by Content-Length; every record yields an index row, so each file is a
locally sorted run of captures. Runs are cut at common key ranges, and each range merges its pieces of all runs with
a loser tree: ranges in order, and rows in order within, are the global capture history (range_no, place).

Defined cases: null html is an empty payload; a null url has an empty key and no WARC-Target-URI; control characters in a
url are percent-encoded in its header; repeated page_ids are separate records, each with its own payload; empty tables
give an empty index; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts
from .loser_tree import merge
from .ranges import cut_points, range_of

END = "\r\n\r\n"
INDEX = "run string, seq long, url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, at long"
KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(url_key, captured, page_id, record) of each page. Payloads move once; the choice of responses uses digests."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sums = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least)
    first = sums.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = sums.join(first, "digest").where("page_id <> refers_to").select("page_id", F.col("digest").alias("of"), "refers_to").distinct()
    safe = F.col("url")
    for c in range(32):
        safe = safe if c not in (0, 9, 10, 13) else F.replace(safe, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    host = F.translate(F.regexp_extract(safe, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract(safe, r"://[^/?#]*([^#]*)", 1)
    key = F.when(safe.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest)).otherwise("")
    one = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("of")).join(again, ["page_id", "of"], "left")
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    is_new = F.col("refers_to").isNull()
    # No clock stands in the table: captures are dated one second apart in the order of their ids.
    when = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce("page_id", F.lit(0)) % 100_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_new, "response").otherwise("revisit")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))), F.lit("")),
        line("WARC-Date", when),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("of"))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))), F.lit("")),
        F.when(is_new, "").otherwise("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(is_new, size).otherwise(0)).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, http, F.when(is_new, F.col("payload")).otherwise(""))
    return one.select(key.alias("url_key"), when.alias("captured"), "page_id", record.alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, per_file: int = 20_000) -> None:
    """Gzipped WARC files, each a run sorted by (url key, time, page_id)."""
    runs = records(pages, least).sortWithinPartitions("url_key", "captured", "page_id").select("value")
    runs.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


class Inflated:
    """A reader over a gzip stream that keeps only what the next record needs."""

    def __init__(self, content: bytes, piece: int = 1 << 16):
        self.content, self.piece, self.fed, self.z, self.buffer, self.start, self.at = content, piece, 0, zlib.decompressobj(31), b"", 0, 0

    def more(self) -> bool:
        while self.fed < len(self.content) or self.z.unused_data:
            if self.z.eof:
                rest = self.z.unused_data
                if not rest and self.fed >= len(self.content):
                    return False
                self.z = zlib.decompressobj(31)
                got = self.z.decompress(rest)
            else:
                got = self.z.decompress(self.content[self.fed : self.fed + self.piece])
                self.fed += self.piece
            if got:
                self.buffer, self.start = self.buffer[self.start :] + got, 0
                return True
        return False

    def take(self, n: int) -> bytes:
        pieces, need = [], n
        while need:
            got = self.buffer[self.start : self.start + need]
            pieces.append(got)
            self.start += len(got)
            need -= len(got)
            if need and not self.more():
                break
        self.at += n - need
        return b"".join(pieces)

    def until(self, mark: bytes) -> bytes:
        while (i := self.buffer.find(mark, self.start)) < 0:
            if not self.more():
                return self.take(len(self.buffer) - self.start)
        return self.take(i + len(mark) - self.start)


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bytes]]:
    """(offset, headers, http headers, payload) of each record of a gzipped archive."""
    source = Inflated(content)
    while True:
        at = source.at
        head = source.until(END.encode())
        if not head.strip():
            return
        lines = head.decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        block = source.take(int(headers["Content-Length"]))
        http, _, payload = block.partition(END.encode())
        if source.take(4) != END.encode():
            raise ValueError(f"no record end after offset {at}")
        yield at, headers, http, payload


def surt(url: str | None) -> str:
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return ""
    ends = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:ends].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return ",".join(reversed(host.split("."))) + ")" + rest[ends:].partition("#")[0]


def number(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index row per record, with size and digest of the payload that stands in the archive; a revisit has the digest of its header only."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py().rpartition("/")[2], []
                for seq, (at, h, _, payload) in enumerate(parse(batch.column(1)[i].as_py())):
                    new = h["WARC-Type"] == "response"
                    rows.append((name, seq, surt(h.get("WARC-Target-URI")), h["WARC-Date"], number(h.get("WARC-Record-ID")), h["WARC-Type"], number(h.get("WARC-Refers-To")), len(payload) if new else None, hashlib.sha256(payload).hexdigest() if new else h["WARC-Payload-Digest"].partition(":")[2], at))
                columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(scan, INDEX)


def merge_index(index: DataFrame, ranges: int | None = None, per_range: int = 100_000) -> DataFrame:
    """External merge: the index in global order of (url_key, captured, page_id), as (range_no, place). Ranges hold about ``per_range`` rows at most,
    so a task's memory does not grow with the index."""
    ranges = ranges or max(parts(index.sparkSession), index.count() // per_range + 1)
    lowest = -(1 << 63)
    cuts = [(a, b, lowest if c is None else c) for a, b, c in cut_points(index.where("page_id is not null"), ["url_key", "captured", "page_id"], ranges)]
    whole = lambda r: (r[2], r[3], lowest if r[4] is None else r[4])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
            which = pa.array([range_of(cuts, whole(r)) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([which, *b.columns], names=["range_no", *NAMES])

    def merged(rows: list[tuple]) -> Iterator[tuple]:
        runs: dict[str, list[tuple]] = {}
        for r in rows:
            runs.setdefault(r[0], []).append(r)
        return merge([runs[k] for k in sorted(runs)], whole)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            for rows in batched(((now, i, *r) for i, r in enumerate(merged(held))), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *KINDS], strict=True)], names=["range_no", "place", *NAMES])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if r[0] != now and held:
                    yield from flush()
                    held = []
                now = r[0]
                held.append(r[1:])
        if held:
            yield from flush()

    dealt = index.mapInArrow(deal, "range_no int, " + INDEX).repartition(len(cuts) + 1, "range_no")
    return dealt.sortWithinPartitions("range_no", "run", "seq").mapInArrow(combine, "range_no int, place long, " + INDEX)


def in_history(merged: DataFrame) -> DataFrame:
    """The merged index with ``position``, from 1 on in the global capture history: what earlier ranges hold, and the place in the own one."""
    own = merged.groupBy("range_no").agg(F.count("*").alias("held"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = own.select("range_no", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    return merged.join(before, "range_no").withColumn("position", F.col("before") + F.col("place") + 1).drop("before")


def resolved(index: DataFrame) -> DataFrame:
    """Give revisits the size of the payload that they refer to, as read from its own record: that of the page with the same digest."""
    new = index.where("record_type = 'response'")
    of = new.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    again = index.where("record_type = 'revisit'").join(of, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return new.union(again.select(*[F.col("of_bytes").alias(c) if c == "payload_bytes" else F.col(c) for c in new.columns]))
