"""Line deduplication by content-defined chunks of lines.

A hash rolls over the hashes of neighbouring lines and says where a chunk ends. Chunks of at least two lines that occur more than once in the
corpus are found by grouping their bytes (not their hashes); all occurrences but the first (least doc_id, then place) are removed. Blank lines
between chunks stay.

With ``whole`` the corpus decides on boundaries too. The rolling hash of every two neighbouring non-blank lines is counted over all documents, and a chunk is
a run of pairs that are met more than once and in the same documents (by ``BITS`` bits of a hash of which ones): it ends where a repeated passage meets text
of its own, where a passage that some documents hold meets one that others do, and inside by the rolling hash alone or where
a pair comes again. So a passage is cut alike whatever stands
around it. Neighbouring chunks share a line, as a pair of lines may straddle a boundary. Missed are chunks whose pairs stand apart in the other documents, or whose
documents' bits fall together. Without
``whole`` the rolling hash alone decides: an inserted or deleted line moves only the boundaries beside it, but a chunk's edge seldom falls on the edge of
a short passage, and most short ones stay.

Texts move twice, once as candidates and once to be cut; a common candidate is counted on the map side before it moves. With ``whole`` only runs of
pairs that repeat are candidates. Counts reach the tasks as bitmaps of bounded size: where two hashes fall together a boundary may be missing, in every
document alike.

Defined cases: a null text stays null and an empty one empty; a text of one line is never changed; rows that repeat a doc_id with other texts are
documents of their own, in the order of their texts' hashes, and rows equal in id and text share one decision; a null doc_id counts as the largest;
two different chunks with one 128-bit hash are both left in place; an empty table gives an empty one; further columns pass through, and where one has
the name of a column of the result, the result's gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, discard, flagged, flags, written

LEAST, MOST, ONE_IN = 2, 16, 2
BITS = 4
MASK = (1 << 64) - 1
LAST_ID = (1 << 63) - 1


def chunks(lines: list[str], least: int = LEAST, most: int = MOST, one_in: int = ONE_IN) -> list[tuple[int, int]]:
    """(start, end) of each chunk of the lines. A boundary depends on the two lines before it and on the chunk's length."""
    out, start, before = [], 0, 0
    digest = xxhash.xxh3_64_intdigest
    for i, line in enumerate(lines):
        h = digest(line)
        rolled = (h * 0x9E3779B97F4A7C15 + before * 0xC2B2AE3D27D4EB4F) & MASK
        before = h
        if i + 1 - start >= most or (i + 1 - start >= least and (rolled >> 40) % one_in == 0):
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rolled(lines: list[str]) -> tuple[list[int], list[int]]:
    """The places of the non-blank lines, and the rolling hash at each but the last: that of the line and the next."""
    solid = [i for i, line in enumerate(lines) if line and not line.isspace()]
    hashes = [xxhash.xxh3_64_intdigest(lines[i]) for i in solid]
    return solid, [signed((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & MASK) for a, b in zip(hashes, hashes[1:], strict=False)]


def runs(solid: list[int], hashes: list[int], levels: list[int], one_in: int = ONE_IN) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, by the rolling hash of each pair of lines and where else the pair is met (0: nowhere)."""
    out, start, held = [], 0, set()
    for i, level in enumerate(levels):
        if i and (level != levels[i - 1] or ((hashes[i - 1] & MASK) >> 40) % one_in == 0 or hashes[i] in held):
            if levels[start]:
                out.append((solid[start], solid[i] + 1))
            start, held = i, set()
        held.add(hashes[i])
    if levels and levels[start]:
        out.append((solid[start], solid[-1] + 1))
    return out


def candidates(texts: list[str | None], bitmaps: list[np.ndarray] | None = None) -> Iterator[list[tuple[int, int, int, int, str]]]:
    """(start, end, hash, hash, bytes) of the chunks that may be removed of each text, by place. ``bitmaps``: of ``met_together``."""
    every = [(t or "").split("\n") for t in texts]
    if bitmaps is None:
        spans = [chunks(lines) if len(lines) > 1 else [] for lines in every]
    else:
        places, hashes = zip(*map(rolled, every), strict=True) if every else ((), ())
        flat = np.fromiter((h for own in hashes for h in own), np.int64)
        repeats, *bits = (flagged(bitmap, flat).astype(np.int64) for bitmap in bitmaps)
        levels = (repeats * (1 + sum(bit << k for k, bit in enumerate(bits)))).tolist()
        at = np.cumsum([0, *map(len, hashes)]).tolist()
        spans = [runs(places[i], hashes[i], levels[at[i] : at[i + 1]]) for i in range(len(every))]
    for lines, own in zip(every, spans, strict=True):
        out = []
        for a, b in own:
            body = "\n".join(lines[a:b])
            if b - a >= LEAST and body and not body.isspace():
                d = xxhash.xxh3_128_intdigest(body)
                out.append((a, b, signed(d >> 64), signed(d & MASK), body))
        yield out


def met_together(docs: DataFrame) -> list[np.ndarray]:
    """Bitmaps of the pairs of neighbouring lines: those that stand in more than one place, and each of ``BITS`` bits of a hash of the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                pairs, counts, docs_of = [], [], []
                for doc_id, row, text in zip(*(b.column(i).slice(k, 512).to_pylist() for i in range(3)), strict=True):
                    own, n = np.unique(np.array(rolled((text or "").split("\n"))[1], np.int64), return_counts=True)
                    pairs.append(own)
                    counts.append(n)
                    docs_of.append(np.full(len(own), signed(xxhash.xxh3_64_intdigest(f"{doc_id} {row}")), np.int64))
                pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                order = np.argsort(pair, kind="stable")
                pair, n, of = pair[order], np.concatenate(counts)[order], np.concatenate(docs_of)[order]
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
                sums = (np.add.reduceat(n, first), np.bitwise_xor.reduceat(of, first)) if len(pair) else (n, of)
                yield pa.RecordBatch.from_arrays([pa.array(pair[first]), *map(pa.array, sums)], names=["pair", "n", "of"])

    counts = keyed(docs).mapInArrow(alone(run), "pair long, n long, of long").groupBy("pair").agg(F.sum("n").alias("n"), F.bit_xor("of").alias("of")).where("n > 1")
    counts = written(counts, "line_pairs")
    out = [flags(counts, "pair"), *[flags(counts.where(F.col("of").bitwiseAND(1 << k) != 0), "pair") for k in range(BITS)]]
    discard(counts)
    return out


def listed(docs: DataFrame, with_text: bool, bitmaps: list[np.ndarray] | None = None) -> DataFrame:
    """(doc_id, row, h1, h2, times[, chunk]) of each document's distinct chunks; ``row``: its text's hash."""
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                rows = []
                ids, texts_rows, texts = (b.column(i).slice(k, 512).to_pylist() for i in range(3))
                for doc_id, row, found in zip(ids, texts_rows, candidates(texts, known.value), strict=True):
                    own: dict[tuple, list] = {}
                    for _, _, h1, h2, body in found:
                        own.setdefault((h1, h2, body), [doc_id, row, h1, h2, 0, body])[4] += 1
                    rows += own.values()
                columns = list(zip(*rows, strict=True)) or [()] * 6
                got = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.string()], strict=True)]
                names = ["doc_id", "row", "h1", "h2", "times", "chunk"]
                yield pa.RecordBatch.from_arrays(got if with_text else got[:5], names=names if with_text else names[:5])

    return keyed(docs).mapInArrow(alone(run), "doc_id long, row long, h1 long, h2 long, times long" + ", chunk string" * with_text)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def repeated(docs: DataFrame, bitmaps: list[np.ndarray] | None = None) -> DataFrame:
    """(h1, h2, first) of the chunks that occur more than once, grouped by their bytes; ``first``: (doc_id, row) of the first document."""
    first = F.min(F.struct("doc_id", "row")).alias("first")
    groups = listed(docs, True, bitmaps).groupBy("h1", "h2", "chunk").agg(F.sum("times").alias("times"), first)
    groups = groups.drop("chunk").groupBy("h1", "h2").agg(F.count("*").alias("texts"), F.sum("times").alias("times"), F.min("first").alias("first"))
    return groups.where("texts = 1 and times > 1").select("h1", "h2", "first")


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut, and three columns more: lines_total, lines_removed, chunks_removed. With ``whole`` the corpus decides on boundaries."""
    bitmaps = met_together(docs) if whole else None
    # Written, so that the rows of a chunk that many documents hold can be dealt to several tasks.
    again = written(repeated(docs, bitmaps), "repeated_chunks")
    found = listed(docs, False, bitmaps).join(again, ["h1", "h2"])
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    found = found.where(~own | (F.col("times") > 1)).groupBy("doc_id", "row").agg(F.collect_list(F.struct("h1", "h2", own.alias("own"))).alias("cuts"))
    found = found.select(F.col("doc_id").alias("cut_id"), F.col("row").alias("cut_row"), "cuts")
    names = docs.columns
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*names).alias("doc"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"), F.xxhash64(text).alias("row"))
    rows = rows.join(found, (rows["key"] == found["cut_id"]) & (rows["row"] == found["cut_row"]), "left").select("doc", "text", "cuts")
    doc = rows.schema["doc"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, lost, cut = b.column(1).to_pylist(), [], [], []
            for i, cuts in enumerate(b.column(2).to_pylist()):
                text = texts[i]
                totals.append(0 if text is None else text.count("\n") + 1)
                gone = {(c["h1"], c["h2"]): c["own"] for c in cuts or ()}
                dropped = [0, 0]
                if gone:
                    lines, kept, done = text.split("\n"), [], 0
                    for a, e, h1, h2, _ in next(candidates([text], known.value)):
                        if (h1, h2) in gone:
                            if gone[h1, h2]:
                                gone[h1, h2] = False  # its first place in the first document stays
                            else:
                                kept += lines[done:a]  # empty where chunks share a line
                                dropped = [dropped[0] + e - max(a, done), dropped[1] + 1]
                                done = e
                    texts[i] = "\n".join(kept + lines[done:])
                lost.append(dropped[0])
                cut.append(dropped[1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(lost, pa.int64()), pa.array(cut, pa.int64())],
                names=["doc", "text", "lines_total", "lines_removed", "chunks_removed"],
            )

    out = rows.mapInArrow(alone(run), f"doc {doc}, text string, lines_total long, lines_removed long, chunks_removed long")
    return out.select(*[F.col("text") if n == "text" else F.col("doc")[n].alias(n) for n in names], *[F.col(n).alias(n + "_" * (n in names)) for n in ("lines_total", "lines_removed", "chunks_removed")])
