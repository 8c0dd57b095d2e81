"""Repeated substrings by a sparse, distributed suffix sort.

Every byte covered by a ``length``-byte string that also starts elsewhere goes. Sorting all suffixes would move each byte ``length`` times, so the
suffixes that are sorted are those at anchors: of any ``length - gram + 1`` neighbouring ``gram``-byte strings the one with the least hash is an
anchor. Two equal strings of ``length`` bytes have an anchor at the same place, so their suffixes from there stand side by side in the order.

1. Anchors are listed with the hash of their gram and of their whole context (``length - gram`` bytes before, ``length`` from it on). Grams that occur
   once are done. Of anchors with equal contexts one is sorted, with their number.
2. Each task sorts its suffixes (gram hash, then bytes) into runs and front-codes them: only what differs
   from the suffix before is sent. A range of the order merges its runs with a loser tree that knows the prefixes that its
   candidates share and never compares them again. Ranges are cut at gram hashes and, inside a gram that would fill more than two of them, at suffixes of a
   sample, so that no gram fills a task.
3. The merged order decides what repeats: ``shift`` bytes before an anchor a string of ``length`` bytes starts that stands elsewhere too, if a neighbourhood of
   the order shares ``length - shift`` bytes from the anchor on (its common prefixes say so) and another member of it has the same ``shift`` bytes before.
   The first and last repeated shift bound what the anchor covers, since all of these strings contain it.
4. A neighbourhood that reaches over a cut is settled by counting: its members send the hashes of these strings as rows, with partial sums before they move.

Contexts, bytes before an anchor, and strings over a cut are compared by 64-bit hashes.

Defined cases: null counts as empty; texts under ``length`` bytes lose nothing; rows that repeat id and text count as occurrences of each other; very
long texts are processed whole; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flagged, flags, parts, written
from .loser_tree import common, merge_prefixed

R = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(R), -1, 1 << 64))
PIECE = 1 << 18
RUN = 6_000_000  # bytes of a task's suffixes that are sorted together
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, modulo 2**64; kept by the worker up to a few MB."""
    if len(POWERS.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", R), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            POWERS[name] = np.multiply.accumulate(x)
    up, down = POWERS["up"][:n], POWERS["down"][:n]
    if n > 4 * PIECE:
        POWERS.clear()
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Text:
    """Hashes of any stretch of a byte string."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: self.n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, length: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, context hash) of each anchor of one text, which is looked at in pieces."""
    n, before, found = len(data), length - gram, []
    bits = np.uint64(piece + 4 * length).item().bit_length()
    for k in range(0, n - length + 1, piece):
        # The windows that start in this piece, with all that the contexts of their anchors hold.
        start, last = max(0, k - before), min(n - length + 1, k + piece)
        text = Text(data[start : min(n, last + before + length)])
        at = np.arange(k - start, last - start + before)
        h = text.hashes(at, at + gram)
        # The leftmost of equal hashes wins: the place is the tie-break.
        order = (h >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
        chosen = np.unique(least(order, before + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
        a, b = np.maximum(chosen - before, 0), np.minimum(chosen + length, text.n)
        context = mixed(text.hashes(a, chosen) * np.uint64(3) + text.hashes(chosen, b))
        found.append((chosen + start, h[chosen - at[0]], context))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    place, h, context = (np.concatenate(x) for x in zip(*found, strict=True))
    place, first = np.unique(place, return_index=True)
    # Anchors have small hashes: mixed once more they fill the ranges evenly.
    return place, mixed(h[first] ^ R), context[first]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))


def listed(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, held, size = b.column(0).to_numpy(), [], 0
            for i in range(b.num_rows):
                got = anchors(np.frombuffer(b.column(1)[i].as_buffer(), np.uint8), length, gram)
                if len(got[0]):
                    held.append((np.full(len(got[0]), keys[i]), *got))
                    size += len(got[0])
                if held and (size > 50_000 or i + 1 == b.num_rows):
                    key, at, h, e = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(e.view(np.int64))], names=["key", "at", "h", "e"])
                    held, size = [], 0

    return rows.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(run, "key long, at int, h long, e long")


def coded(rows: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run, front-coded: shared and own length of each string, its own bytes, and a payload."""
    out, before = [], b""
    for string, payload in rows:
        n = common(before, string)
        out.append(n.to_bytes(2) + (len(string) - n).to_bytes(2) + len(payload).to_bytes(2) + string[n:] + payload)
        before = string
    return b"".join(out)


def decoded(run: bytes) -> list[tuple[int, bytes, bytes]]:
    out, at, before = [], 0, b""
    while at < len(run):
        n, own, pay = (int.from_bytes(run[at + i : at + i + 2]) for i in (0, 2, 4))
        at += 6
        before = before[:n] + run[at : at + own]
        out.append((n, before, run[at + own : at + own + pay]))
        at += own + pay
    return out


def neighbourhoods(shared: np.ndarray, least_shared: int) -> np.ndarray:
    """Numbers of the stretches of the order whose neighbours share so many bytes."""
    return np.cumsum(shared < least_shared)


def decide(order: list[tuple[int, bytes, bytes]], length: int, gram: int, below: bytes | None, above: bytes | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From a stretch of the merged order, whole grams or all that lies between two cuts: (h, e, low, high), first and last repeated shift; and
    (h, e, times, shift, string) of the neighbourhoods that reach over a cut. An entry: (prefix shared with the one before, gram hash and
    suffix, context hash and times and bytes before the anchor)."""
    n, before = len(order), length - gram
    shared = np.array([x[0] for x in order], np.int64)
    shared[0] = 0
    right = np.array([len(x[1]) - 8 for x in order])
    left = np.array([len(x[2]) - 16 for x in order])
    times = np.array([int.from_bytes(x[2][8:16]) for x in order])
    h = np.frombuffer(b"".join(x[1][:8] for x in order), ">u8").astype(np.uint64)
    e = np.frombuffer(b"".join(x[2][:8] for x in order), ">u8").astype(np.uint64)
    grid = np.zeros((n, before), np.uint8)
    for i, x in enumerate(order):
        if left[i]:
            grid[i, before - left[i] :] = np.frombuffer(x[2][16:], np.uint8)
    # Hashes of the bytes before the anchor, by their number.
    hashes = np.zeros((before + 1, n), np.uint64)
    for k in range(before):
        hashes[k + 1] = mixed(hashes[k] * R + grid[:, before - 1 - k].astype(np.uint64) + np.uint64(1))
    over = 0 if below is None else common(below, order[0][1]), 0 if above is None else common(above, order[-1][1])
    low, high, rows = np.full(n, -1), np.full(n, -1), []
    for shift in range(before + 1):
        ok = (left >= shift) & (right >= length - shift)
        if not ok.any():
            continue
        where = neighbourhoods(shared, 8 + length - shift)
        cut = np.zeros(n, bool)
        if over[0] >= 8 + length - shift:
            cut |= where == where[0]
        if over[1] >= 8 + length - shift:
            cut |= where == where[-1]
        at = np.flatnonzero(ok & ~cut)
        if len(at):
            _, which = np.unique(mixed(where[at].astype(np.uint64) * R) ^ hashes[shift, at], return_inverse=True)
            at = at[np.bincount(which, times[at])[which] > 1]
            high[at] = shift
            low[at] = np.where(low[at] < 0, shift, low[at])
        at = np.flatnonzero(ok & cut)
        if len(at):
            string = [hash_of(order[i][1][8 : 8 + length - shift]) for i in at]
            rows.append((h[at], e[at], times[at], np.full(len(at), shift), mixed(np.array(string, np.uint64) * R) ^ hashes[shift, at]))
    ok = low >= 0
    more = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else []
    return [h[ok], e[ok], low[ok], high[ok]], more


def hash_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest())


DECIDED = "h long, e long, low int, high int, times long, shift int, string long"


def decided_rows(local: list[np.ndarray], over: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DECIDED.split(", ")]
    signed = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
    if len(local[0]):
        n = len(local[0])
        yield pa.RecordBatch.from_arrays([*map(signed, local[:2]), *[pa.array(x.astype(np.int32)) for x in local[2:]], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
    if over:
        n = len(over[0])
        yield pa.RecordBatch.from_arrays([signed(over[0]), signed(over[1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(over[2].astype(np.int64)), pa.array(over[3].astype(np.int32)), signed(over[4])], names=names)


def wide_cuts(texts: DataFrame, kinds: DataFrame, ranges: int, length: int, per_range: int = 4) -> dict[int, list[bytes]]:
    """Cut points (gram hash and suffix) inside the grams that would fill more than two ranges, from ``ranges * per_range`` contexts: those of
    least hash. They steer balance, never results."""
    sample = written(kinds.orderBy(F.xxhash64("h", "e")).limit(ranges * per_range), "sample")
    wide = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * per_range).select("h")
    spots = sample.join(wide, "h", "left_semi").select("key", "h", "at")
    bitmap = texts.sparkSession.sparkContext.broadcast(flags(spots, "key"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(flagged(bitmap.value, b.column(0).to_numpy())))

    some = texts.mapInArrow(keep, "key long, text binary").join(spots, "key")
    strings: dict[int, set[bytes]] = {}
    for h, suffix in some.select("h", F.expr(f"substring(text, at + 1, {length})").alias("s")).collect():
        h &= (1 << 64) - 1
        strings.setdefault(h, set()).add(h.to_bytes(8) + bytes(suffix))
    discard(sample)
    return {h: sorted(found)[per_range - 1 :: per_range] for h, found in strings.items()}


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 200, per_range: int = 20_000) -> DataFrame:
    """(key, spans): stretches (start, end) of each document that repeat; they overlap, and their union is what repeats. A written table."""
    spark = docs.sparkSession
    before = length - gram
    rows = keyed(docs)
    listing = written(listed(rows, length, gram), "anchors")
    grams = written(listing.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "grams")
    found = written(listing.join(grams, "h"), "repeated_anchors")
    discard(listing, grams)
    kinds = found.groupBy("h", "e").agg(F.count("*").alias("times"), F.min(F.struct("key", "at")).alias("spot"))
    kinds = written(kinds.select("h", "e", "times", "spot.key", "spot.at"), "contexts")
    wanted = written(kinds.groupBy("key").agg(F.collect_list(F.struct("h", "e", "times", "at")).alias("spots")), "wanted")
    ranges = max(parts(spark), kinds.count() // per_range + 1)
    bitmap = spark.sparkContext.broadcast(flags(wanted, "key"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(flagged(bitmap.value, b.column(0).to_numpy())))

    cuts = wide_cuts(rows.select("key", "text"), kinds, ranges, length)
    first, bounds = {}, {}  # of a wide gram its first range; of such a range its cuts
    last = ranges
    for h, points in sorted(cuts.items()):
        first[h] = last
        for i in range(len(points) + 1):
            bounds[last + i] = points[i - 1] if i else None, points[i] if i < len(points) else None
        last += len(points) + 1
    dealt = spark.sparkContext.broadcast((first, cuts, bounds))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0
        first, cuts, _ = dealt.value

        def flush() -> pa.RecordBatch:
            r = list(held)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([coded(sorted(held[k])) for k in r], pa.binary())], names=["range", "run"])

        for b in batches:
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                for s in b.column(2)[i].as_py():
                    at, h = s["at"], s["h"] & (1 << 64) - 1
                    string = h.to_bytes(8) + text[at : at + length]
                    payload = (s["e"] & (1 << 64) - 1).to_bytes(8) + s["times"].to_bytes(8) + text[max(0, at - before) : at]
                    held.setdefault(first[h] + bisect_right(cuts[h], string) if h in first else h * ranges >> 64, []).append((string, payload))
                    size += len(payload) + len(string)
                if size > RUN:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[bytes] = []
        now = None
        for b in batches:
            for which, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if which != now and runs:
                    yield from merged(now, runs)
                    runs = []
                now = which
                runs.append(run)
        if runs:
            yield from merged(now, runs)

    def merged(which: int, runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cut = dealt.value[2].get(which, (None, None))
        order: list[tuple[int, bytes, bytes]] = []
        # Whole grams are gathered until there are enough contexts for one step.
        for entry in merge_prefixed([decoded(r) for r in runs]):
            if entry[0] < 8 and len(order) >= 1024:
                yield from decided_rows(*decide(order, length, gram, *cut))
                order = []
            order.append(entry)
        if order:
            yield from decided_rows(*decide(order, length, gram, *cut))

    texts = rows.select("key", "text").mapInArrow(keep, "key long, text binary").dropDuplicates(["key"])
    runs = written(texts.join(wanted, "key").select("key", "text", "spots").mapInArrow(fetch, "range int, run binary"), "runs", "zstd")
    decided = written(runs.repartition(max(parts(spark), last // 4), "range").sortWithinPartitions("range").mapInArrow(combine, DECIDED), "decided")
    over = decided.where("shift is not null").select("h", "e", "times", "shift", "string")
    again = written(over.groupBy("h", "shift", "string").agg(F.sum("times").alias("n")).where("n > 1").drop("n"), "over_cuts")
    broad = over.join(again, ["h", "shift", "string"]).select("h", "e", F.col("shift").alias("low"), F.col("shift").alias("high"))
    both = decided.where("shift is null").select("h", "e", "low", "high").union(broad).groupBy("h", "e").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    both = written(both, "bounds")
    spans = found.join(both, ["h", "e"]).select("key", F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")).alias("span"))
    out = written(spans.groupBy("key").agg(F.collect_set("span").alias("spans")), "spans")
    discard(found, kinds, wanted, runs, decided, again, both)
    return out


def united(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 200, per_range: int = 20_000, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats[, kept]) of every row; ``repeats``: whether anything goes."""
    spark = docs.sparkSession
    spans = repeated_spans(docs, length, gram, per_range).withColumnRenamed("key", "of")
    shared = spark.sparkContext.broadcast(flags(spans, "of"))

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that lose nothing are finished here; only the others' bytes go on."""
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            texts = b.column(2).to_pylist()
            go = flagged(shared.value, b.column(0).to_numpy())
            done = [None if g else hashlib.sha256(t).hexdigest() for g, t in zip(go, texts, strict=True)]
            on = [t if g or with_kept else None for g, t in zip(go, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(done, pa.string()), pa.array(on, pa.binary())], names=["key", "doc_id", "n_bytes", "sha", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            out = []
            for doc_id, n, sha, text, found in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                runs = united([(s["start"], s["end"]) for s in found or ()], n)
                edges = [0, *(x for r in runs for x in r), n]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if text is not None else None
                out.append((doc_id, n, sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept).hexdigest() if sha is None else sha, bool(runs), kept))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "kept"]
            m = 7 if with_kept else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:m], kinds[:m], strict=True)], names=names[:m])

    prepared = keyed(docs).mapInArrow(light, "key long, doc_id long, n_bytes long, sha string, text binary")
    both = prepared.join(spans, prepared["key"] == spans["of"], "left").select("doc_id", "n_bytes", "sha", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean" + ", kept binary" * with_kept)
