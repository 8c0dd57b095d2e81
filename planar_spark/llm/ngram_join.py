"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (rare before common, then by hash) is cut into fragments.

1. Every text's set is summarised once: size, 128-bit digest, the first n-grams of the global order with their places (a set and any set it
   links with must share one of them, early enough to leave room for the rest), and the parities of its number of n-grams in each of ``BITS`` hash cells. Cells in which the
   parities of two sets differ count towards their symmetric difference: a lower bound that is never wrong.
2. Equal sets become one representative. Representatives that share a leading n-gram are candidates; a pair whose bound
   or sizes exclude a link goes at once.
3. The remaining pairs are counted exactly: each fragment is joined with itself for their partial overlaps, which are then summed per pair.

Groups of near copies never become all pairs. First every member's nearest and least partner in each of its first groups are counted, and links are joined
into components. After that a group whose members are all in one component is settled; of any other, only the members outside its largest component
are compared with the rest, in bounded blocks, and only pairs between different components whose bound allows a link are left to be counted.

N-grams are compared by 64-bit hashes. How common an n-gram is is counted over all texts, batch by batch; it steers the
order, never the result.

Defined cases: null and empty texts, and texts without words, have the empty set and link with nothing; a text with fewer words than
``n`` is one n-gram; rows that repeat a doc_id are one document, which has the links of all of them and the size of the largest; a row
without doc_id is a document of its own, whose component is named by the others' ids (null if none has one); empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, components, discard, flagged, flags, parts, written

BITS = 1024  # cells of the parities that meet in blocks
WIDEST = 1 << 15  # most cells of those that meet pair by pair: four for each n-gram up to that
FRAGMENTS = 8  # of the global order: half of them for the rare n-grams, half for the common ones
COMMON = 8  # times in a batch that make an n-gram common
MOST_COMMON = 1 << 20  # common n-grams that are told apart; others count as rare
BLOCK, WIDE = 2048, 16384  # members outside a group's largest component, and members of all kinds, that meet in one block
EARLY = 8  # groups of each set in which the nearest partners are sought
NO_ID = (1 << 63) - 1  # by which the texts of rows without doc_id are fetched
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
FLAT = 1 << 20  # bytes of texts that are hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 1 << 64)))):
            x = np.full(max(n, 2 * FLAT), base, np.uint64)
            x[0] = 1
            POWERS[name] = np.multiply.accumulate(x)
    up, down = POWERS["up"][:n], POWERS["down"][:n]
    if n > 8 * FLAT:
        POWERS.clear()
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(29))


def sets_of(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; the words of many texts are hashed in one go."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        lengths = np.array([len(x) + 1 for x in held])
        data = LOW[np.frombuffer(b"\n".join([*held, b""]), np.uint8)]
        up, down = powers(len(data) + 1)
        gap = GAP[data]
        before = np.empty(len(data), bool)
        before[0], before[1:] = True, gap[:-1]
        starts, ends = np.nonzero(~gap & before)[0], np.nonzero(gap & ~before)[0]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        total = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            total = mixed(total * MIX[0] + words[i : i + len(total)])
        total = mixed(total + np.uint64(n))
        cut = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(total[a : b - n + 1]))
            elif b > a:
                few = np.zeros(1, np.uint64)
                for i in range(a, b):
                    few = mixed(few * MIX[0] + words[i : i + 1])
                out.append(mixed(few + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        held.clear()

    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > FLAT:
            flush()
            size = 0
    if held:
        flush()
    return out


def digest(g: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(g.tobytes())
    return d >> 64, d & (1 << 64) - 1


def cells(g: np.ndarray) -> np.ndarray:
    """Parities of the number of n-grams in each cell, packed; at least ``BITS`` cells, a power of two."""
    n = min(WIDEST, max(BITS, 1 << (4 * len(g) - 1).bit_length())) if len(g) else BITS
    odd = np.bincount((g & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(packed: np.ndarray, bits: int) -> np.ndarray:
    """The parities over fewer cells, along the last axis."""
    while packed.shape[-1] * 8 > bits:
        half = packed.shape[-1] // 2
        packed = packed[..., :half] ^ packed[..., half:]
    return packed


def apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Lower bounds of symmetric differences: cells of unlike parity, over the fewer cells of the two."""
    out = np.zeros(len(left), np.int64)
    m, n = np.array(list(map(len, left))), np.array(list(map(len, right)))
    for a, b in {*zip(m.tolist(), n.tolist(), strict=True)}:
        at = np.flatnonzero((m == a) & (n == b))
        p, q = (np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1) for side in (left, right))
        least = 8 * min(a, b)
        out[at] = np.bitwise_count((folded(p, least) ^ folded(q, least)).view(np.uint64)).sum(1, dtype=np.int64)
    return out


def is_common(g: np.ndarray, often: np.ndarray) -> np.ndarray:
    if not len(often):
        return np.zeros(len(g), bool)
    return often[np.minimum(np.searchsorted(often, g), len(often) - 1)] == g


def slices(b: pa.RecordBatch, column: int, size: int = 2048) -> Iterator[tuple[int, list]]:
    for k in range(0, b.num_rows, size):
        yield k, b.column(column).slice(k, size).to_pylist()


def common_ngrams(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted n-grams that some batch of texts holds ``COMMON`` times or more, the most frequent ``MOST_COMMON``; with counts' order lost
    to their hash. Their number bounds what is sent to the executors (8 MB)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for _, texts in slices(b, 0):
                for g in sets_of(texts, n):
                    held.append(g)
                    size += len(g)
                    if size > 4_000_000:
                        yield rows(held)
                        held, size = [], 0
            yield rows(held)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        keep = times >= COMMON
        return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], names=["g", "times"])

    counted = docs.select("text").mapInArrow(alone(count), "g long, times long").groupBy("g").agg(F.sum("times").alias("times"))
    got = counted.orderBy(F.col("times").desc(), "g").limit(MOST_COMMON).select("g").toArrow().column("g").to_numpy()
    return np.sort(got.view(np.uint64))


def keyed(rows: DataFrame) -> DataFrame:
    """A row's ``key``: its doc_id and its set. Rows that repeat a doc_id with another text have another key."""
    return rows.withColumn("key", F.xxhash64("doc_id", "h1", "h2"))


def summaries(docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """(doc_id, size, h1, h2, lead, parity, wide) of each row; ``shared``: the common n-grams, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            for k, texts in slices(b, 1):
                sizes, digests, leads, parities, wides = [], [], [], [], []
                for g in sets_of(texts, n):
                    sizes.append(len(g))
                    digests.append(digest(g))
                    wide = cells(g)
                    wides.append(wide.tobytes())
                    parities.append(folded(wide, BITS).tobytes())
                    # A partner shares at least percent% of this set: leaving out so many, one shared n-gram must lead.
                    need = len(g) - (percent * len(g) + 99) // 100 + 1 if len(g) else 0
                    late = is_common(g, often)
                    g = np.concatenate([g[~late], g[late]])
                    leads.append(g[:need].view(np.int64))
                ends = np.cumsum([0, *map(len, leads)]).astype(np.int32)
                h = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(k, len(texts)), pa.array(np.array(sizes, np.int64)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(leads) if leads else np.empty(0, np.int64))), pa.array(parities, pa.binary()), pa.array(wides, pa.binary()),
                    ],
                    names=["doc_id", "size", "h1", "h2", "lead", "parity", "wide"],
                )

    return docs.select("doc_id", "text").mapInArrow(alone(run), "doc_id long, size long, h1 long, h2 long, lead array<long>, parity binary, wide binary")


def least_overlap(a, b, percent: int):
    """Least shared number with which sets of sizes a and b link: percent * union <= 100 * shared."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that sizes and parities do not exclude, with their sizes."""
    x = reps.select(F.col("key").alias("a"), F.col("size").alias("size_a"), F.col("wide").alias("wide_a"))
    y = reps.select(F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("wide").alias("wide_b"))
    both = pairs.join(x, "a").join(y, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                s, t = b.column(2).to_numpy(), b.column(3).to_numpy()
                keep = (s + t - apart(b.column(4).to_pylist(), b.column(5).to_pylist())) >= 2 * least_overlap(s, t, percent)
                yield b.select(["a", "b", "size_a", "size_b"]).filter(pa.array(keep))

    return both.select("a", "b", "size_a", "size_b", "wide_a", "wide_b").mapInArrow(alone(run), "a long, b long, size_a long, size_b long")


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """The pairs (a, b) that link: each fragment of the global order is joined with itself along the pairs, and the partial overlaps
    are summed per pair."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    needed = written(keys.join(reps.select("key", "doc_id"), "key"), "needed")
    fetch = F.coalesce("doc_id", F.lit(NO_ID)).alias("fetch")
    bitmap = docs.sparkSession.sparkContext.broadcast(flags(needed.select(fetch), "fetch"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(flagged(bitmap.value, b.column(0).to_numpy())))

    texts = docs.select(fetch, "doc_id", "text").mapInArrow(alone(keep), "fetch long, doc_id long, text string").join(needed.select(fetch).distinct(), "fetch", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = FRAGMENTS // 2
        for b in batches:
            for k, some in slices(b, 1, 512):
                ids, digests, which, sets = [], [], [], []
                for doc_id, g in zip(b.column(0).slice(k, len(some)).to_pylist(), sets_of(some, n), strict=True):
                    own, late = digest(g), is_common(g, shared.value)
                    for part, of in ((g[~late], 0), (g[late], half)):
                        ends = np.append(np.searchsorted(part, np.arange(half, dtype=np.uint64) * np.uint64((1 << 64) // half)), len(part))
                        for f in range(half):
                            if ends[f] < ends[f + 1]:
                                ids.append(doc_id)
                                digests.append(own)
                                which.append(of + f)
                                sets.append(part[ends[f] : ends[f + 1]].view(np.int64))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                h = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(which, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))],
                    names=["doc_id", "h1", "h2", "f", "g"],
                )

    pieces = keyed(texts.select("doc_id", "text").mapInArrow(alone(cut), "doc_id long, h1 long, h2 long, f int, g array<long>")).dropDuplicates(["key", "f"])
    pieces = written(pieces.select("key", "f", "g"), "fragments", "lz4")
    x, y = pieces.select(F.col("key").alias("a"), "f", F.col("g").alias("g_a")), pieces.select(F.col("key").alias("b"), "f", F.col("g").alias("g_b"))
    partial = pairs.join(x, "a").join(y, ["b", "f"]).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("g_a", "g_b")).alias("shared"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    out = written(total.where(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b"), "links")
    discard(needed, pieces)
    return out


MEMBER = ["rep", "size", "place", "component", "outside"]
ROWS = "g long, x int, y int, rep long, size int, place int, component long, outside int"


def by_block(rows: DataFrame, columns: list[str], schema, solve) -> DataFrame:
    """``solve(table)`` for each block of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            g, x, y = (b.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(g) else []
            for a, e in zip(new, np.append(new[1:], len(g)), strict=True):
                if (g[a], x[a], y[a]) != now:
                    if held:
                        yield from solve(pa.Table.from_batches(held))
                    now, held = (g[a], x[a], y[a]), []
                held.append(b.slice(a, e - a))
        if held:
            yield from solve(pa.Table.from_batches(held))

    dealt = rows.select("g", "x", "y", *columns).repartition(parts(rows.sparkSession), "g", "x", "y")
    return dealt.sortWithinPartitions("g", "x", "y").mapInArrow(alone(run), schema)


def meetings(block: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a block of pairs of different components whose sizes and places allow a link, tile by tile."""
    rep, size, place, comp, side = (block.column(k).to_numpy() for k in MEMBER)
    # side: 0 the block's members outside the largest component, as the left ones; 1 and 2 all members, 2 those outside it.
    left, right = np.nonzero(side == 0)[0], np.nonzero(side > 0)[0]
    tile = max(1, (1 << 15) // max(1, len(right)))
    for k in range(0, len(left), tile):
        i = left[k : k + tile]
        s, t = size[i, None], size[None, right]
        keep = (comp[right] != comp[i, None]) & (np.minimum(s, t) * 100 >= percent * np.maximum(s, t))
        keep &= np.minimum(s - place[i, None], t - place[right]) >= least_overlap(s, t, percent)
        keep &= (side[right] == 1) | (rep[right] > rep[i, None])
        at, j = np.nonzero(keep)
        yield i[at], right[j]


def meeting_rows(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that have such a partner in their block; only they need their parities."""

    def solve(block: pa.Table) -> Iterator[pa.RecordBatch]:
        meets = np.zeros(block.num_rows, bool)
        for i, j in meetings(block, percent):
            meets[i] = meets[j] = True
        if meets.any():
            yield from block.filter(pa.array(meets)).to_batches()

    return by_block(rows, MEMBER, ROWS, solve)


def between(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of different components that share a block of a group and whose sizes and parities allow a link; if ``nearest``, for
    every member outside the largest component only its pair of the least bound and that with the least partner."""

    def solve(block: pa.Table) -> Iterator[pa.RecordBatch]:
        rep, size = (block.column(k).to_numpy() for k in ("rep", "size"))
        bits = np.frombuffer(b"".join(block.column("parity").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        for i, j in meetings(block, percent):
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            fits = (size[i] + size[j] - differ) >= 2 * least_overlap(size[i], size[j], percent)
            i, j = i[fits], j[fits]
            if nearest and len(i):
                picked = [np.lexsort((by, i)) for by in (differ[fits], rep[j])]
                first = np.unique([o[np.append(True, i[o][1:] != i[o][:-1])] for o in picked])
                i, j = i[first], j[first]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])

    return by_block(rows, [*MEMBER, "parity"], "a long, b long", solve)


def unsettled(posted: DataFrame, reps: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(g, x, y, rep, size, place, component, outside): blocks of the groups whose members are in several components. Members outside
    a group's largest component meet all its members; the largest component is never compared with itself. Also the groups, written."""
    labelled = posted.select("g", "rep", "size", "place", F.col("rep").alias("component"))
    if known is not None:
        labels = known.select(F.col("node").alias("rep"), F.col("component").alias("label"))
        labelled = labelled.drop("component").join(labels, "rep", "left").select("g", "rep", "size", "place", F.coalesce("label", "rep").alias("component"))
    counts = labelled.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g")
    groups = counts.agg(F.max_by("component", "c").alias("largest"), F.max("c").alias("c"), F.sum("c").alias("m")).where("m > c")
    groups = written(groups, "open_groups")
    rows = labelled.join(groups, "g")
    many = lambda n, size: F.ceil(n / size).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    across, down = many(F.col("m") - F.col("c"), BLOCK), many(F.col("m"), WIDE)
    out = F.col("component") != F.col("largest")
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.cast("int").alias("outside"))
    as_left = F.when(out, F.transform(each(down), lambda y: place(spread(across), y, F.lit(0)))).otherwise(F.array().cast("array<struct<x:int,y:int,outside:int>>"))
    as_right = F.transform(each(across), lambda x: place(x, spread(down), F.lit(1) + out.cast("int")))
    rows = rows.select("g", "rep", "size", "place", "component", F.explode(F.concat(as_left, as_right)).alias("at"))
    return rows.select("g", "at.x", "at.y", "rep", "size", "place", "component", "at.outside"), groups


def representatives(full: DataFrame, first: DataFrame) -> DataFrame:
    """Of rows with equal sets that with the least key. Most sets occur once: their rows, with all their leading n-grams, need not move."""
    others = written(full.select("key", "h1", "h2", "size").join(first, ["h1", "h2", "size"]).where("key <> rep").select("key"), "copies")
    bitmap = full.sparkSession.sparkContext.broadcast(flags(others.union(first.where("copies > 1").select("rep")), "key"))

    def part(loud: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(flagged(bitmap.value, b.column(0).to_numpy()) == loud))

        rows = full.select("key", *[c for c in full.columns if c != "key"])
        return rows.mapInArrow(alone(run), rows.schema)

    chosen = part(True).join(first.select(F.col("rep").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    return part(False).union(chosen)


def leading(chosen: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(place, g, rep, size) of the leading n-grams; with a bitmap of ``wanted`` n-grams, only those that may be among them."""
    bitmap = None if wanted is None else chosen.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                lengths, g = b.column(2).value_lengths().to_numpy(), b.column(2).flatten().to_numpy()
                keep = np.flatnonzero(flagged(bitmap.value, g))
                of, starts = np.repeat(np.arange(len(lengths)), lengths)[keep], np.cumsum(lengths) - lengths
                columns = [(keep - starts[of]).astype(np.int32), g[keep], b.column(0).to_numpy()[of], b.column(1).to_numpy()[of].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "g", "rep", "size"])

    if wanted is None:
        return chosen.select(F.posexplode("lead").alias("place", "g"), F.col("key").alias("rep"), F.col("size").cast("int").alias("size"))
    return chosen.select("key", "size", "lead").mapInArrow(alone(run), "place int, g long, rep long, size int")


def first_groups(posted: DataFrame) -> DataFrame:
    """Of groups with the same members that of the first n-gram in the global order, which has the same members' least places."""
    sums = [F.bit_xor(F.xxhash64("rep")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("t")]
    of = posted.groupBy("g").agg(F.count("*").alias("m"), *sums, F.min(F.struct("rep", "place")).alias("least"))
    return of.groupBy("m", "s", "t", "least.rep").agg(F.min_by("g", "least.place").alias("g")).select("g", "m")


def of_two(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from groups of two whose sizes and places allow a link."""
    member = F.struct("rep", "size", "place")
    both = posted.where("m = 2").groupBy("g").agg(F.min(member).alias("x"), F.max(member).alias("z"))
    need = F.expr(f"({percent} * (x.size + z.size) + 99 + {percent}) div (100 + {percent})")
    fits = F.least(F.col("x.size") - F.col("x.place"), F.col("z.size") - F.col("z.place")) >= need
    return both.where(fits).select(F.col("x.rep").alias("a"), F.col("z.rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links are Jaccard similarities of at least ``percent`` / 100."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(common_ngrams(texts, n))
    every = written(keyed(summaries(texts, n, percent, shared)), "sets")
    full = every.where("size > 0")
    first = written(full.groupBy("h1", "h2", "size").agg(F.min("key").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies")), "representatives")
    chosen = representatives(full, first)
    reps = written(chosen.select("key", "doc_id", "size", "parity", "wide"), "parities")
    groups = written(leading(chosen).groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    meeting = leading(chosen, flags(groups, "g")).join(groups, "g")
    kept = written(first_groups(meeting), "first_groups")
    posted = written(leading(chosen, flags(kept, "g")).join(kept, "g"), "shared_leads")
    discard(groups, kept)
    # First each member of an early group with its nearest only, which joins most; then, between the components, all that is left.
    links = tested = known = None
    for nearest in (True, False):
        larger = posted.where("m > 2")
        if nearest:
            rank = F.row_number().over(Window.partitionBy("rep").orderBy("place"))
            larger = larger.withColumn("rank", rank).where(F.col("rank") <= EARLY)
        rows, open_groups = unsettled(larger, reps, known)
        rows = meeting_rows(rows, percent).join(reps.select(F.col("key").alias("rep"), "parity"), "rep")
        rest = between(rows, percent, nearest)
        rest = rest.union(of_two(posted, percent)).distinct() if nearest else rest.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = written(possible(rest, reps, percent), "pairs")
        discard(open_groups)
        found = linked(tested, reps, texts, n, percent, shared)
        links = found if links is None else links.union(found)
        known = components(links)
    # Rows that repeat a doc_id are one document.
    of_row = full.select("doc_id", "h1", "h2", "size").join(first, ["h1", "h2", "size"])
    again = of_row.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    again = written(again.select("doc_id", "a").join(of_row.select("doc_id", F.col("rep").alias("b")), "doc_id").where("a <> b").select("a", "b"), "same_document")
    if not again.isEmpty():
        known = components(links.union(again))
    named = first.join(known, first["rep"] == known["node"], "left").select("h1", "h2", "size", "low", F.coalesce("component", "rep").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(named.join(lows, "component").select("h1", "h2", "size", "component_id"), "named")
    rows = full.select("doc_id", "h1", "h2", "size").join(named, ["h1", "h2", "size"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    rows = rows.union(every.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    one = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = written(one.union(rows.where("doc_id is null")), "ngram_components")
    discard(every, first, reps, posted, again, named)
    return out


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: of each component that with the least doc_id; rows without doc_id stay. Columns unchanged."""
    found = jaccard_components(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("linked_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["linked_id"], "left_anti")
