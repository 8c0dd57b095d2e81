"""Connected components of large edge lists, and the order of large linked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import discard, spread_in_order, stored as written


#: So many pairs one task may join at once: what an edit touches is mostly far less, and rounds of jobs would take most of its time.
SMALL = 1 << 18
PIECE = 1 << 20  # pairs that a task joins at a time


def joined_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each is connected with) of all pairs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def joined_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every piece of a task's pairs: what is connected within the piece has one root, which has a row too."""
    held: list[list[np.ndarray]] = []

    def piece() -> pa.RecordBatch:
        got = joined_pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["node", "root"])

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        if sum(len(a) for a, _ in held) >= PIECE:
            yield piece()
    if held:
        yield piece()


def components(edges: DataFrame, label: str = "components", small: int = 0, near: bool = False) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row per node, (node, component), labelled by the least node.

    Alternates two contractions, each a single grouped pass: every node's larger neighbours are hooked to its
    smallest neighbour, then every node's smaller ones are. Edges shrink towards stars, in a logarithmic number of passes. Each
    pass ends in a written table. Nothing is collected but a count and a checksum. Up to ``small`` distinct pairs are joined in one task instead.

    ``near``: neighbours mostly have ids close to one another, as where ids follow places. Then pairs are first sorted by range and joined within each task, and only
    what tasks share is left to be joined, in the same way while that shrinks by half. A long ring takes the passes above dozens of rounds.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if near:
        live = written(pairs, label)
        return near_components(live, live.count(), label, small)
    live = written(pairs.distinct(), label)
    state = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    before = live.select(state).first()
    if before[0]["n"] <= small:
        return at_once(live)
    while True:
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        far = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = far.groupBy("a").agg(F.min("b").alias("m"))
        closer = far.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, live = live, written(closer.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), label)
        discard(last)
        after = live.select(state).first()
        if after == before:
            break
        before = after
    star = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = live.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.union(roots)


def at_once(pairs: DataFrame) -> DataFrame:
    return pairs.coalesce(1).mapInArrow(joined_in_pieces, "node long, root long").withColumnRenamed("root", "component")


def near_components(live: DataFrame, n: int, label: str, small: int) -> DataFrame:
    """``components`` of ``n`` written pairs whose ids are near."""
    if n <= min(small, PIECE):
        return at_once(live)
    hooks = written(spread_in_order(live, "b").mapInArrow(joined_in_pieces, "node long, root long"), label)
    # Roots of one node are connected, and far fewer than the nodes.
    least = written(hooks.groupBy("node").agg(F.min("root").alias("first"), F.max("root").alias("last")), label)
    shared = hooks.join(least.where("first < last").select("node", "first"), "node").where("root <> first")
    shared = written(shared.select(F.col("root").alias("a"), F.col("first").alias("b")).distinct(), label)
    m = shared.count()
    discard(live, hooks)
    rest = near_components(shared, m, label, small) if 2 * m < n else components(shared, label, small)
    return least.join(rest.withColumnRenamed("node", "first"), "first", "left").select("node", F.coalesce("component", "first").alias("component"))


def ranked(items: DataFrame, label: str = "ranks") -> DataFrame:
    """(item, last, steps) of lists given as ``items`` (item, next), next null at an end: the end of an item's list and how far it is.

    Every round each item asks the one that it points to how far that one sees, and sees so far too: pointers double, and a list of n items takes log n
    rounds, each a join ended by a written table.
    """
    end = F.col("next").isNull()
    now = written(items.select("item", F.coalesce("next", "item").alias("last"), F.when(end, 0).otherwise(1).cast("long").alias("steps"), end.alias("done")), label)
    while not now.where("not done").isEmpty():
        there = now.select(F.col("item").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"), F.col("done").alias("arrived"))
        went = now.where("not done").join(there, "last").select("item", F.col("further").alias("last"), (F.col("steps") + F.col("more")).alias("steps"), F.col("arrived").alias("done"))
        before, now = now, written(now.where("done").union(went), label)
        discard(before)
    return now.select("item", "last", "steps")
