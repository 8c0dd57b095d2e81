"""A Merkle manifest of a dataset: a tree for each source, one tree over their roots, and a proof for every row.

A task walks over the rows that it holds. Each digest is an event for its parent: a partial parent gathers its children's digests by index until it has as
many as the tree's size says that it has, then its own digest is an event for the parent above. Parents that a task can't complete
are the frontier; their children are dealt again by ever wider blocks of positions (3^8 times as wide each round), where the same walk goes on. So leaves are
never shuffled for the way up, and a round moves a few rows for each task of the one before.

Proofs go the other way, a block of eight levels at a time: the path of a block's top is a row of its own, and the block's nodes find their
siblings beside them. A block holds at most 3^8 rows of its lowest level, however large a source is.

Defined cases: a null field is ``-`` and not the same as an empty one; a null source is a source of its own, first in order; rows without doc_id come
first in their source and are never tampered with; rows that repeat a doc_id stand by their digests, and equal rows get neighbouring places; an empty table gives
an empty one; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, alone, discard, written

ARITY = 3
DEPTH = 8  # levels of a block
SPAN = ARITY**DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
EVENT = "tree string, n long, level int, idx long, digest string"
ABOVE = 1 << 20  # sorts the path of a block's top before the block's nodes


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Number of nodes at a level of a tree of ``n`` leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(tree, doc_id, digest, tampered): a row's digest, and that after tampering where it differs."""
    text = F.col("text").cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    of = lambda changed: F.sha2(F.concat(*[field(changed if c == "text" else F.col(c)) for c in columns]), 256)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", of(text).alias("digest"), F.when(hit, of(F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"))


def placed(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` with n, level 0 and idx, their place in their tree: range-sorted, and each range's counts are added to those after it."""
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    table = written(rows.orderBy("tree", *order).select("*", F.spark_partition_id().alias("part"), at.alias("at")), label)
    own = table.groupBy("tree", "part").agg(F.count("*").alias("own"), F.min("at").alias("low"))
    tree = Window.partitionBy("tree")  # a row for each range that holds rows of the tree
    before = F.coalesce(F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, so that its size is known and few rows are broadcast rather than all rows shuffled.
    own = written(own.select("tree", "part", F.sum("own").over(tree).alias("n"), (before - F.col("low")).alias("shift")), "shifts")
    out = table.join(own, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).withColumn("level", F.lit(0))
    return out.drop("part", "at", "shift")


def climbed(events: DataFrame) -> DataFrame:
    """(tree, n, level, idx, digest, resolved): completed parents, and the children of those that a task can't complete."""

    def run(batches: Batches) -> Batches:
        partial: dict[tuple, dict[int, str]] = {}
        out: list[tuple] = []
        sizes: dict[str, int] = {}
        for b in batches:
            for tree, n, level, idx, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sizes[tree] = n
                while width(n, level) > 1:
                    parent, kids = (tree, level + 1, idx // ARITY), min(ARITY, width(n, level) - idx // ARITY * ARITY)
                    have = partial.setdefault(parent, {})
                    have[idx % ARITY] = d
                    if len(have) < kids:
                        break
                    del partial[parent]
                    d, level, idx = digest(*(have[k] for k in range(kids))), level + 1, idx // ARITY
                    out.append((tree, n, level, idx, d, True))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        for (tree, level, idx), have in partial.items():
            out += [(tree, sizes[tree], level - 1, idx * ARITY + k, d, False) for k, d in have.items()]
        yield batch(out)

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tree", "n", "level", "idx", "digest", "resolved"])

    return events.select("tree", "n", "level", "idx", "digest").mapInArrow(alone(run), EVENT + ", resolved boolean")


def nodes(leaf: DataFrame) -> DataFrame:
    """All nodes above the leaves (tree, n, level, idx, digest)."""
    done, events, reach = [], leaf, 0
    while True:
        got = written(climbed(events), "merkle")
        done.append(got)
        frontier = got.where("not resolved")
        if frontier.isEmpty():
            break
        reach += DEPTH
        # Blocks of SPAN leaves, then of SPAN times as many: siblings below the block's top meet in it.
        low = F.col("idx").cast("decimal(38,0)") * F.pow(F.lit(float(ARITY)), "level").cast("decimal(19,0)")
        block = F.floor(low / F.lit(ARITY**reach).cast("decimal(38,0)")).cast("string")
        events = frontier.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "idx")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.where("resolved").drop("resolved")


def roots(leaf: DataFrame, inner: DataFrame) -> DataFrame:
    """(tree, n, digest) of every tree; a lone leaf is its own root."""
    top = inner.where(F.col("n") <= F.pow(F.lit(float(ARITY)), "level"))
    return top.select("tree", "n", "digest").union(leaf.where("n = 1").select("tree", "n", "digest"))


def paths(leaf: DataFrame, inner: DataFrame, tops: DataFrame, fold: bool) -> DataFrame:
    """Each leaf with the way from it to the root. ``tops`` is (tree, n, path, top, root): the way from a tree's root on, that root, and the last one.

    A way is ``left|right`` of the siblings for each level, joined by ``;``. With ``fold`` the result is (doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified), else (name, path, root), where ``name`` is the leaf's column ``tampered``.
    """
    most = leaf.agg(F.max("n")).first()[0] or 1
    levels = F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(39)]), lambda x: x < F.col("n")))
    heads, carried = tops.withColumn("round", F.floor(levels / DEPTH).cast("int")), None
    none = {"doc_id": F.lit(None).cast("long"), "tampered": F.lit(None).cast("string")}
    columns = ["tree", "block", "n", "level", "idx", "digest", "doc_id", "tampered", "path", "root"]
    for r in reversed(range(height(most) // DEPTH + 1)):
        own = heads.where(F.col("round") == r).select("tree", F.lit(0).cast("long").alias("block"), "path", "top", "root")
        own = own if carried is None else own.union(carried)
        own = own.select("tree", "block", F.lit(0).cast("long").alias("n"), F.lit(ABOVE).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("top").alias("digest"), *[v.alias(k) for k, v in none.items()], "path", "root")
        here = inner.where(f"level >= {max(1, r * DEPTH)} and level < {(r + 1) * DEPTH}").select("*", *[v.alias(k) for k, v in none.items()])
        if r == 0:
            here = here.unionByName(leaf.select(*here.columns))
        block = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), F.lit((r + 1) * DEPTH) - F.col("level"))).cast("long")
        here = here.withColumn("block", block).withColumn("path", F.lit(None).cast("string")).withColumn("root", F.lit(None).cast("string"))
        rows = own.select(*columns).union(here.select(*columns)).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "idx")
        out = rows.mapInArrow(alone(descent(r, fold)), SCHEMA[r > 0, fold])
        carried = out if r else None
    return out


# By (not the leaves' round, fold).
CARRY = "tree string, block long, path string, top string, root string"
SCHEMA = {
    (True, True): CARRY, (True, False): CARRY, (False, False): "name string, path string, root string",
    (False, True): "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


def descent(r: int, fold: bool):
    """A task over blocks of round ``r``: a row with the path of the block's top, then the block's nodes from the top down."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA[r > 0, fold].split(", "))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def result(node: tuple, way: str, top: str, root: str) -> tuple:
        tree, _, _, _, idx, own, doc_id, tampered, _, _ = node
        if r:
            return tree, idx, way, top, root
        if not fold:
            return tampered, way, root
        now = own if tampered is None else tampered
        for step in way.split(";") if way else ():
            left, _, right = step.partition("|")
            now = digest(left, now, right)
        return doc_id, own, top, root, digest(way.replace("|", "").replace(";", "")), now, now == root

    def run(batches: Batches) -> Batches:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for _, block in groupby(rows, lambda row: row[:2]):
            head = next(block)
            path, top, root = head[8], head[5], head[9]
            above: dict[int, str] = {}
            for level, level_nodes in groupby(block, lambda row: row[3]):
                here: dict[int, str] = {}
                for parent, run_nodes in groupby(level_nodes, lambda row: row[4] // ARITY):
                    kids = list(run_nodes)
                    up = above.get(parent, path)
                    for k, node in enumerate(kids):
                        if width(node[2], level) == 1:
                            way = path
                        else:
                            step = "".join(x[5] for x in kids[:k]) + "|" + "".join(x[5] for x in kids[k + 1 :])
                            way = step + ";" + up if up else step
                        if level == r * DEPTH:
                            out.append(result(node, way, top, root))
                        else:
                            here[node[4]] = way
                above = here
            if len(out) > 5_000:
                yield table(out)
                out = []
        yield table(out)

    return run


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    read = written(leaves(docs), "leaves")
    leaf = written(placed(read, [F.asc_nulls_first("doc_id"), F.col("digest")], "sorted_leaves"), "placed_leaves")
    discard(read)
    inner = nodes(leaf)
    top = written(roots(leaf, inner), "subroots")
    first = placed(top.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), "digest", F.col("tree").alias("tampered")), [F.col("tampered")], "sources")
    second = nodes(first)
    root = roots(first, second)
    ways = paths(first, second, root.select("tree", "n", F.lit("").alias("path"), F.col("digest").alias("top"), F.col("digest").alias("root")), fold=False)
    tops = top.join(ways.withColumnRenamed("name", "tree"), "tree")
    tops = written(tops.select("tree", "n", "path", F.col("digest").alias("top"), "root"), "tops")
    return paths(leaf, inner, tops, fold=True)
