"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight and a schedule: knots (time, intensity) joined by
straight lines over training time 0 to 1. Integrating a schedule gives the share of
the source's words asked for up to each time; inverting that integral gives the
time at which a word of the source is due. A source's documents stand in a
fixed pseudo-random order (MD5 of the id), are passed as often as the
target asks, and are range-sorted by due time.

Targets share ``budget`` x all words by weight; no target exceeds ``cap`` x its
source's words, and the excess goes to the others by weight until none is above.

The running word count within a source is a two-level prefix sum (4,096 ranges of the order per
source), so that no task holds a source.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last in
order; equal ids stand in order of their text's digest; with no words at all every target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))


def integrated(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces (t0, width, v0, v1, share before t0), scaled so that the integral over all pieces is 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1 - t0, v0 / area, v1 / area, done))
        done += (t1 - t0) * (v0 + v1) / 2 / area
    return out


def due(share: Column, pieces: Column) -> Column:
    """The time at which the integral reaches ``share``: the inverse of a piecewise quadratic."""
    p = F.element_at(F.filter(pieces, lambda x: x["_5"] <= share), -1)
    rest, slope = share - p["_5"], (p["_4"] - p["_3"]) / p["_2"]
    bent = (F.sqrt(F.greatest(p["_3"] * p["_3"] + 2 * slope * rest, F.lit(0.0))) - p["_3"]) / slope
    return p["_1"] + F.when(slope == 0, rest / p["_3"]).otherwise(bent)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size, target, pieces): water-filling over sources in closed form. One row per source."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("k", F.row_number().over(order) - 1)
    lists = F.array(*[F.array(*[F.struct(*[F.lit(x).alias(f"_{i + 1}") for i, x in enumerate(p)]) for p in integrated(s)]) for s in schedules])
    own = own.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    own = own.withColumn("pieces", F.element_at(lists, (F.col("k") % len(schedules) + 1).cast("int")))
    own = own.withColumn("top", F.col("source_size") * F.lit(cap))
    before = Window.orderBy(F.col("top") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    own = own.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("top"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("top") / F.col("w"), "k", "level"))).over(every)["level"]
    return own.withColumn("target", F.when(F.col("capped"), F.col("top")).otherwise(final * F.col("w"))).select(
        "source", "source_size", "target", "pieces"
    )


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, cap: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """Per input row: doc_id, source, size, source_size, target, taken, text_hash, and due time ``position`` of its first copy (null if none)."""
    sized = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.md5(text_or_empty()).alias("tie"), F.xxhash64(text_or_empty()).alias("text_hash"))
    sized = sized.withColumn("o", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("range", F.substring("o", 1, 3))
    targets = source_targets(sized.select("source", "size"), weights, budget, cap, schedules)
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(up_to), F.lit(0))).drop("range_size")
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    info = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    info = info.select("r.source", "r.range", "ahead", "source_size", "target", "pieces")
    inner = Window.partitionBy("source", "range").orderBy("o", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    both = placed.join(info, same(placed, info, ["source", "range"])).select(
        "doc_id", placed["source"], "size", "text_hash", "source_size", "target", "pieces", (F.col("ahead") + F.col("inside")).alias("before")
    )
    asked = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(0)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), asked - passes * F.col("source_size") - F.col("before")))
    both = both.withColumn("taken", (passes * F.col("size") + extra).cast("long"))
    share = F.least(F.lit(1.0), (F.col("before") + F.least("size", "taken") / 2) / F.col("target"))
    return both.withColumn("position", F.when(F.col("taken") > 0, F.round(due(share, F.col("pieces")), 9)))


def in_order(df: DataFrame) -> DataFrame:
    """Range-sort by due time; ties by id."""
    return df.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, with_position: bool = False, **options) -> DataFrame:
    """The documents of the mix, in curriculum order, whole copies only: a document is repeated ``taken / size``
    times, rounded, and every copy stands at its own due time. Documents without words have nothing to take and go. The columns are those of ``docs``,
    whatever their names, and ``with_position`` the due time, as ``mix_position`` (with an underscore if ``docs`` has that name)."""
    plan = curriculum(docs, **options).where("taken > 0")
    plan = plan.withColumn("copy", F.explode(F.expr("sequence(1, greatest(1, cast(round(taken / size) as int)))"))).where(F.col("copy") <= F.round(F.col("taken") / F.col("size")))
    earlier = F.col("copy") - 1
    part = F.least(F.col("size"), F.col("taken") - earlier * F.col("size"))
    share = F.least(F.lit(1.0), (earlier * F.col("source_size") + F.col("before") + part / 2) / F.col("target"))
    plan = plan.select(F.col("doc_id").alias("mix_id"), F.col("text_hash").alias("mix_text"), F.col("copy").alias("mix_copy"), F.round(due(share, F.col("pieces")), 9).alias("mix_position"))
    plan = plan.groupBy("mix_id", "mix_text", "mix_copy").agg(F.min("mix_position").alias("mix_position"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("of"), F.xxhash64(text_or_empty()).alias("text_hash"))
    # Rows that repeat an id with another text have plans of their own.
    out = rows.join(plan, rows["of"].eqNullSafe(plan["mix_id"]) & (rows["text_hash"] == plan["mix_text"])).orderBy("mix_position", "mix_id", "mix_copy")
    position = [F.col("mix_position").alias("mix_position" + "_" * ("mix_position" in docs.columns))] * with_position
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *position)
