"""From lines to a planar graph: nodes, edges and primitive faces, as set-wise joins over a grid of the tolerance's size.

Coordinates become whole grid numbers, so that equality and orientation are exact. Lines that cannot be read are set aside with their
error and never stop the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TopoConfig
from ..kernel import bulk, planar, wkb
from ..store import stored as written
from .components import SMALL, components, ranked

ROUNDS = 100  # more is an error
FEW = 1024  # points that look through their whole columns at once: more rounds would take longer
LARGE_FACE = 100_000  # sides that one task walks around; faces with more are traced by ranking lists
SEGMENT = ["line_id", "x1", "y1", "x2", "y2"]


def big(c: Column) -> Column:
    """For products of grid numbers, which can pass 64 bits: a metre is 100,000 of them at the default tolerance."""
    return c.cast("decimal(19,0)")


def segments(lines: DataFrame, cfg: TopoConfig) -> DataFrame:
    """(line_id, x1, y1, x2, y2, error) in grid numbers; an unreadable line is one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    geometry, _ = wkb.decode(data)
                    if "LINESTRING" not in geometry[0]:
                        raise ValueError(f"a line is expected, not {geometry[0]}")
                    for a in geometry[1]:
                        if not np.isfinite(a).all():
                            raise ValueError("coordinates are not finite")
                        g = np.rint(a / cfg.tolerance).astype(np.int64)
                        rows += [(i, *map(int, (*p, *q)), None) for p, q in zip(g, g[1:], strict=False) if (p != q).any()]
                except (ValueError, TypeError) as e:
                    rows.append((i, None, None, None, None, str(e)[:200]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*SEGMENT, "error"])

    return lines.select(F.col("id").cast("long"), "geometry").mapInArrow(run, "line_id long, x1 long, y1 long, x2 long, y2 long, error string")


ENDS = ["x1", "y1", "x2", "y2"]


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """The cells that each piece crosses: of every column of cells only those at the piece's height there, so a long oblique piece has as
    many rows as it crosses cells. ``x1`` is never greater than ``x2``."""
    low = lambda a, b: F.floor(F.least(a, b) / cell)
    high = lambda a, b: F.floor(F.greatest(a, b) / cell)
    rows = rows.withColumn("cx", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2"))))
    slope = (F.col("y2") - F.col("y1")).cast("double") / (F.col("x2") - F.col("x1"))
    at = lambda x: F.col("y1") + slope * (F.least(F.greatest(x, F.col("x1")), F.col("x2")) - F.col("x1"))
    left, right = at(F.col("cx") * cell), at((F.col("cx") + 1) * cell)
    # A grid step to spare covers what the doubles round, and moved points.
    near = lambda v, by: F.floor((v + by) / cell)
    flat = F.col("x1") == F.col("x2")
    first = F.when(flat, low("y1", "y2")).otherwise(F.greatest(low("y1", "y2"), near(F.least(left, right), -1)))
    last = F.when(flat, high("y1", "y2")).otherwise(F.least(high("y1", "y2"), near(F.greatest(left, right), 1)))
    return rows.withColumn("cy", F.explode(F.sequence(first, last)))


def crossings(pieces: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2, px, py): the grid points inside each distinct piece where others meet it.

    Of two pieces one at least is ``fresh``; without that column all are. Each pair is tested once in a cell, and gives the points of both.
    """
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    size, longest = pieces.agg(F.avg(extent), F.max(extent)).first()
    cell = max(1, int(2 * (size or 1)))
    # Pieces that meet lie within twice the longest one: their products fit 64 bits up to this length.
    exact = (lambda c: c.cast("decimal(19,0)")) if (longest or 0) > 1_000_000_000 else (lambda c: c)
    fresh = F.max("fresh") if "fresh" in pieces.columns else F.lit(True)
    own = _cells(pieces.groupBy(*ENDS).agg(fresh.alias("fresh")), cell)
    other = own.select("cx", "cy", F.col("fresh").alias("o_fresh"), *[F.col(c).alias(f"o_{c}") for c in ENDS])
    mine, theirs = F.struct(*ENDS), F.struct(*[F.col(f"o_{c}").alias(c) for c in ENDS])
    met = own.where("fresh").drop("fresh").join(other, ["cx", "cy"]).where(F.when(F.col("o_fresh"), mine < theirs).otherwise(F.lit(True)))
    # Boxes first: most pairs of a cell are apart.
    apart = (F.col("o_x1") > F.col("x2")) | (F.col("x1") > F.col("o_x2")) | (F.greatest("o_y1", "o_y2") < F.least("y1", "y2")) | (F.greatest("y1", "y2") < F.least("o_y1", "o_y2"))
    x1, y1, x2, y2, u1, v1, u2, v2 = (exact(F.col(c)) for c in [*ENDS, *[f"o_{c}" for c in ENDS]])
    dx, dy, ex, ey = x2 - x1, y2 - y1, u2 - u1, v2 - v1
    den = dx * ey - dy * ex
    # Most of the rest meet at an end of both, and nowhere else: one begins where the other ends, or they part from one end in two directions.
    at = lambda a, b: (F.col(f"x{a}") == F.col(f"o_x{b}")) & (F.col(f"y{a}") == F.col(f"o_y{b}"))
    met = met.where(~apart & ~(at(1, 2) | at(2, 1) | ((at(1, 1) | at(2, 2)) & (den != 0))))
    t, s = (u1 - x1) * ey - (v1 - y1) * ex, (u1 - x1) * dy - (v1 - y1) * dx
    sign = F.signum(den.cast("double"))
    crossed = (den != 0) & (t * sign >= 0) & (t * sign <= F.abs(den)) & (s * sign >= 0) & (s * sign <= F.abs(den))
    point = lambda a, b: F.struct(a.cast("long").alias("px"), b.cast("long").alias("py"))
    share = t.cast("double") / den.cast("double")
    both = point(F.round(x1 + dx * share), F.round(y1 + dy * share))

    def ends_on(a: list[Column], b: list[Column]) -> list[Column]:
        """Ends of b inside a, for pieces along one line; those that cross have their point already."""
        a1, b1, a2, b2 = a
        on = lambda px, py: ((px - a1) * (b2 - b1) == (py - b1) * (a2 - a1)) & px.between(a1, a2) & py.between(F.least(b1, b2), F.greatest(b1, b2))
        return [F.when((den == 0) & on(b[i], b[i + 1]), point(b[i], b[i + 1])) for i in (0, 2)]

    one, two = [x1, y1, x2, y2], [u1, v1, u2, v2]
    met = met.select(mine.alias("one"), theirs.alias("two"), F.when(crossed, both).alias("p"), F.array_compact(F.array(*ends_on(one, two))).alias("in_one"), F.array_compact(F.array(*ends_on(two, one))).alias("in_two"))
    none = F.array().cast("array<struct<px: bigint, py: bigint>>")
    crossing = F.when(F.col("p").isNotNull(), F.array("p")).otherwise(none)
    hit = lambda piece, points: F.transform(F.concat(crossing, F.col(points)), lambda p: F.struct(F.col(piece).alias("of"), p.alias("p")))
    found = met.where(F.col("p").isNotNull() | (F.size("in_one") > 0) | (F.size("in_two") > 0)).select(F.explode(F.concat(hit("one", "in_one"), hit("two", "in_two"))).alias("h"))
    inner = (F.struct("h.p.px", "h.p.py") != F.struct("h.of.x1", "h.of.y1")) & (F.struct("h.p.px", "h.p.py") != F.struct("h.of.x2", "h.of.y2"))
    return found.where(inner).select("h.of.*", "h.p.*").distinct()


def split(pieces: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct (line_id, x1, y1, x2, y2, fresh) after cutting at the points. What a point off its piece bends is ``fresh``: it may meet others anew."""
    at = points.groupBy(*ENDS).agg(F.collect_list(F.struct("px", "py")).alias("points"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = lambda p: (big(p["px"] - F.col("x1")) * dx + big(p["py"] - F.col("y1")) * dy).alias("k")
    off = F.exists("points", lambda p: big(p["px"] - F.col("x1")) * dy != big(p["py"] - F.col("y1")) * dx)
    own = F.array(F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x2").alias("px"), F.col("y2").alias("py")))
    stops = F.array_sort(F.transform(F.concat(own, F.col("points")), lambda p: F.struct(along(p), p["px"].alias("px"), p["py"].alias("py"))))
    cut = at.select(*ENDS, off.alias("bent"), stops.alias("s"))
    rows = pieces.join(cut, ENDS)
    rows = rows.select("line_id", "bent", F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("z"))
    p, q = F.struct("z.a.px", "z.a.py"), F.struct("z.b.px", "z.b.py")
    rows = rows.select("line_id", "bent", F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    rows = rows.select("line_id", F.col("p.px").alias("x1"), F.col("p.py").alias("y1"), F.col("q.px").alias("x2"), F.col("q.py").alias("y2"), F.col("bent").alias("fresh"))
    whole = pieces.join(at.select(*ENDS), ENDS, "left_anti").select("line_id", *ENDS, F.lit(False).alias("fresh"))
    return rows.union(whole).groupBy("line_id", *ENDS).agg(F.max("fresh").alias("fresh"))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Dense ids in sorted order: range-sorted, and each partition's count is added to those after it."""
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), local.alias("_at")), name)
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one row per partition
    offset, done = F.lit(0), start
    offsets = []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(done)]
        done += counts[part]
    offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(start)
    return placed.withColumn(name, (offset + F.col("_at")).cast("long")).drop("_part", "_at")


def noded(lines: DataFrame, cfg: TopoConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, line_edge, errors). Cutting repeats until it cuts nothing more, since a point that moved to the grid may bend a piece."""
    read = written(segments(lines, cfg), "segments")
    errors = read.where("error is not null").select("line_id", "error")
    forward = F.struct("x1", "y1") <= F.struct("x2", "y2")
    flip = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    now = read.where("error is null").select("line_id", flip("x1", "x2").alias("x1"), flip("y1", "y2").alias("y1"), flip("x2", "x1").alias("x2"), flip("y2", "y1").alias("y2")).distinct()
    return *cut_pieces(now), errors


def on_supports(rows: DataFrame) -> DataFrame:
    """Adds to pieces, lesser end first, the line that each runs along, ``support``, with the steps ``k1`` and ``k2`` of its ends between that line's grid points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x1, y1, x2, y2 = (b.column(b.schema.names.index(c)).to_numpy() for c in ENDS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.gcd(x2 - x1, y2 - y1), pa.int64())], names=[*b.schema.names, "g"])

    rows = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", g long")
    rows = rows.withColumn("dx", F.expr("(x2 - x1) div g")).withColumn("dy", F.expr("(y2 - y1) div g"))
    rows = rows.withColumn("k1", F.when(F.col("dx") == 0, F.col("y1")).otherwise(F.expr("(x1 - pmod(x1, dx)) div dx")))
    base = F.when(F.col("dx") == 0, F.col("x1")).otherwise(F.expr("pmod(x1, dx)"))
    offset = F.when(F.col("dx") == 0, F.lit(0)).otherwise(F.col("y1") - big(F.col("k1")) * F.col("dy")).cast("decimal(38,0)")
    return rows.select(*[c for c in rows.columns if c not in ("g", "dx", "dy")], F.struct("dx", "dy", base.alias("x"), offset.alias("y")).alias("support"), (F.col("k1") + F.col("g")).alias("k2"))


def flattened(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts (part, x1, y1, x2, y2), line_part (line_id, part)) of distinct (line_id, x1, y1, x2, y2): along each supporting line the stretches between neighbouring ends.

    Pieces along one line that lie over one another become the same parts, so what meets a place is tested there once and not for each of them. The covered
    stretches follow from running counts of what begins and ends, not from pairs of pieces; ``line_part`` is as large as the result that it gives.
    """
    own = on_supports(pieces)
    # Pieces of one line that overlap are one stretch of it, so that each part has each line once.
    along = Window.partitionBy("line_id", "support").orderBy("k1", "k2")
    begins = F.col("k1") > F.max("k2").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = own.select("line_id", "support", "k1", "k2", F.coalesce(begins, F.lit(True)).cast("int").alias("begins")).withColumn("run", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("line_id", "support", "run").agg(F.min("k1").alias("k1"), F.max("k2").alias("k2")).drop("run")
    ends = own.select("support", F.explode(F.array(F.struct(F.col("k1").alias("k"), F.lit(1).alias("n")), F.struct(F.col("k2").alias("k"), F.lit(-1).alias("n")))).alias("e"))
    ends = ends.groupBy("support", F.col("e.k").alias("k1")).agg(F.sum("e.n").alias("n"))
    order = Window.partitionBy("support").orderBy("k1")
    parts = ends.select("support", "k1", F.lead("k1").over(order).alias("k2"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("over")).where("over > 0")
    parts = written(parts.select("support", "k1", "k2", F.monotonically_increasing_id().alias("part")), "parts")
    # In two steps, so that no product passes 64 bits where its sum does not.
    place = lambda k, d, c, v: F.when(F.col("support.dx") == 0, F.col(k) if v else F.col("support.x")).otherwise((big(F.col(k)) * F.col(f"support.{d}") + F.col(f"support.{c}")).cast("long"))
    shapes = parts.select("part", *[place(k, d, c, v).alias(n) for n, k, d, c, v in (("x1", "k1", "dx", "x", 0), ("y1", "k1", "dy", "y", 1), ("x2", "k2", "dx", "x", 0), ("y2", "k2", "dy", "y", 1))])
    # Stretches and parts meet in cells along their line; a part stands in the cell in which it begins.
    size = max(1, int(runs.agg(F.avg(F.col("k2") - F.col("k1"))).first()[0] or 1))
    cell = lambda k: F.floor(F.col(k) / size)
    asked = runs.select("line_id", "support", F.col("k1").alias("low"), F.col("k2").alias("high"), F.explode(F.sequence(cell("k1"), F.floor((F.col("k2") - 1) / size))).alias("cell"))
    met = asked.join(parts.withColumn("cell", cell("k1")).hint("merge"), ["support", "cell"]).where("low <= k1 and k1 < high")
    return shapes, met.select("line_id", "part")


def cut_pieces(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, line_edge) of (line_id, x1, y1, x2, y2) in grid numbers, each with its lesser end first.

    Pieces are first flattened to parts, and these are cut; line_edge goes from lines by their parts to edges, and costs nothing where it is not read. Only
    pieces that a cut has bent are tested again, against all others.
    """
    now = written(now.select("line_id", *[F.col(c).cast("long").alias(c) for c in ENDS]).distinct(), "lines")
    shapes, line_part = flattened(now)
    now, bent = written(shapes.withColumnRenamed("part", "line_id"), "flat").withColumn("fresh", F.lit(True)), False
    for _ in range(ROUNDS):
        points = written(crossings(now), "crossings")
        if points.isEmpty():
            break
        now = written(split(now, points), "pieces")
        if now.where("fresh").isEmpty():
            break  # every point lies on its piece: the parts meet nothing that the whole did not
        bent = True
    else:
        raise RuntimeError(f"lines still cross inside pieces after {ROUNDS} rounds of cutting")
    now = now.drop("fresh")
    edges = numbered(now.select("x1", "y1", "x2", "y2").distinct(), ["x1", "y1", "x2", "y2"], "edge_id")
    nodes = numbered(edges.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("n")).select("n.*").distinct(), ["x", "y"], "node_id")
    a, b = (nodes.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("node_id").alias(n)) for k, n in ((1, "start_node"), (2, "end_node")))
    edges = written(edges.join(a, ["x1", "y1"]).join(b, ["x2", "y2"]), "edges")
    part_edge = written(now.join(edges.select("edge_id", *ENDS), ENDS).select(F.col("line_id").alias("part"), "edge_id"), "part_edges")
    line_edge = line_part.join(part_edge, "part").select("line_id", "edge_id")
    return edges, line_edge.distinct() if bent else line_edge  # bent parts may have come to lie on one edge


def half_edges(edges: DataFrame) -> DataFrame:
    """(he, ring, x, y, tx, ty): both directions of every edge and the ring on its left, named by its least half-edge."""
    two = F.array(
        F.struct((F.col("edge_id") * 2).alias("he"), F.col("start_node").alias("origin"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("tx"), F.col("y2").alias("ty")),
        F.struct((F.col("edge_id") * 2 + 1).alias("he"), F.col("end_node").alias("origin"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("x1").alias("tx"), F.col("y1").alias("ty")),
    )
    half = written(edges.select(F.explode(two).alias("h")).select("h.*"), "half_edges")
    star = half.groupBy("origin").agg(F.collect_list(F.struct("he", (F.col("tx") - F.col("x")).alias("dx"), (F.col("ty") - F.col("y")).alias("dy"))).alias("star"))
    # Counter-clockwise from the positive x axis: first the half plane, then the sign of the cross product.
    half_plane = lambda v: "CASE WHEN {0}.dy > 0 OR ({0}.dy = 0 AND {0}.dx > 0) THEN 0 ELSE 1 END".format(v)
    cross = "cast(l.dx as decimal(19,0)) * r.dy - cast(l.dy as decimal(19,0)) * r.dx"
    star = star.withColumn("star", F.expr(f"array_sort(star, (l, r) -> CASE WHEN {half_plane('l')} <> {half_plane('r')} THEN {half_plane('l')} - {half_plane('r')} WHEN {cross} > 0 THEN -1 WHEN {cross} < 0 THEN 1 ELSE 0 END)"))
    turn = star.select(F.posexplode("star").alias("i", "s"), "star").select((F.col("s.he").bitwiseXOR(F.lit(1))).alias("a"), F.element_at("star", F.when(F.col("i") == 0, -1).otherwise(F.col("i"))).getField("he").alias("b"))
    ring = components(turn, "rings", SMALL, near=True)
    return half.join(ring, half["he"] == ring["node"], "left").select("he", F.coalesce("component", "he").alias("ring"), "x", "y", "tx", "ty")


def nearest_below(points: DataFrame, half: DataFrame) -> DataFrame:
    """(ring, under): for each of ``points`` (ring, px, py, own) the ring of the nearest half-edge below it, of those that run to the right and belong to another
    part than ``own``; points with none have no row.

    Cells form columns, and windows of heights in them that grow fourfold each round. A point looks through the window that it is in and the one below; an edge that
    it finds there is the nearest, and only points that found none look again, so an island among many meets its neighbours and not its whole column.
    """
    extent = F.greatest(F.abs(F.col("tx") - F.col("x")), F.abs(F.col("ty") - F.col("y")))
    size, least, most = half.agg(F.avg(extent), F.min("y"), F.max("y")).first()
    cell = max(1, int(2 * (size or 1)))
    slope = (F.col("ty") - F.col("y")).cast("double") / (F.col("tx") - F.col("x"))
    at = lambda x: F.col("y") + slope * (F.least(F.greatest(x, F.col("x")), F.col("tx")) - F.col("x"))
    below = half.where("tx > x").withColumn("c", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor(F.col("tx") / cell))))
    left, right = at(F.col("c") * cell), at((F.col("c") + 1) * cell)
    # A grid step to spare covers what the doubles round.
    below = below.select("c", "x", "y", "tx", "ty", "part", F.col("ring").alias("under"), (F.least(left, right) - 1).alias("low"), (F.greatest(left, right) + 1).alias("high"))
    below = written(below, "columns")
    height = F.col("y") + (F.col("ty") - F.col("y")).cast("double") * (F.col("px") - F.col("x")) / (F.col("tx") - F.col("x"))
    lower = big(F.col("px") - F.col("x")) * (F.col("ty") - F.col("y")) < big(F.col("py") - F.col("y")) * (F.col("tx") - F.col("x"))
    waiting, settled, tall, n = points.withColumn("c", F.floor(F.col("px") / cell)), [], cell, points.count()
    whole = max((most or 0) - (least or 0) + 3, cell)
    while True:
        if n <= FEW or tall >= whole:
            tall = whole  # a window and the one below it are all heights: what is not found now is not there
        window = lambda v: F.floor((v - ((least or 0) - 2)) / tall)  # noqa: B023, E731
        dealt = below.withColumn("w", F.explode(F.sequence(window(F.col("low")), window(F.col("high")))))
        ask = waiting.withColumn("w", F.explode(F.array(window(F.col("py")), window(F.col("py")) - 1)))
        met = ask.join(dealt, ["c", "w"]).where((F.col("part") != F.col("own")) & (F.col("x") <= F.col("px")) & (F.col("px") < F.col("tx")) & lower)
        best = met.groupBy("ring").agg(F.max(F.struct(height.alias("h"), slope.alias("s"), F.col("under").alias("under"))).alias("best"), F.first("py").alias("py"))
        found = written(best.where((F.col("best.h") >= (window(F.col("py")) - 1) * tall + ((least or 0) - 2)) | F.lit(tall == whole)).select("ring", F.col("best.under").alias("under")), "below")
        settled.append(found)
        if tall == whole:
            return reduce(DataFrame.union, settled)
        waiting = written(waiting.join(found, "ring", "left_anti"), "not_yet_below")
        n, tall = waiting.count(), tall * 4


def faced(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with left_face, right_face and part, faces (face_id, area in grid units)). Face 0 is the outside; a part is what edges connect."""
    half = written(half_edges(edges), "ring_edges")
    twice = F.sum((big(F.col("x")) * F.col("ty") - big(F.col("tx")) * F.col("y")).cast("decimal(38,0)"))
    rings = written(half.groupBy("ring").agg(twice.alias("twice"), F.min(F.struct("x", "y")).alias("at")), "ring_areas")
    # Where a ring bounds its part of the graph from outside, the nearest edge below its leftmost point tells what is around it.
    parts = components(edges.select(F.col("start_node").alias("a"), F.col("end_node").alias("b")), "graph_parts", SMALL, near=True)
    part_of = written(edges.join(parts, edges["start_node"] == parts["node"]).select((F.col("edge_id") * 2).alias("_e"), F.col("component").alias("part")), "edge_parts")
    half = half.join(part_of, (half["he"] - half["he"] % 2) == part_of["_e"]).drop("_e")
    outer = rings.where("twice <= 0").select("ring", F.col("at.x").alias("px"), F.col("at.y").alias("py"))
    outer = outer.join(half.groupBy("ring").agg(F.min("part").alias("own")), "ring")
    seen = nearest_below(outer, half)
    shells = numbered(rings.where("twice > 0").select("ring", F.col("at.x").alias("x"), F.col("at.y").alias("y"), "twice"), ["x", "y", "twice", "ring"], "face_id")
    # Chains of outer rings end at a shell, or outside: of what such rings connect one alone has no outer ring below it.
    up = written(outer.select("ring").join(seen, "ring", "left"), "around")
    chained = written(up.join(up.select(F.col("ring").alias("under")), "under", "left_semi").select("ring", "under"), "outer_chains")
    chain_of = components(chained.select(F.col("ring").alias("a"), F.col("under").alias("b")), "outer_chains", SMALL, near=True)
    up = up.join(chain_of, up["ring"] == chain_of["node"], "left").select("ring", "under", F.coalesce("component", "ring").alias("chain"))
    up = written(up, "around")
    ends = up.join(chained.select("ring"), "ring", "left_anti").select("chain", "under")
    up = up.select("ring", "chain").join(ends, "chain").select("ring", "under")
    of_shell = shells.select(F.col("ring").alias("under"), "face_id")
    face_of = shells.select("ring", "face_id").union(up.join(of_shell, "under", "left").select("ring", F.coalesce("face_id", F.lit(0)).alias("face_id")))
    face_of = written(face_of, "ring_faces")
    sides = half.select("he", "ring", "part").join(face_of, "ring")
    left, right = sides.where("he % 2 = 0").select(F.floor(F.col("he") / 2).alias("edge_id"), F.col("face_id").alias("left_face"), "part"), sides.where("he % 2 = 1").select(F.floor(F.col("he") / 2).alias("edge_id"), F.col("face_id").alias("right_face"))
    faces = rings.join(face_of, "ring").groupBy("face_id").agg((F.sum("twice").cast("double") / 2).alias("area"))
    outside = faces.sparkSession.createDataFrame([(0, 0.0)], "face_id long, area double")
    return edges.join(left, "edge_id").join(right, "edge_id"), faces.where("face_id <> 0").select(F.col("face_id").cast("long").alias("face_id"), "area").union(outside)


def regions(edges: DataFrame) -> DataFrame:
    """(part, region): parts that lie within one outline share a region, since faces connect them; regions touch nothing of one another."""
    sides = edges.select("part", F.explode(F.array("left_face", "right_face")).alias("face_id")).where("face_id <> 0")
    joined = components(sides.select((F.col("part") * 2).alias("a"), (F.col("face_id") * 2 + 1).alias("b")).distinct(), "regions", SMALL, near=True)
    own = edges.select("part").distinct()
    return own.join(joined, own["part"] * 2 == joined["node"], "left").select("part", (F.coalesce("component", F.col("part") * 2) + 1).alias("region"))


def face_data(edges: DataFrame, cfg: TopoConfig) -> DataFrame:
    """(face_id, geometry, area): every primitive face as a polygon; ``edges`` in coordinates, with their faces."""
    grid = edges
    for c in ("x1", "y1", "x2", "y2"):
        grid = grid.withColumn(c, F.round(F.col(c) / cfg.tolerance).cast("long"))
    own = edges.select(F.explode(F.array("left_face", "right_face")).alias("face_id")).where("face_id <> 0").distinct()
    own = own.select(F.lit(0).alias("map_layer"), "face_id", F.col("face_id").alias("comp"), F.lit(False).alias("is_open"))
    return polygons(grid, own, cfg).select(F.col("comp").alias("face_id"), "geometry", "area")


def polygons(edges: DataFrame, comps: DataFrame, cfg: TopoConfig) -> DataFrame:
    """(map_layer, comp, geometry, area): closed components as MultiPolygon WKB, traced along edges with another component on the other side."""
    closed = comps.where("not is_open").select("map_layer", "face_id", "comp")
    layers = comps.select("map_layer").distinct()
    every = edges.select("edge_id", "left_face", "right_face", "x1", "y1", "x2", "y2").crossJoin(F.broadcast(layers))
    l, r = closed.select("map_layer", F.col("face_id").alias("left_face"), F.col("comp").alias("lc")), closed.select("map_layer", F.col("face_id").alias("right_face"), F.col("comp").alias("rc"))  # noqa: E741
    sided = every.join(l, ["map_layer", "left_face"], "left").join(r, ["map_layer", "right_face"], "left").where(~F.col("lc").eqNullSafe(F.col("rc")))
    one = lambda comp, a, b, c, d: F.struct(F.col(comp).alias("comp"), F.col(a).alias("x"), F.col(b).alias("y"), F.col(c).alias("tx"), F.col(d).alias("ty"))
    around = sided.select("map_layer", F.explode(F.array(one("lc", "x1", "y1", "x2", "y2"), one("rc", "x2", "y2", "x1", "y1"))).alias("h")).select("map_layer", "h.*").where("comp is not null")
    return traced(around, cfg)


def traced(around: DataFrame, cfg: TopoConfig) -> DataFrame:
    """(map_layer, comp, geometry, area) of the sides (map_layer, comp, x, y, tx, ty) around each component, which lies on their left."""
    around = written(around, "sides")
    large = written(around.groupBy("map_layer", "comp").count().where(F.col("count") > LARGE_FACE).drop("count"), "large_faces")
    few = large.isEmpty()
    border = (around if few else around.join(large, ["map_layer", "comp"], "left_anti")).groupBy("map_layer", "comp").agg(F.collect_list(F.struct("x", "y", "tx", "ty")).alias("sides"))

    def shape_of(rings: list[np.ndarray]) -> tuple[bytes, float]:
        """Rings in grid numbers as a MultiPolygon: each hole goes to the least shell that holds it."""
        rings = [r * cfg.tolerance for r in rings]
        areas = bulk.signed_areas(rings)
        shells = sorted(((a, [r]) for r, a in zip(rings, areas, strict=True) if a > 0), key=lambda p: p[0])
        low, high = (np.array([f(p[0], axis=0) for _, p in shells]).reshape(-1, 2) for f in (np.min, np.max))
        inner = [0.0] * len(shells)
        for hole, a in zip(rings, areas, strict=True):
            if a < 0:
                middle = (hole[:1] + hole[1:2]) / 2
                near = np.flatnonzero(((low <= middle) & (high >= middle)).all(axis=1)).tolist()
                home = 0 if len(shells) == 1 else next((k for k in near if planar.locate(middle, shells[k][1][:1])[0] >= 0), None)
                if home is None or not shells:
                    raise ValueError("a hole lies in no shell")
                shells[home][1].append(hole)
                inner[home] += -a
        return wkb.encode(("MULTIPOLYGON", [p for _, p in shells])), sum(a - i for (a, _), i in zip(shells, inner, strict=True))

    def trace(sides: list[dict]) -> tuple[bytes, float]:
        leave: dict[tuple, list] = {}
        for s in sides:
            leave.setdefault((s["x"], s["y"]), []).append((s["tx"], s["ty"]))
        rings = []
        for start in sorted(leave):
            while start in leave:
                ring, at, came = [start], start, None
                while True:
                    options = leave[at]
                    if came is not None and len(options) > 1:
                        # At a node that the border passes twice, turn as far left as the face allows: the next edge clockwise from the one back.
                        back = np.arctan2(came[1] - at[1], came[0] - at[0])
                        options.sort(key=lambda p: (back - np.arctan2(p[1] - at[1], p[0] - at[0])) % (2 * np.pi) or 2 * np.pi)  # noqa: B023
                    nxt = options.pop(0)
                    if not options:
                        del leave[at]
                    came, at = at, nxt
                    ring.append(at)
                    if at == start:
                        break
                rings.append(np.array(ring, np.float64))
        return shape_of(rings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings, knotted = bulk.walked(b.column(2))
            single = [i for i, r in enumerate(rings) if len(r) == 1]
            got = dict(zip(single, bulk.areas_of([rings[i][0] * cfg.tolerance for i in single]), strict=True))
            for i in range(b.num_rows):
                if got.get(i) is None and rings[i]:
                    got[i] = shape_of(rings[i])
            for i in knotted:
                got[i] = trace(b.column(2)[i].as_py())
            got = [got[i] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g for g, _ in got], pa.binary()), pa.array([a for _, a in got], pa.float64())], names=["map_layer", "comp", "geometry", "area"])

    out = border.mapInArrow(run, "map_layer int, comp long, geometry binary, area double")
    if few:
        return out

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for rings in b.column(2).to_pylist():
                points = [np.array([(p["x"], p["y"]) for p in ring["points"]], np.float64) for ring in rings]
                first = [min(range(len(p)), key=lambda i: tuple(p[i])) for p in points]  # noqa: B023
                got.append(shape_of([np.concatenate([p[i:], p[: i + 1]]) for p, i in zip(points, first, strict=True)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g for g, _ in got], pa.binary()), pa.array([a for _, a in got], pa.float64())], names=["map_layer", "comp", "geometry", "area"])

    points = ring_points(around.join(large, ["map_layer", "comp"], "left_semi"))
    rings = points.groupBy("map_layer", "comp", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("points"))
    whole = rings.groupBy("map_layer", "comp").agg(F.collect_list(F.struct("points")).alias("rings"))
    return out.union(whole.mapInArrow(close, "map_layer int, comp long, geometry binary, area double"))


def ring_points(sides: DataFrame) -> DataFrame:
    """(map_layer, comp, ring, seq, x, y): the rings of faces that are too large for one task's walk, in order, from ``sides`` (map_layer, comp, x, y, tx, ty).

    Every side finds the next one at its end, rings are the components of that, and list ranking numbers the sides of each.
    """
    sides = written(sides.withColumn("side", F.monotonically_increasing_id()), "numbered_sides")
    nxt = sides.select("map_layer", "comp", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("side").alias("next"))
    turn = F.atan2(F.col("y") - F.col("ty"), F.col("x") - F.col("tx")) - F.atan2(F.col("uy") - F.col("ty"), F.col("ux") - F.col("tx"))
    turn = F.pmod(turn, F.lit(2 * np.pi))
    # As in a walk: at a node that the border passes twice, the next side clockwise from the one back.
    pair = sides.join(nxt, ["map_layer", "comp", "tx", "ty"]).groupBy("side").agg(F.min_by("next", F.when(turn == 0, 2 * np.pi).otherwise(turn)).alias("next"))
    pair = written(pair, "next_sides")
    ring = written(components(pair.select(F.col("side").alias("a"), F.col("next").alias("b")), "large_rings", SMALL, near=True), "ring_of_side")
    cut = pair.join(ring, pair["side"] == ring["node"]).select(F.col("side").alias("item"), F.when(F.col("next") != F.col("component"), F.col("next")).alias("next"))
    rank = ranked(cut, "side_ranks")
    length = rank.groupBy("last").agg(F.max("steps").alias("most"))
    rank = rank.join(length, "last").select(F.col("item").alias("side"), (F.col("most") - F.col("steps")).alias("seq"), F.col("last").alias("ring"))
    return sides.join(rank, "side").select("map_layer", "comp", "ring", "seq", "x", "y")
