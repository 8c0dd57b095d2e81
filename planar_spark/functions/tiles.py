"""Web-map tile arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Circumference and half circumference of the web-Mercator square, in metres; the deepest zoom.
WORLD = 40075016.6855785
ZOOMS = 24


def tile_index(n: Column, z: Column) -> Column:
    """Tile number along x of a coordinate at a zoom."""
    return F.floor((n / F.lit(WORLD) + 0.5) * F.pow(F.lit(2.0), z)).cast("int")


def tile_row(n: Column, z: Column) -> Column:
    """Tile number along y, counted from the north."""
    return tile_index(-n, z)


def covering_tiles(xmin: Column, ymin: Column, xmax: Column, ymax: Column, z: Column) -> Column:
    """Array of (x, y, z) of all tiles that a box meets, whichever way its corners are given."""
    xs = F.sequence(tile_index(F.least(xmin, xmax), z), tile_index(F.greatest(xmin, xmax), z))
    ys = F.sequence(tile_row(F.greatest(ymin, ymax), z), tile_row(F.least(ymin, ymax), z))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y"), z.cast("int").alias("z")))))


def largest_tile(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """(x, y, z) of the deepest tile that holds a box."""
    zooms = F.sequence(F.lit(0), F.lit(ZOOMS))
    one = lambda z: (tile_index(xmin, z) == tile_index(xmax, z)) & (tile_row(ymin, z) == tile_row(ymax, z))
    z = F.array_max(F.filter(zooms, one))
    return F.struct(tile_index(xmin, z).alias("x"), tile_row(ymax, z).alias("y"), z.alias("z"))


def tile_contains(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column, literal: bool = False) -> Column:
    """Whether tile a holds tile b. ``literal`` counts one row and one column too many as inside."""
    size = F.pow(F.lit(2.0), bz - az)
    over = (lambda v, top: v <= top) if literal else (lambda v, top: v < top)
    inside = (bx >= ax * size) & over(bx, (ax + 1) * size) & (by >= ay * size) & over(by, (ay + 1) * size)
    return (bz >= az) & inside


def tile_box(x: Column, y: Column, z: Column) -> Column:
    """The tile's box in metres."""
    side = F.lit(WORLD) / F.pow(F.lit(2.0), z)
    left, top = x * side - WORLD / 2, F.lit(WORLD / 2) - y * side
    return F.struct(left.alias("xmin"), (top - side).alias("ymin"), (left + side).alias("xmax"), top.alias("ymax"))
