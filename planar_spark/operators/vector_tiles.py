"""Vector tiles of features, by zoom: features are dealt to the tiles that their boxes meet, and each tile is encoded once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import WORLD, covering_tiles, tile_box
from ..kernel import generalise, mvt, wkb
from ..store import stored as written
from .dml import upsert
from .units import box_join, boxed


def projected(rows: DataFrame, keys: str, source: int, target: int) -> DataFrame:
    """``keys`` (a schema) and ``geometry`` in another reference system; null where it can't be read. A system that is not known is an error."""
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for data in b.column(len(names)).to_pylist():
                try:
                    geometry, _ = wkb.decode(data)
                except (ValueError, TypeError):
                    out.append(None)
                    continue
                out.append(wkb.encode(generalise.mapped(geometry, lambda a: generalise.project(a, source, target))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=b.schema.names)

    return rows.select(*names, "geometry").mapInArrow(run, keys + ", geometry binary")


CHUNK = 1_000  # encoded features, or tiles, that a task hands on at a time
HELD = 1 << 23  # bytes of tiles from which a task hands them on

KEYS = "layer string, id long, type string"


def build_tiles(features: DataFrame, zooms: Sequence[int], srid: int = 3857, only: DataFrame | None = None) -> DataFrame:
    """(z, x, y, tile) of ``features`` (layer, id, type, geometry): a layer of each name, simplified to half a grid step of its zoom; ``only`` of these tiles (z, x, y).

    Each feature is simplified, clipped and encoded on its own for each zoom, so a tile gathers the encoded bytes of what can be seen in it and no geometry.
    """
    rows = projected(features.select("layer", F.col("id").cast("long").alias("id"), "type", "geometry"), KEYS, srid, 3857)
    rows = boxed(rows, KEYS).where("box is not null").withColumn("zoom", F.explode(F.array(*[F.lit(int(z)) for z in zooms]).cast("array<int>")))
    if only is not None:
        # Features near a wanted tile; a tile's buffer is within a sixteenth of its side.
        side = F.lit(WORLD) / F.pow(F.lit(2.0), F.col("z"))
        corner = tile_box(F.col("x"), F.col("y"), F.col("z"))
        wide = F.struct(*[(corner[k] + sign * side / 16).alias(k) for k, sign in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))])
        rows = box_join(rows, only.select(F.col("z").cast("int").alias("zoom"), wide.alias("b_box")), ["zoom"]).drop("b_box").distinct()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["z", "x", "y", "layer", "id", "type", "kind", "drawn"]
        kinds = [pa.int32()] * 3 + [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        out: list[tuple] = []
        for b in batches:
            for name, i, kind, data, zoom in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                step = WORLD / 2**zoom / mvt.EXTENT / 2
                shape = generalise.mapped(wkb.decode(data)[0], lambda a: generalise.simplify(a, step) if len(a) > 4 else a)  # noqa: B023
                for x, y, form, drawn in mvt.descend(shape, zoom, WORLD):
                    out.append((zoom, x, y, name, i, kind, form, drawn))
                    if len(out) == CHUNK:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    drawn = rows.select("layer", "id", "type", "geometry", "zoom").mapInArrow(encode, "z int, x int, y int, layer string, id long, type string, kind int, drawn binary")
    if only is not None:
        drawn = drawn.join(only.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")
    # Sorted rows and not one list a tile: the world's tile at zoom 0 has every feature.
    placed = drawn.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "layer", "id", "type", "kind", "drawn")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        layers: list[mvt.Layer] = []
        done: list[tuple] = []
        size = 0

        def tile() -> tuple:
            data = b"".join(p for layer in layers for p in layer.parts())
            layers.clear()
            return (*at, data)  # type: ignore[misc]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.int32()] * 3 + [pa.binary()], strict=True)], names=["z", "x", "y", "tile"])
            done.clear()
            return out

        for b in batches:
            for z, x, y, name, i, kind, form, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (z, x, y) != at:
                    if layers:
                        done.append(tile())
                        size += len(done[-1][3])
                    if size > HELD or len(done) == CHUNK:
                        yield batch()
                        size = 0
                    at = (z, x, y)
                if not layers or layers[-1].name != name:
                    layers.append(mvt.Layer(name, "id"))
                layers[-1].add(form, data, {"id": i, "type": kind})
        if layers:
            done.append(tile())
        if done:
            yield batch()

    return placed.mapInArrow(assemble, "z int, x int, y int, tile binary")


def contents(tiles: DataFrame) -> DataFrame:
    """(z, x, y, layer, id, type) of every feature in ``tiles``, read back from their bytes."""

    names, kinds = ["z", "x", "y", "layer", "id", "type"], [pa.int32()] * 3 + [pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tiles = zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True)
            rows = ((*at, name, tags.get("id"), tags.get("type")) for *at, tile in tiles for name, tags in mvt.each_feature(tile.as_buffer() or b""))
            while part := list(islice(rows, CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    return tiles.select("z", "x", "y", "tile").mapInArrow(run, f"z int, x int, y int, {KEYS}")


def cached(cache: DataFrame, tiles: DataFrame) -> DataFrame:
    return upsert(cache, tiles, ["z", "x", "y"])


def met(changed: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """(z, x, y): the tiles that ``changed`` boxes (xmin, ymin, xmax, ymax in metres) meet, by what tiles show beyond their border too."""
    spare = lambda z: WORLD / 2**z * mvt.BUFFER / mvt.EXTENT
    each = [
        covering_tiles(F.col("xmin") - spare(z), F.col("ymin") - spare(z), F.col("xmax") + spare(z), F.col("ymax") + spare(z), F.lit(int(z)))
        for z in zooms
    ]
    hit = changed.select(F.explode(F.array(*each)).alias("ts")).select(F.explode("ts").alias("t")).select("t.z", "t.x", "t.y").distinct()
    top = F.pow(F.lit(2), F.col("z")) - 1
    return hit.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") <= top) & (F.col("y") <= top))


def refreshed(cache: DataFrame, features: DataFrame, changed: DataFrame, zooms: Sequence[int], srid: int = 3857) -> DataFrame:
    """The cache after ``changed`` boxes: tiles that they meet are built again from ``features``, and go where nothing is left in them; the others stay as they are."""
    again = written(met(changed, zooms), "stale_tiles")
    kept = cache.join(again, ["z", "x", "y"], "left_anti").select("z", "x", "y", "tile")
    return kept.union(build_tiles(features, zooms, srid, again).select("z", "x", "y", "tile"))


def tile_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(z, x, y, change): tiles that came, went, or whose bytes are others, told by their hashes."""
    mark = lambda df, name: df.select("z", "x", "y", F.sha2("tile", 256).alias(name))
    both = mark(old, "before").join(mark(new, "after"), ["z", "x", "y"], "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "changed")
    return both.select("z", "x", "y", change.alias("change")).where("change is not null")


def tile_events(changes: DataFrame) -> DataFrame:
    """One notification for each changed tile, as JSON."""
    return changes.select(F.to_json(F.struct(F.lit("tile").alias("table"), "z", "x", "y", "change")).alias("payload"))


def stale(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Tiles of the cache that meet ``changed`` boxes (xmin, ymin, xmax, ymax in metres)."""
    zooms = cache.select("z").distinct()
    hit = changed.crossJoin(F.broadcast(zooms)).select(F.explode(covering_tiles(*[F.col(k) for k in ("xmin", "ymin", "xmax", "ymax", "z")])).alias("t")).select("t.*").distinct()
    return cache.join(hit, ["z", "x", "y"], "left_semi")
