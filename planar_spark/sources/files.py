"""Readers of the file formats that feed a map, and the tile archive writer."""

from __future__ import annotations

import gzip
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..kernel import wkb
from ..store import spread_in_order


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """A type file with header: id, name, color, layer. The fourth column is taken by place, whatever its title."""
    return spark.read.schema("id string, name string, color string, layer string").option("header", True).option("enforceSchema", True).csv(path)


def read_colors(spark: SparkSession, path: str) -> DataFrame:
    """A colour file: id, colour, symbol, symbol colour and rotation, by white space; ``#`` starts comments, ``transparent`` is null."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    part = F.split("v", r"\s+")
    cell = lambda i: F.nullif(F.get(part, F.lit(i)), F.lit("transparent"))
    return rows.select(F.get(part, F.lit(0)).alias("id"), cell(1).alias("color"), cell(2).alias("symbol"), cell(3).alias("symbol_color"), cell(4).cast("double").alias("rotation"))


def parse_geometry(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``geometry`` (collection WKB), ``srid`` and ``geometry_error`` from WKT, EWKT or hexadecimal WKB."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                try:
                    g, srid = wkb.parse(text) if text is not None else (None, None)
                    out.append((None if g is None else wkb.encode(wkb.multi(g)), srid, None))
                except (ValueError, TypeError) as e:
                    out.append((None, None, str(e)[:200]))
            g, s, e = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.binary()), pa.array(s, pa.int32()), pa.array(e, pa.string())], names=[*b.schema.names, "geometry", "srid", "geometry_error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # Dealt by their places, so that rows stay in order.
    rows = spread_in_order(rows.withColumn("_at", F.monotonically_increasing_id()), "_at").drop("_at")
    return rows.mapInArrow(run, ddl + ", geometry binary, srid int, geometry_error string")


class _Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("parts", 4)), schema

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return []
        step = (high - low) // self.parts + 1
        return [_Slice(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        binary = [f.dataType.simpleString() == "binary" for f in self.schema]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (part.low, part.high)):
                yield tuple(bare(v) if b and v is not None else v for v, b in zip(row, binary, strict=True))


def bare(blob: bytes) -> bytes:
    """The WKB in a GeoPackage blob; other blobs as they are."""
    if blob[:2] != b"GP":
        return bytes(blob)
    box = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]  # fixed values: bytes of the envelope by its code
    return bytes(blob[8 + box :])


class SqliteSource(DataSource):
    """``spark.read.format("planar_sqlite").option("table", ...).schema(...).load(path)``: SQLite and GeoPackage files on a shared path."""

    @classmethod
    def name(cls) -> str:
        return "planar_sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("planar_sqlite").option("table", table).option("parts", parts).schema(schema).load(path)


def cleaned(rows: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Imported rows with a geometry, columns cast."""
    return rows.where("geometry is not null").withColumns({k: F.try_to_timestamp(k) if t == "timestamp" else F.col(k).try_cast(t) for k, t in casts.items()})


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str]) -> int:
    """A tile archive: one SQLite file on the driver's disk, so that rows stream through it partition by partition. Rows count from the south."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([gzip.compress(t, mtime=0) for t in b.column(3).to_pylist()], pa.binary())], names=b.schema.names)

    rows = tiles.select("z", "x", "y", "tile").mapInArrow(packed, "z int, x int, y int, tile binary")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
        db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", metadata.items())
        n = 0
        for r in rows.toLocalIterator():
            db.execute("INSERT INTO tiles VALUES (?, ?, ?, ?)", (r["z"], r["x"], (1 << r["z"]) - 1 - r["y"], bytes(r["tile"])))
            n += 1
    return n
