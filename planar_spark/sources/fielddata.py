"""Field projects in JSON: spots, tags, and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIENTATION = "struct<id: string, type: string, strike: double, dip: double, trend: double, plunge: double, feature_type: string"
SPOT = f"struct<properties: struct<id: string, name: string, orientation_data: array<{ORIENTATION}, associated_orientation: array<{ORIENTATION}>>>>>, geometry: string>"
PROJECT = f"spotsDb map<string, {SPOT}>, project struct<tags: array<struct<id: string, name: string, type: string, spots: array<string>>>>"


def read_project(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spots (id, data), tags (id, name, type), spot_tags (spot_id, tag_id)); tags of unknown spots are left out."""
    doc = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    spots = doc.select(F.explode("spotsDb").alias("id", "data"))
    tags = doc.select(F.explode("project.tags").alias("t")).select("t.*")
    pairs = tags.select(F.explode("spots").alias("spot_id"), F.col("id").alias("tag_id")).distinct()
    return spots, tags.select("id", "name", "type"), pairs.join(spots.select(F.col("id").alias("spot_id")), "spot_id", "left_semi")


def measurements(spots: DataFrame) -> DataFrame:
    """(spot_id, spot_index, n, orientation): measurements and those associated with them, numbered within their spot."""
    top = spots.select(F.col("id").alias("spot_id"), F.posexplode("data.properties.orientation_data").alias("i", "o"))
    fields = ["id", "type", "strike", "dip", "trend", "plunge", "feature_type"]
    bare = lambda v: F.struct(*[v.getField(f).alias(f) for f in fields])
    every = F.concat(F.array(bare(F.col("o"))), F.coalesce(F.transform("o.associated_orientation", bare), F.array().cast(f"array<{ORIENTATION}>>")))
    rows = top.select("spot_id", "i", F.posexplode(every).alias("j", "orientation"))
    return rows.select("spot_id", F.col("i").alias("spot_index"), F.row_number().over(Window.partitionBy("spot_id").orderBy("i", "j")).alias("n"), "orientation")


def safe_number(value: Column) -> Column:
    """Numbers as text, so that no reader rounds whole ones over a million."""
    return value.cast("string")


def color_of(unit: Column, tag: Column, fallback: str = "#888888") -> Column:
    return F.coalesce(unit, tag, F.lit(fallback))
