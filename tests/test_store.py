"""Written tables in joins, and rows dealt over all cores."""

import time

import pytest
from pyspark.sql import functions as F

from planar_spark.operators import units
from planar_spark.sources import files
from planar_spark.store import Store, stored


def test_large_written_tables_are_not_broadcast(spark):
    ids = stored(spark.range(1_000_000, numPartitions=1), "ids")
    small = stored(spark.range(10), "small")
    plan = lambda a, b: a.join(b, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan(ids, spark.range(5_000_000)) and "BroadcastHashJoin" in plan(small, spark.range(5_000_000))


def test_a_single_split_is_parsed_by_all_cores(spark):
    rows = spark.range(100, numPartitions=1).selectExpr("id", "concat('POINT(', id, ' 1)') AS wkt")
    parsed = files.parse_geometry(rows, "wkt")
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and parsed.where("geometry is not null").count() == 100


def test_many_boxes_of_a_small_file_are_not_broadcast(spark, tmp_path):
    spark.range(30_000).coalesce(1).write.parquet(f"{tmp_path}/ids")
    x = F.col("id").cast("double")
    boxes = spark.read.parquet(f"{tmp_path}/ids").select("id", F.struct(x.alias("xmin"), x.alias("ymin"), (x + 0.5).alias("xmax"), (x + 0.5).alias("ymax")).alias("box"))
    pairs = units.box_join(boxes, boxes.select(F.col("id").alias("b_id"), F.col("box").alias("b_box")), [])
    assert "Broadcast" not in pairs._jdf.queryExecution().sparkPlan().toString() and pairs.count() == 30_000
    # Two that meet all others stay a broadcast: in a merge they would be one key, and one task's.
    wide = spark.createDataFrame([(0, (0.0, 0.0, 40000.0, 40000.0)), (1, (0.0, 0.0, 40000.0, 40000.0))], "b_id long, b_box struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    pairs = units.box_join(boxes, wide, [])
    assert "Broadcast" in pairs._jdf.queryExecution().sparkPlan().toString() and pairs.count() == 60_000


def test_tables_of_a_commit_are_written_side_by_side(spark, tmp_path):
    """Each waits for the other's file, so one after the other would not end well; a failing one leaves no version."""
    store = Store(spark, f"file://{tmp_path}/store")
    store.create_empty()

    def meeting(own, other):
        def run(batches):
            (tmp_path / own).touch()
            late = time.time() + 60
            while not (tmp_path / other).exists():
                assert time.time() < late
                time.sleep(0.1)
            yield from batches

        return spark.range(1, numPartitions=1).selectExpr("cast(id as int) AS id", "'a' AS name").mapInPandas(run, "id int, name string")

    store.commit({"map_layer": meeting("a", "b"), "linework_type": meeting("b", "a")})
    assert store.read("map_layer").count() == store.read("linework_type").count() == 1
    version = store.latest()
    with pytest.raises(Exception, match="no good"):
        store.commit({"map_layer": spark.range(1), "linework_type": spark.range(1).select(F.raise_error(F.lit("no good")).alias("id"))})
    assert store.latest() == version
