"""The edit log as a stream: a burst becomes one solve."""

from test_scenarios import BEDROCK, line, ring, topo  # noqa: F401

from planar_spark.streaming.watch import EDIT, watch


def test_burst(spark, topo, tmp_path):  # noqa: F811
    edits = [
        (1, "linework", "INSERT", 1, bytearray(line("LINESTRING" + ring(2, 3, 3))), "contact", BEDROCK),
        (2, "linework", "UPDATE", 1, bytearray(line("LINESTRING" + ring(4, 3, 3))), "contact", BEDROCK),
        (3, "linework", "INSERT", 2, bytearray(line("LINESTRING" + ring(8, 30, 3))), "contact", BEDROCK),
        (4, "linework", "DELETE", 2, None, None, None),
        (5, "polygon", "INSERT", 1, bytearray(line(f"POLYGON({ring(1, 3, 3)})")), "terrace", BEDROCK),
    ]
    spark.createDataFrame(edits, EDIT).coalesce(1).write.parquet(f"file://{tmp_path}/log")
    watch(topo, f"file://{tmp_path}/log", f"file://{tmp_path}/at", once=True).awaitTermination()
    assert [(r["map_layer"], r["area"], r["unit_id"]) for r in topo.map_faces().collect()] == [(BEDROCK, 16.0, "terrace")]
    assert topo.store.read("notification").count() == 1
