"""Declared schemas of source and derived tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

SOURCES = {
    "map_layer": "id int, name string, description string, parent int, topological boolean",
    "linework_type": "id string, name string, color string",
    "polygon_type": "id string, name string, color string, symbol string, symbol_color string, member_of string",
    "linework": "id int, geometry binary, type string, map_layer int, created timestamp_ntz, name string",
    "polygon": "id int, geometry binary, type string, map_layer int, created timestamp_ntz, name string",
}
DERIVED = {
    "linework_topo": "line_id int, geometry_hash string, topology_error string, map_layer int, type string, region bigint",
    "polygon_topo": "polygon_id int, digest string, map_layer int, box struct<xmin: double, ymin: double, xmax: double, ymax: double>",
    "region": "region bigint, xmin double, ymin double, xmax double, ymax double",
    "node": "node_id bigint, x double, y double, region bigint",
    "edge": "edge_id bigint, start_node bigint, end_node bigint, left_face bigint, right_face bigint, x1 double, y1 double, x2 double, y2 double, region bigint",
    "edge_chain": "edge_id bigint, chain bigint",
    "line_edge": "line_id int, edge_id bigint, region bigint",
    "edge_relation": "edge_id bigint, map_layer int, line_id int, type string, region bigint",
    "face": "face_id bigint, area double, region bigint",
    "map_face": "id bigint, unit_id string, map_layer int, geometry binary, area double, region bigint",
    "map_face_face": "map_face bigint, map_layer int, face_id bigint, region bigint",
    "face_type": "face_id bigint, map_face bigint, map_layer int, unit_id string, region bigint",
    "dirty_face": "id bigint, map_layer int",
    "notification": "seq bigint, channel string, payload string",
}
#: Tables dealt to buckets, and by which key. A region is what lies within one outline: an update replaces whole regions.
REGIONAL = ("node", "edge", "line_edge", "edge_relation", "face", "map_face", "map_face_face", "face_type")
BUCKETED = {n: "region" for n in (*REGIONAL, "region")} | {"linework_topo": "line_id", "polygon_topo": "polygon_id"}
DIGITIZER = "certainty int, zoom_level int, pixel_width decimal(38,18), map_width decimal(38,18), hidden boolean, source string"
TILES = {"layer": "id string, format string, content_type string, name string", "tile": "z int, x int, y int, tile binary, layer_id string, created timestamp_ntz, stale boolean"}


def of(name: str) -> StructType:
    return StructType.fromDDL((SOURCES | DERIVED)[name])
