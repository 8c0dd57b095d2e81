"""Planar topology and map-face derivation on PySpark."""
