"""Colour codes of geologic map charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percent of ink by code character.
INK = {"0": 0, "A": 8, "1": 13, "2": 20, "3": 30, "4": 40, "5": 50, "6": 60, "7": 70, "X": 100}


def ink(code: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in INK.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def cmyk_hex(code: Column) -> Column:
    """``#rrggbb`` of a code of three or four ink characters (cyan, magenta, yellow, black)."""
    black = F.coalesce(ink(F.substring(code, 4, 1)), F.lit(0))
    one = lambda i: F.lpad(F.lower(F.hex(F.floor(F.lit(255) * (100 - ink(F.substring(code, i, 1))) * (100 - black) / 10000).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), one(1), one(2), one(3))
