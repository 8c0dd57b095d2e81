"""Settings of one topology."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TopoConfig:
    srid: int = 4326
    tolerance: float = 1e-5
