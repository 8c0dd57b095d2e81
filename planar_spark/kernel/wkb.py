"""Well-known binary and text, in and out. A geometry is (kind, parts): lists of coordinate arrays of shape (n, 2).

Kinds: POINT and LINESTRING hold one array, MULTILINESTRING arrays, POLYGON rings, MULTIPOLYGON lists of rings.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# Type codes of the format, and its flag for an SRID.
CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
KINDS = {v: k for k, v in CODES.items()}
SRID_FLAG = 0x20000000

Geometry = tuple[str, list]


def _array(a) -> np.ndarray:
    return np.asarray(a, np.float64).reshape(-1, 2)


def encode(geometry: Geometry) -> bytes:
    """Little-endian, without SRID."""
    kind, parts = geometry
    head = struct.pack("<BI", 1, CODES[kind])

    def ring(a) -> bytes:
        a = _array(a)
        return struct.pack("<I", len(a)) + a.astype("<f8").tobytes()

    if kind == "POINT":
        return head + _array(parts[0]).astype("<f8").tobytes()
    if kind == "LINESTRING":
        return head + ring(parts[0])
    if kind == "POLYGON":
        return head + struct.pack("<I", len(parts)) + b"".join(map(ring, parts))
    one = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}[kind]
    members = [(one, p if one == "POLYGON" else [p]) for p in parts]
    return head + struct.pack("<I", len(members)) + b"".join(map(encode, members))


def decode(data: bytes) -> tuple[Geometry, int | None]:
    """(geometry, srid): either byte order, with or without SRID. Raises ValueError for what is not such a geometry."""
    at = 0

    def take(fmt: str):
        nonlocal at
        size = struct.calcsize(fmt)
        if at + size > len(data):
            raise ValueError("geometry ends early")
        at += size
        return struct.unpack_from(fmt, data, at - size)

    def points(order: str, n: int) -> np.ndarray:
        nonlocal at
        if at + 16 * n > len(data):
            raise ValueError("geometry ends early")
        at += 16 * n
        return np.frombuffer(data, order + "f8", 2 * n, at - 16 * n).astype(np.float64).reshape(-1, 2)

    def one() -> tuple[Geometry, int | None]:
        order = "<" if take("<B")[0] == 1 else ">"
        code = take(order + "I")[0]
        srid = take(order + "I")[0] if code & SRID_FLAG else None
        kind = KINDS.get(code & ~SRID_FLAG)
        if kind is None:
            raise ValueError(f"unsupported geometry code {code}")
        if kind == "POINT":
            return (kind, [points(order, 1)]), srid
        n = take(order + "I")[0]
        if kind == "LINESTRING":
            return (kind, [points(order, n)]), srid
        if kind == "POLYGON":
            return (kind, [points(order, take(order + "I")[0]) for _ in range(n)]), srid
        members = [one()[0][1] for _ in range(n)]
        return (kind, members if kind == "MULTIPOLYGON" else [m[0] for m in members]), srid

    return one()


def parse(text: str) -> tuple[Geometry, int | None]:
    """(geometry, srid) of WKT, EWKT or hexadecimal WKB."""
    text = text.strip()
    if re.fullmatch(r"[0-9A-Fa-f]+", text):
        return decode(bytes.fromhex(text))
    m = re.fullmatch(r"(?:SRID=(\d+);)?\s*([A-Za-z]+)\s*(\(.*\)|EMPTY)", text, re.S)
    if not m or m[2].upper() not in CODES:
        raise ValueError(f"not a geometry: {text[:40]!r}")
    kind, srid = m[2].upper(), int(m[1]) if m[1] else None
    if m[3] == "EMPTY":
        return (kind, []), srid
    tree = re.sub(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", r"[\1,\2]", m[3])
    if re.search(r"[^\d\s.,eE+\-()\[\]]", tree):
        raise ValueError(f"not a geometry: {text[:40]!r}")
    import json

    got = json.loads(tree.replace("(", "[").replace(")", "]"))
    if kind in ("POINT", "LINESTRING"):
        return (kind, [_array(got)]), srid
    if kind == "MULTIPOLYGON":
        return (kind, [[_array(r) for r in p] for p in got]), srid
    return (kind, [_array(r) for r in got]), srid


def text_of(geometry: Geometry) -> str:
    kind, parts = geometry
    ring = lambda a: "(" + ",".join(f"{x:.15g} {y:.15g}" for x, y in _array(a)) + ")"
    if not parts:
        return f"{kind} EMPTY"
    if kind in ("POINT", "LINESTRING"):
        return kind + ring(parts[0])
    if kind == "MULTIPOLYGON":
        return kind + "(" + ",".join("(" + ",".join(map(ring, p)) + ")" for p in parts) + ")"
    return kind + "(" + ",".join(map(ring, parts)) + ")"


def multi(geometry: Geometry) -> Geometry:
    """Promote a single geometry to its collection."""
    kind, parts = geometry
    if kind == "POLYGON":
        return "MULTIPOLYGON", [parts] if parts else []
    return ("MULTI" + kind, parts) if kind in ("POINT", "LINESTRING") else geometry
