"""Vector tiles: clipping, quantising and the protocol-buffer encoding of the public tile specification, version 2."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np

from . import planar
from .wkb import Geometry

EXTENT, BUFFER = 4096, 64
POINT, LINE, POLYGON = 1, 2, 3  # fixed values: geometry types of the format


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Sutherland-Hodgman against a box."""
    if len(ring) and (ring >= box[:2]).all() and (ring <= box[2:]).all():
        return ring
    for axis, sign, edge in ((0, 1, box[0]), (1, 1, box[1]), (0, -1, box[2]), (1, -1, box[3])):
        out: list[np.ndarray] = []
        for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            a, b = sign * (p[axis] - edge), sign * (q[axis] - edge)
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                out.append(p + (q - p) * (a / (a - b)))
        ring = np.array(out).reshape(-1, 2)
        if not len(ring):
            break
    return ring


def clip_line(a: np.ndarray, box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """Liang-Barsky on every segment; connected stretches are joined."""
    out: list[list[np.ndarray]] = []
    for p, q in zip(a, a[1:], strict=False):
        d, t0, t1 = q - p, 0.0, 1.0
        for axis in (0, 1):
            for low, edge in ((True, box[axis]), (False, box[axis + 2])):
                gap = edge - p[axis]
                if d[axis] == 0:
                    if (gap > 0) == low and gap != 0:
                        t1 = -1.0
                elif (d[axis] > 0) == low:
                    t0 = max(t0, gap / d[axis])
                else:
                    t1 = min(t1, gap / d[axis])
        if t0 < t1:
            s, e = p + d * t0, p + d * t1
            if out and (out[-1][-1] == s).all():
                out[-1].append(e)
            else:
                out.append([s, e])
    return [np.array(x) for x in out]


SHORT = [bytes([n]) for n in range(128)]


def varint(n: int) -> bytes:
    if n < 128:
        return SHORT[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def commands(parts: list[np.ndarray], closed: bool) -> bytes:
    """Move to, line to and close, with zigzag deltas."""
    out, at = bytearray(), np.zeros(2, np.int64)
    zigzag = lambda v: varint(int(v) << 1 ^ int(v) >> 63)
    for a in parts:
        steps = np.diff(np.concatenate([at[None], a]), axis=0).tolist()
        out += varint(1 << 3 | 1) + zigzag(steps[0][0]) + zigzag(steps[0][1])
        if len(a) > 1:
            out += varint((len(a) - 1) << 3 | 2)
            for dx, dy in steps[1:]:
                out += zigzag(dx) + zigzag(dy)
        if closed:
            out += varint(1 << 3 | 7)
        at = a[-1]
    return bytes(out)


def quantised(geometry: Geometry, box: tuple[float, float, float, float]) -> tuple[int, list[np.ndarray]]:
    """Type and grid parts of a geometry in a tile's box; no parts if nothing of it is left."""
    side = (box[2] - box[0]) / EXTENT
    wide = (box[0] - BUFFER * side, box[1] - BUFFER * side, box[2] + BUFFER * side, box[3] + BUFFER * side)
    grid = lambda a: np.rint((a - (box[0], box[3])) / (side, -side)).astype(np.int64)
    thin = lambda a: a[np.concatenate([[True], (np.diff(a, axis=0) != 0).any(1)])] if len(a) else a
    if "POLYGON" in geometry[0]:
        out = []
        for polygon in geometry[1] if geometry[0] == "MULTIPOLYGON" else [geometry[1]]:
            for i, ring in enumerate(polygon):
                a = thin(grid(clip_ring(np.asarray(ring)[:-1], wide)))
                if len(a) > 1 and (a[0] == a[-1]).all():
                    a = a[:-1]
                area = planar.signed_area(np.concatenate([a, a[:1]]).astype(float)) if len(a) > 2 else 0.0
                if not area:
                    if i == 0:
                        break
                    continue
                # On a grid that grows downwards, outer rings have positive area and holes negative.
                out.append(a if (area > 0) == (i == 0) else a[::-1])
        return POLYGON, out
    if geometry[0] == "POINT":
        p = geometry[1][0][0]
        return POINT, [grid(geometry[1][0])] if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3] else []
    return LINE, [a for part in geometry[1] for c in clip_line(np.asarray(part), wide) if len(a := thin(grid(c))) > 1]


def clipped(geometry: Geometry, box: tuple[float, float, float, float]) -> Geometry | None:
    """What of a geometry lies in a box, as a collection of its kind; None if that is nothing. Rings stay closed."""
    kind, parts = geometry
    if "POLYGON" in kind:
        out = []
        for polygon in parts if kind == "MULTIPOLYGON" else [parts]:
            rings = [np.concatenate([r, r[:1]]) if len(r := clip_ring(np.asarray(ring)[:-1], box)) else r for ring in polygon]
            if len(rings[0]):
                out.append([r for r in rings if len(r)])
        return ("MULTIPOLYGON", out) if out else None
    if "POINT" in kind:
        every = [a[(a[:, 0] >= box[0]) & (a[:, 0] <= box[2]) & (a[:, 1] >= box[1]) & (a[:, 1] <= box[3])] for a in map(np.asarray, parts)]
        every = [a for a in every if len(a)]
        return (kind, every) if every else None
    lines = [c for part in parts for c in clip_line(np.asarray(part), box)]
    return ("MULTILINESTRING", lines) if lines else None


def tile_box(z: int, x: int, y: int, world: float) -> tuple[float, float, float, float]:
    side = world / 2**z
    return x * side - world / 2, world / 2 - (y + 1) * side, (x + 1) * side - world / 2, world / 2 - y * side


def descend(geometry: Geometry, zoom: int, world: float) -> Iterator[tuple[int, int, int, bytes]]:
    """(x, y, kind, commands) of every tile of a zoom in which something of the geometry is left: quarter by quarter from the whole world, so that each quarter clips
    only what its parent held."""
    todo = [(0, 0, 0, geometry, planar.bounds(geometry))]
    while todo:
        z, x, y, part, own = todo.pop()
        if z == zoom:
            kind, parts = quantised(part, tile_box(z, x, y, world))
            if parts:
                yield x, y, kind, commands(parts, kind == POLYGON)
            continue
        if own is None:
            continue
        for i in (0, 1):
            for j in (0, 1):
                low = tile_box(z + 1, 2 * x + i, 2 * y + j, world)
                spare = (low[2] - low[0]) / EXTENT * BUFFER
                wide = (low[0] - spare, low[1] - spare, low[2] + spare, low[3] + spare)
                if own[0] > wide[2] or own[2] < wide[0] or own[1] > wide[3] or own[3] < wide[1]:
                    continue
                if "POLYGON" in part[0] and own[0] >= wide[0] and own[2] <= wide[2] and own[1] >= wide[1] and own[3] <= wide[3]:
                    todo.append((z + 1, 2 * x + i, 2 * y + j, part, own))
                elif (inner := clipped(part, wide)) is not None:
                    todo.append((z + 1, 2 * x + i, 2 * y + j, inner, planar.bounds(inner)))


def layer(name: str, features: list[tuple[Geometry, dict]], box: tuple[float, float, float, float]) -> bytes:
    """One encoded layer field; empty if no feature is left in the box."""
    drawn = [(*quantised(geometry, box), tags) for geometry, tags in features]
    return assembled(name, [(kind, commands(parts, kind == POLYGON), tags) for kind, parts, tags in drawn if parts])


class Layer:
    """A layer field that takes encoded features one at a time and holds no more than their bytes. Features come by the values of the tag ``ordered``: of these only the last is known."""

    def __init__(self, name: str, ordered: str | None = None):
        self.name, self.ordered, self.n, self.last = name, ordered, 0, (None, 0)
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.features, self.spelled = bytearray(), bytearray()

    def _new(self, kind: str, v) -> int:
        self.spelled += field(4, field(1, v.encode()) if kind == "str" else varint(4 << 3) + varint(int(v) & (1 << 64) - 1) if kind == "int" else varint(7 << 3) + varint(int(v)) if kind == "bool" else bytes([3 << 3 | 1]) + np.float64(v).tobytes())
        self.n += 1
        return self.n - 1

    def add(self, kind: int, drawn: bytes, tags: dict) -> None:
        marks = b""
        for k, v in tags.items():
            if v is None:
                continue
            own = type(v).__name__, v
            if k == self.ordered:
                if self.last[0] != own:
                    self.last = own, self._new(*own)
                at = self.last[1]
            else:
                at = self.values[own] if own in self.values else self.values.setdefault(own, self._new(*own))
            marks += varint(self.keys.setdefault(k, len(self.keys))) + varint(at)
        self.features += field(2, field(2, marks) + bytes([3 << 3, kind]) + field(4, drawn))

    def parts(self) -> list[bytes]:
        """The field's bytes in pieces; none if it has no feature."""
        if not self.features:
            return []
        body = [bytes([15 << 3, 2]) + field(1, self.name.encode()), self.features, b"".join(field(3, k.encode()) for k in self.keys), self.spelled, bytes([5 << 3]) + varint(EXTENT)]
        return [varint(3 << 3 | 2) + varint(sum(map(len, body))), *body]


def assembled(name: str, features: list[tuple[int, bytes, dict]]) -> bytes:
    """One encoded layer field of features whose geometries are encoded already."""
    out = Layer(name)
    for f in features:
        out.add(*f)
    return b"".join(out.parts())


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers, and bytes of everything else."""
    for n, v, _ in placed(data):
        yield n, v


def placed(data: bytes) -> Iterator[tuple[int, int | bytes, int]]:
    """The ``fields`` of a message, each with the place where it ends."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    end = len(data)
    while at < end:
        tag, at = data[at], at + 1  # mostly of one byte, as lengths are
        if tag > 127:
            at -= 1
            tag = number()
        kind = tag & 7
        if kind == 0:
            v = number()
        else:
            size = {1: 8, 5: 4}.get(kind, 0)
            if kind == 2:
                size, at = data[at], at + 1
                if size > 127:
                    at -= 1
                    size = number()
            v = data[at : at + size]
            at += size
        yield tag >> 3, v, at


def value_of(data: bytes) -> str | float | int | bool:
    n, v = next(fields(data))
    if n == 1:
        return bytes(v).decode()
    if n in (2, 3):
        return struct.unpack("<f" if n == 2 else "<d", v)[0]
    return bool(v) if n == 7 else v >> 1 ^ -(v & 1) if n == 6 else v - (1 << 64) if n == 4 and v >> 63 else v


def contents(tile: bytes) -> list[tuple[str, dict]]:
    """(layer, tags) of every feature of a tile."""
    return list(each_feature(tile))


def each_feature(tile: bytes) -> Iterator[tuple[str, dict]]:
    """``contents`` one after the other: a tile may hold millions, of which only the places of their values are kept."""
    for _, body in fields(memoryview(tile).cast("B")):
        name, keys, ends, sizes = "", [], array("q"), array("q")
        for n, v, end in placed(body):
            if n == 1:
                name = bytes(v).decode()
            elif n == 3:
                keys.append(bytes(v).decode())
            elif n == 4:
                ends.append(end)
                sizes.append(len(v))
        value = lambda k: value_of(body[ends[k] - sizes[k] : ends[k]])  # noqa: B023, E731
        for n, feature in fields(body):
            if n != 2:
                continue
            tags, marks, at = next((v for n, v in fields(feature) if n == 2), b""), [], 0
            while at < len(tags):
                mark = shift = 0
                while True:
                    byte, at = tags[at], at + 1
                    mark |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                marks.append(mark)
            yield name, {keys[k]: value(v) for k, v in zip(marks[::2], marks[1::2], strict=True)}
