"""Well-known binary: reads ISO and extended codes of either byte order, writes little-endian ISO."""

from __future__ import annotations

import math
import struct

from ..types import BOX, COLLECTION, LINESTRING, MEMBER, POINT, POLYGON
from .geometry import Geometry, has_m, has_z


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.srid = 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise ValueError("truncated WKB")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def geometry(self, path: tuple = (), inside: bool = False) -> tuple[int, int, list]:
        order = self.take("B")[0]
        if order not in (0, 1):
            raise ValueError("malformed WKB: byte order")
        e = "<" if order else ">"
        code = self.take(e + "I")[0]
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        if code & 0x20000000:
            self.srid = self.take(e + "I")[0]
        code &= 0x1FFFFFFF
        kind, iso = code % 1000, code // 1000
        if iso > 3 or not 1 <= kind <= 7:
            raise ValueError(f"unknown geometry type in WKB: {code}")
        z, m = z or iso in (1, 3), m or iso in (2, 3)
        size = 2 + z + m
        dim = z + 2 * m

        def ring() -> list:
            n = self.take(e + "I")[0]
            flat = self.take(f"{e}{n * size}d")
            return [tuple(flat[i : i + size]) for i in range(0, n * size, size)]

        if kind == POINT:
            c = self.take(f"{e}{size}d")
            parts = [(POINT, path, [] if all(map(math.isnan, c[:2])) else [[c]])]
        elif kind == LINESTRING:
            c = ring()
            parts = [(LINESTRING, path, [c] if c else [])]
        elif kind == POLYGON:
            parts = [(POLYGON, path, [ring() for _ in range(self.take(e + "I")[0])])]
        else:
            if kind == COLLECTION and inside:
                raise ValueError("nested geometry collections aren't supported")
            parts = []
            for i in range(self.take(e + "I")[0]):
                k, d, some = self.geometry((*path, i + 1), True)
                if kind != COLLECTION and k != MEMBER[kind]:
                    raise ValueError("malformed WKB: member of another type")
                dim = max(dim, d)
                parts += some or [(k, (*path, i + 1), [])]
        if not inside and kind in (POINT, LINESTRING, POLYGON) and not parts[0][2]:
            parts = []
        return kind, dim, parts


def read(data: bytes) -> Geometry:
    reader = _Reader(bytes(data))
    kind, dim, parts = reader.geometry()
    return Geometry(kind, parts, dim, reader.srid)


def write(g: Geometry) -> bytes:
    iso = (0, 1000, 2000, 3000)[g.dim]
    size = 2 + has_z(g.dim) + has_m(g.dim)

    def head(kind: int) -> bytes:
        return struct.pack("<BI", 1, kind + iso)

    def ring(r: list) -> bytes:
        return struct.pack(f"<I{len(r) * size}d", len(r), *(v for c in r for v in c))

    def one(kind: int, rings: list) -> bytes:
        if kind == POINT:
            return head(kind) + struct.pack(f"<{size}d", *(rings[0][0] if rings else [math.nan] * size))
        if kind == LINESTRING:
            return head(kind) + (ring(rings[0]) if rings else struct.pack("<I", 0))
        if kind == POLYGON:
            return head(kind) + struct.pack("<I", len(rings)) + b"".join(map(ring, rings))
        return head(kind) + struct.pack("<I", 0)

    if g.kind == BOX:
        return write(Geometry(POLYGON, [(POLYGON, (), g.flat()[0][1])], 0))
    if g.kind in (POINT, LINESTRING, POLYGON):
        return one(g.kind, g.parts[0][2] if g.parts else [])
    if g.kind != COLLECTION:
        return head(g.kind) + struct.pack("<I", len(g.parts)) + b"".join(one(k, r) for k, _, r in g.parts)
    children: dict[int, list] = {}
    for part in g.parts:
        children.setdefault(part[1][0], []).append(part)
    out = []
    for parts in children.values():
        if len(parts[0][1]) == 1:
            out.append(one(parts[0][0], parts[0][2]))
        else:
            out.append(head(parts[0][0] + 3) + struct.pack("<I", len(parts)) + b"".join(one(k, r) for k, _, r in parts))
    return head(COLLECTION) + struct.pack("<I", len(out)) + b"".join(out)
