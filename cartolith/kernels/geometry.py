"""Geometries as Python values: dicts of the geometry type, with coordinates as tuples."""

from __future__ import annotations

from ..types import BOX, COLLECTION, LINESTRING, MEMBER, POINT, POLYGON, XY

Coord = tuple  # (x, y), (x, y, z), (x, y, m) or (x, y, z, m)
Ring = list


def has_z(dim: int) -> bool:
    return dim in (1, 3)


def has_m(dim: int) -> bool:
    return dim in (2, 3)


class Geometry:
    """kind, dim, srid, and parts: (kind, path, rings of coordinate tuples)."""

    __slots__ = ("kind", "dim", "srid", "parts")

    def __init__(self, kind: int, parts: list, dim: int = XY, srid: int = 0):
        self.kind, self.parts, self.dim, self.srid = kind, parts, dim, srid

    @classmethod
    def of(cls, row: dict) -> Geometry:
        dim = row["dim"]
        z, m = has_z(dim), has_m(dim)

        def coord(c):
            return (c["x"], c["y"], *((c["z"],) if z else ()), *((c["m"],) if m else ()))

        parts = [(p["kind"], tuple(p["path"] or ()), [[coord(c) for c in r] for r in p["rings"] or ()]) for p in row["parts"] or ()]
        return cls(row["kind"], parts, dim, row["srid"] or 0)

    def row(self) -> dict:
        z, m = has_z(self.dim), has_m(self.dim)

        def coord(c):
            return {"x": c[0], "y": c[1], "z": c[2] if z else None, "m": c[-1] if m else None}

        parts = [{"kind": k, "path": list(p), "rings": [[coord(c) for c in r] for r in rings]} for k, p, rings in self.parts]
        return {"kind": self.kind, "dim": self.dim, "srid": self.srid, "parts": parts}

    # --- views ---------------------------------------------------------------------------------

    @property
    def empty(self) -> bool:
        return not any(rings and rings[0] for _, _, rings in self.parts)

    def flat(self) -> list[tuple[int, list[list[tuple[float, float]]]]]:
        """Non-empty parts in two dimensions: (kind, rings). A box is a polygon."""
        if self.kind == BOX:
            (a, b) = self.parts[0][2][0]
            x0, y0, x1, y1 = a[0], a[1], b[0], b[1]
            return [(POLYGON, [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])]
        return [(k, [[(c[0], c[1]) for c in r] for r in rings if r]) for k, _, rings in self.parts if rings and rings[0]]

    def coords(self) -> list[tuple[float, float]]:
        return [c for _, rings in self.flat() for r in rings for c in r]

    @property
    def dimension(self) -> int:
        """0, 1 or 2 by the highest part; -1 when empty."""
        return max((min(k, 3) - 1 for k, _ in self.flat()), default=-1)

    # --- makers --------------------------------------------------------------------------------

    @classmethod
    def point(cls, c: Coord, srid: int = 0) -> Geometry:
        return cls(POINT, [(POINT, (), [[c]])], XY, srid)

    @classmethod
    def line(cls, coords: list, srid: int = 0, dim: int = XY) -> Geometry:
        return cls(LINESTRING, [(LINESTRING, (), [coords])] if coords else [], dim, srid)

    @classmethod
    def polygon(cls, rings: list, srid: int = 0) -> Geometry:
        return cls(POLYGON, [(POLYGON, (), rings)] if rings else [], XY, srid)

    @classmethod
    def multi(cls, kind: int, members: list, srid: int = 0, dim: int = XY) -> Geometry:
        return cls(kind, [(MEMBER[kind], (i + 1,), rings) for i, rings in enumerate(members)], dim, srid)

    @classmethod
    def collection(cls, srid: int = 0) -> Geometry:
        return cls(COLLECTION, [], XY, srid)
