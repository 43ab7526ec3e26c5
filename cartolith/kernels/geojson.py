"""Geometries of GeoJSON objects."""

from __future__ import annotations

import json

from ..types import COLLECTION, KIND_NAMES, LINESTRING, MEMBER, POINT, POLYGON
from .geometry import Geometry

_KINDS = {name.lower(): kind for kind, name in KIND_NAMES.items()}


def read(text: str) -> Geometry | None:
    o = json.loads(text)
    if o is None:
        return None
    size = 2

    def coord(c: list) -> tuple:
        nonlocal size
        size = max(size, min(len(c), 3))
        return tuple(map(float, c[:3]))

    def parts(o: dict, path: tuple) -> list:
        kind = _KINDS[o["type"].lower()]
        if kind == COLLECTION:
            if path:
                raise ValueError("nested geometry collections aren't supported")
            return [p for i, g in enumerate(o["geometries"]) for p in (parts(g, (i + 1,)) or [(_KINDS[g["type"].lower()], (i + 1,), [])])]
        c = o["coordinates"]
        one = {POINT: lambda c: [[coord(c)]] if c else [], LINESTRING: lambda c: [[coord(x) for x in c]] if c else [], POLYGON: lambda c: [[coord(x) for x in r] for r in c]}
        if kind in MEMBER:
            return [(MEMBER[kind], (*path, i + 1), one[MEMBER[kind]](x)) for i, x in enumerate(c)]
        rings = one[kind](c)
        return [(kind, path, rings)] if rings or path else []

    found = parts(o, ())
    kind = _KINDS[o["type"].lower()]
    if size == 3:  # two ordinates among three: no height
        found = [(k, p, [[c if len(c) == 3 else (*c, float("nan")) for c in r] for r in rings]) for k, p, rings in found]
    return Geometry(kind, found, 1 if size == 3 else 0, 4326)
