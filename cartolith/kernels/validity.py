"""Validity of geometries by the simple-features rules, and the first reason against it."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

from ..types import BOX, LINESTRING, POLYGON
from .exact import crossings, exact, in_ring
from .geometry import Geometry

VALID = "Valid Geometry"
_HALF = Fraction(1, 2)


def _ring_meets(ring: list) -> str | None:
    """Why a ring isn't simple, if so."""
    n = len(ring) - 1
    segments = list(zip(ring, ring[1:], strict=False))
    for i, j in combinations(range(n), 2):
        met = crossings(*segments[i], *segments[j])
        if not met:
            continue
        near = {ring[j]} if j == i + 1 else {ring[0]} if i == 0 and j == n - 1 else set()
        if n == 2 or set(met) - near:
            ends = {*segments[i], *segments[j]}
            touch = len(met) == 1 and met[0] in segments[i] and met[0] in segments[j]
            return "Ring Self-intersection" if touch and met[0] in ends else "Self-intersection"
    return None


def _two_rings(a: list, b: list) -> tuple[str | None, set]:
    """Why two rings don't stand beside or in each other, if so, and the points where they touch."""
    touching = set()
    for s in zip(a, a[1:], strict=False):
        for t in zip(b, b[1:], strict=False):
            met = crossings(*s, *t)
            if len(met) > 1:
                return "Self-intersection", touching
            touching.update(met)
    sides = {_side(a, b, touching), _side(b, a, touching)}
    return ("Self-intersection" if 0 in sides else None), touching


def _side(a: list, b: list, touching: set) -> int:
    """1 if a, cut where it touches b, is inside b, -1 if outside, 0 if both."""
    found = set()
    for p, q in zip(a, a[1:], strict=False):
        cuts = sorted({p, q, *(c for c in touching if crossings(p, q, c, c))}, key=lambda c: (c[0] - p[0]) * (q[0] - p[0]) + (c[1] - p[1]) * (q[1] - p[1]))
        for u, v in zip(cuts, cuts[1:], strict=False):
            side = in_ring(((u[0] + v[0]) * _HALF, (u[1] + v[1]) * _HALF), b)
            if side:
                found.add(side)
    return found.pop() if len(found) == 1 else 0


def reason(g: Geometry) -> str:
    for _, _, rings in g.parts:
        for r in rings:
            if any(not math.isfinite(v) for c in r for v in c[:2]):
                return "Invalid Coordinate"
    if g.kind == BOX:
        return VALID
    polygons: dict[tuple, list] = {}
    for (kind, path, _), (_, flat) in zip([p for p in g.parts if p[2] and p[2][0]], g.flat(), strict=True):
        rings = [[exact(c) for c in r] for r in flat]
        if kind == LINESTRING and len(set(rings[0])) < 2:
            return "Too few points in geometry component"
        if kind == POLYGON:
            for r in rings:
                if r[0] != r[-1]:
                    return "Ring is not closed"
                if len(r) < 4 or len(set(r)) < 3:
                    return "Too few points in geometry component"
            clean = [[c for i, c in enumerate(r) if i == 0 or c != r[i - 1]] for r in rings]
            if why := _polygon(clean):
                return why
            polygons.setdefault(path[:-1], []).append(clean)
    for group in polygons.values():
        for a, b in combinations(group, 2):
            why, _ = _two_rings(a[0], b[0])
            if why:
                return why
            for inner, outer in ((a, b), (b, a)):
                if _inside(inner[0], outer[0]) and not any(_inside(inner[0], h) for h in outer[1:]):
                    return "Nested shells"
    return VALID


def _inside(a: list, b: list) -> bool:
    sides = {in_ring(c, b) for c in a}
    return _side(a, b, {c for c in a if in_ring(c, b) == 0}) > 0 if 0 in sides else sides == {1}


def _polygon(rings: list) -> str | None:
    for r in rings:
        if why := _ring_meets(r):
            return why
    touches: list[tuple[int, int, tuple]] = []
    for (i, a), (j, b) in combinations(enumerate(rings), 2):
        why, met = _two_rings(a, b)
        if why:
            return why
        touches += [(i, j, p) for p in met]
    shell, holes = rings[0], rings[1:]
    for h in holes:
        if not _inside(h, shell):
            return "Hole lies outside shell"
    for a, b in combinations(holes, 2):
        if _inside(a, b) or _inside(b, a):
            return "Holes are nested"
    # rings that touch in a circle cut the interior apart: rings and touching points as a graph
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for ring, p in dict.fromkeys((ring, p) for i, j, p in touches for ring in (i, j)):
        a, b = find(("ring", ring)), find(("at", p))
        if a == b:
            return "Interior is disconnected"
        parent[a] = b
    return None
