"""Distances by branch and bound against all pairs."""

import math
import random
import time
from fractions import Fraction

import pytest

from cartolith.kernels import shapes, wkt
from cartolith.kernels.nearest import nearest
from cartolith.kernels.relate import Shape
from cartolith.kernels.relate import test as holds


def every_pair(a, b):
    """The distance as it was: meet or not, then all pairs."""
    if holds("intersects", Shape(a), Shape(b)):
        return 0.0
    to = shapes._to_segment
    return min(min(to(p, *s), to(q, *s), to(s[0], p, q), to(s[1], p, q)) for p, q in shapes._segments(a) for s in shapes._segments(b))


def chain(r, n, x, y, step):
    out = [(x, y)]
    for _ in range(n):
        x, y = x + r.uniform(-step, step), y + r.uniform(-step, step)
        out.append((x, y))
    return out


def text(points):
    return ",".join(f"{x!r} {y!r}" for x, y in points)


def shape(r, whole):
    n, x, y = r.choice([1, 2, 5, 40]), r.uniform(-9, 9), r.uniform(-9, 9)
    points = chain(r, n, x, y, r.choice([0.1, 1, 4]))
    if whole:
        points = [(round(a), round(b)) for a, b in points]
    kind = r.choice(["LINESTRING", "MULTIPOINT", "POLYGON", "POINT", "COLLECTION"])
    if kind == "LINESTRING":
        return wkt.read(f"LINESTRING({text(points)})")
    if kind == "MULTIPOINT":
        return wkt.read(f"MULTIPOINT({','.join(f'({text([p])})' for p in points)})")
    if kind == "POINT":
        return wkt.read(f"POINT({text(points[:1])})")
    size = r.choice([1, 3, 8])
    (x, y), hole = points[0], ""
    if size > 1:
        hole = f",({text([(x + 0.25, y + 0.25), (x + size - 0.25, y + 0.25), (x + size - 0.25, y + size - 0.25), (x + 0.25, y + size - 0.25), (x + 0.25, y + 0.25)])})"
    box = f"POLYGON(({text([(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)])}){r.choice(['', hole])})"
    return wkt.read(box if kind == "POLYGON" else f"GEOMETRYCOLLECTION({box},POINT({text(points[-1:])}),LINESTRING({text(points)}))")


@pytest.mark.parametrize("whole", [False, True])
def test_against_all_pairs(whole):
    r, zeros = random.Random(whole), 0
    for _ in range(400):
        a, b = shape(r, whole), shape(r, whole)
        got, want = shapes.distance(a, b), every_pair(a, b)
        assert math.isclose(got, want, rel_tol=1e-12) if want else got == 0.0
        zeros += not want
    assert 20 < zeros < 380


def test_many_segments():
    r = random.Random(8)
    a, b = chain(r, 3000, 0, 0, 1), chain(r, 3000, 300, 300, 1)
    sa, sb = list(zip(a, a[1:], strict=False)), list(zip(b, b[1:], strict=False))
    i, j = nearest(sa, sb)
    low = min(math.hypot(p[0] - q[0], p[1] - q[1]) for p in a[::7] for q in b[::7])
    to = shapes._to_segment
    found = min(to(sa[i][0], *sb[j]), to(sa[i][1], *sb[j]), to(sb[j][0], *sa[i]), to(sb[j][1], *sa[i]))
    assert found <= low and found == pytest.approx(min(min(to(p, *s) for s in sb) for p in a[::3]), rel=0.05)


def test_ten_thousand_against_ten_thousand():
    """Two rings, one around the other and near it everywhere: the worst case for boxes."""
    n = 10_000
    ring = lambda size: [(size * math.cos(2 * math.pi * i / n), size * math.sin(2 * math.pi * i / n)) for i in range(n)] + [(size, 0.0)]
    a, b = wkt.read(f"LINESTRING({text(ring(1.0))})"), wkt.read(f"LINESTRING({text(ring(1.01))})")
    began = time.perf_counter()
    assert shapes.distance(a, b) == pytest.approx(0.01, rel=1e-4)
    assert time.perf_counter() - began < 5  # about half a second on a free core


def test_crossings_are_exact():
    third = float(Fraction(1, 3))
    assert shapes.distance(wkt.read("LINESTRING(0 0,3 1)"), wkt.read(f"POINT(1 {third!r})")) > 0
    assert shapes.distance(wkt.read("LINESTRING(0 0,4 1)"), wkt.read("POINT(2 0.5)")) == 0
    assert shapes.distance(wkt.read("LINESTRING(0 0,9 9)"), wkt.read("LINESTRING(0 9,9 0)")) == 0
    assert shapes.distance(wkt.read("POLYGON((0 0,9 0,9 9,0 9,0 0))"), wkt.read("POINT(3 3)")) == 0
    assert shapes.distance(wkt.read("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1))"), wkt.read("POINT(3 3)")) == 2
    assert shapes.distance(wkt.read("POINT EMPTY"), wkt.read("POINT(3 3)")) is None
