"""Relations, areas and hulls of random geometries beside the topology suite in Spark's jars."""

import random

import pytest

from cartolith.kernels import shapes, validity, wkt
from cartolith.kernels.relate import Shape, relate


@pytest.fixture(scope="module")
def jts(spark):
    return spark._jvm.org.locationtech.jts.io.WKTReader()


def _geometry(r):
    n = lambda: r.randint(0, 6)
    kind = r.choice(["point", "line", "box", "triangle", "multipoint", "multiline", "hole", "boxes"])
    box = lambda x, y, w, h: f"(({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))"
    if kind == "point":
        return f"POINT({n()} {n()})"
    if kind == "line":
        x, y = n(), n()
        return f"LINESTRING({x} {y},{x + r.randint(1, 3)} {n()},{n()} {y + r.randint(1, 3)})"
    if kind == "box":
        return "POLYGON" + box(n(), n(), r.randint(1, 4), r.randint(1, 4))
    if kind == "triangle":
        x, y, w, h = n(), n(), r.randint(1, 4), r.randint(1, 4)
        return f"POLYGON(({x} {y},{x + w} {y},{x} {y + h},{x} {y}))"
    if kind == "multipoint":
        return f"MULTIPOINT(({n()} {n()}),({n()} {n()}))"
    if kind == "multiline":
        x = n()
        return f"MULTILINESTRING(({x} 0,{x} 5),({n()} 3,{n() + 7} 3))"
    if kind == "hole":
        return "POLYGON((0 0,6 0,6 6,0 6,0 0),(2 2,2 4,4 4,4 2,2 2))"
    return f"MULTIPOLYGON({box(0, 0, 2, 2)},{box(2 + r.randint(1, 2), n(), 2, 2)})"


def test_relate(jts):
    r = random.Random(7)
    for _ in range(400):
        a, b = _geometry(r), _geometry(r)
        assert relate(Shape(wkt.read(a)), Shape(wkt.read(b))) == jts.read(a).relate(jts.read(b)).toString(), (a, b)


def test_measures_and_hulls(jts):
    r = random.Random(8)
    for _ in range(150):
        a, b = _geometry(r), _geometry(r)
        x, y, ga, gb = jts.read(a), jts.read(b), wkt.read(a), wkt.read(b)
        assert shapes.distance(ga, gb) == pytest.approx(x.distance(y), abs=1e-12)
        if ga.dimension == 2:
            h = jts.read(wkt.write(shapes.convex_hull(ga)))
            assert h.equalsTopo(x.convexHull()) and x.covers(jts.read(wkt.write(shapes.point_on_surface(ga))))
            assert jts.read(wkt.write(shapes.oriented_envelope(ga))).getArea() <= x.getEnvelope().getArea() + 1e-9
            assert jts.read(wkt.write(shapes.oriented_envelope(ga))).buffer(1e-9).covers(x)
        c = shapes.concave_hull(ga, 0.2)
        assert c.empty or validity.reason(c) == validity.VALID or ga.dimension < 2


def test_validity(jts, spark):
    r = random.Random(9)
    op = spark._jvm.org.locationtech.jts.operation.valid.IsValidOp
    for _ in range(200):
        ring = [(r.randint(0, 5), r.randint(0, 5)) for _ in range(r.randint(3, 6))]
        text = "POLYGON((" + ",".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"
        assert (validity.reason(wkt.read(text)) == validity.VALID) == op(jts.read(text)).isValid(), text


def test_lines_that_merge(jts, spark):
    r = random.Random(10)
    for _ in range(60):
        lines = [[(r.randint(0, 4), r.randint(0, 4)) for _ in range(2)] for _ in range(r.randint(1, 5))]
        lines = [x for x in lines if x[0] != x[1]]
        if not lines:
            continue
        text = "MULTILINESTRING(" + ",".join("(" + ",".join(f"{x} {y}" for x, y in line) + ")" for line in lines) + ")"
        merger = spark._jvm.org.locationtech.jts.operation.linemerge.LineMerger()
        merger.add(jts.read(text))
        mine = shapes.line_merge(wkt.read(text))
        assert max(1, len(mine.parts)) == merger.getMergedLineStrings().size(), text
        assert sum(len(p[2][0]) - 1 for p in mine.parts) == len(lines)
