"""Distances of whole columns beside those of single pairs."""

import math
import random
import time
from fractions import Fraction

import pyarrow as pa
import pytest
from test_nearest import chain, shape, text

from cartolith.functions import codecs, distances
from cartolith.functions.arrays import decode
from cartolith.kernels import shapes, wkt
from cartolith.kernels.geometry import Geometry
from cartolith.register import register_all
from cartolith.types import ARROW_GEOM, BOX

PAIR = pa.struct([("a", pa.int8()), ("b", pa.int8()), ("n", pa.int32()), ("parts", ARROW_GEOM.field("parts").type)])


def pairs(rows):
    out = []
    for a, b in rows:
        x, y = (g.row()["parts"] if g else [] for g in (a, b))
        out.append({"a": a.kind, "b": b.kind, "n": len(x), "parts": x + y} if a and b else {"a": 0, "b": 0, "n": 0, "parts": []})
    return pa.array(out, PAIR)


def box(r):
    x, y = r.randint(-9, 9), r.randint(-9, 9)
    return Geometry(BOX, [(BOX, (), [[(x, y), (x + r.randint(-3, 5), y + r.randint(0, 4))]])])


def same(got, want):
    return got is want if want is None or got is None else got == 0 if want == 0 else math.isclose(got, want, rel_tol=1e-12)


@pytest.mark.parametrize("direct", [30, distances.DIRECT])
@pytest.mark.parametrize("whole", [False, True])
def test_rows_give_what_single_pairs_give(monkeypatch, whole, direct):
    """Multi-part shapes, holes, boxes, empty ones; by all pairs and by single rows."""
    monkeypatch.setattr(distances, "DIRECT", direct)
    r, empty = random.Random(whole), ["POINT EMPTY", "POLYGON EMPTY", "GEOMETRYCOLLECTION EMPTY", "MULTIPOINT EMPTY"]
    one = lambda: box(r) if r.random() < 0.1 else wkt.read(r.choice(empty)) if r.random() < 0.05 else shape(r, whole)
    rows = [(one(), one()) if r.random() < 0.95 else (None, one()) for _ in range(700)]
    want = [shapes.distance(a, b) if a and b else None for a, b in rows]
    assert all(map(same, distances.distances(pairs(rows)).to_pylist(), want)) and want.count(0.0) > 20 and want.count(None) > 20
    assert all(map(same, distances.distances(pairs(rows)[5:450]).to_pylist(), want[5:450]))
    assert distances.distances(pairs([])).to_pylist() == [] and distances.distances(pairs([(None, None)] * 3)).to_pylist() == [None] * 3


def test_what_rounding_leaves_open():
    third = float(Fraction(1, 3))
    texts = [
        (f"POINT(1 {third!r})", "POLYGON((0 0,3 0,3 1,0 0))"), (f"POINT(1 {third!r})", "POLYGON((0 0,3 1,0 1,0 0))"), (f"POINT(1 {third!r})", "LINESTRING(0 0,3 1)"), ("POINT(2 0.5)", "LINESTRING(0 0,4 1)"),
        ("POINT(3 3)", "POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1))"), ("MULTIPOINT((20 20),(0.5 0.5))", "MULTIPOLYGON(((30 30,31 30,31 31,30 30)),((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1)))"),
        ("POINT(1e200 1)", "LINESTRING(0 0,1 1)"), ("LINESTRING(0 0,1 0)", "LINESTRING(0 1e-200,1 1e-200)"),
    ]
    rows = [(wkt.read(a), wkt.read(b)) for a, b in texts]
    for some in (rows, [(b, a) for a, b in rows]):
        got = distances.distances(pairs(some)).to_pylist()
        assert got == [shapes.distance(a, b) for a, b in some] and got[0] == got[3] == got[5] == 0 and got[4] == 2


def test_rows_of_few_pairs_are_not_searched_one_by_one(monkeypatch):
    monkeypatch.setattr(shapes, "distance", None)
    line = wkt.read("LINESTRING(0 0,30 0)")
    got = distances.distances(pairs([(Geometry.point((float(i), i + 1.0)), line) for i in range(500)])).to_pylist()
    assert got == pytest.approx([math.hypot(max(i - 30, 0), i + 1) for i in range(500)])


def test_repeated_texts_are_read_once(monkeypatch):
    seen, read = [], codecs._read_texts
    monkeypatch.setattr(codecs, "_read_texts", lambda c: (seen.append(len(c)), read(c))[1])
    texts = ["LINESTRING(0 0,30 0)", None, "POINT Z(1 2 3)", "POLYGON((0 0,1 0,1 1,0 0))"] * 50
    got = codecs.read_wkt(pa.array(texts))
    got.validate(full=True)
    assert seen == [3] and codecs.write_wkt(got).to_pylist() == texts
    assert decode(codecs.read_wkt(pa.array([None, None], pa.string()))) == [None, None]


def test_sql(spark):
    """Shapes of many segments, nulls and pairs of points among them."""
    register_all(spark)
    r = random.Random(5)
    many = [f"LINESTRING({text(chain(r, 120, x, 0, 0.3))})" for x in (0, 40)]
    shown = lambda: wkt.write(shape(r, False))
    rows = [(i, many[0] if i % 40 == 0 else None if i % 7 == 0 else shown(), many[1] if i % 40 == 0 else None if i % 11 == 0 else shown()) for i in range(300)]
    df = spark.createDataFrame(rows, "k INT, a STRING, b STRING").coalesce(1)
    got = dict(df.selectExpr("k", "st_distance(st_geomfromtext(a), st_geomfromtext(b)) d").collect())
    assert all(same(got[k], shapes.distance(wkt.read(a), wkt.read(b)) if a and b else None) for k, a, b in rows)
    (row,) = spark.sql("SELECT st_distance(st_point(0D, 9D), box2d(st_geomfromtext('LINESTRING(1 1,4 5)'))) a, st_distance(st_point(2D, 2D), box2d(st_geomfromtext('LINESTRING(1 1,4 5)'))) b").collect()
    assert row.a == pytest.approx(math.hypot(1, 4)) and row.b == 0


def test_many_rows_take_little_time(spark):
    """40,000 points to a constant line, and to a constant point, in one task."""
    register_all(spark)
    spark.sql("SELECT st_distance(st_point(1D, 2D), st_geomfromtext('LINESTRING(0 0,30 0)'))").collect()
    began = time.perf_counter()
    (row,) = spark.sql(
        "SELECT sum(st_distance(p, st_geomfromtext('LINESTRING(0 0,30 0)'))) a, sum(st_distance(p, st_point(0D, 0D))) b FROM (SELECT st_point(15D, CAST(id AS DOUBLE)) p FROM range(0, 40000, 1, 1))"
    ).collect()
    assert row.a == 40000 * 39999 / 2 and row.b == pytest.approx(sum(math.hypot(15, i) for i in range(40000)))
    assert time.perf_counter() - began < 12  # 3.6 s when written, 106.7 s pair by pair
