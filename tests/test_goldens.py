"""Known answers, one SQL expression each."""

import math

import pytest

from cartolith.register import register_all

LINE_Z = "st_geomfromtext('LINESTRING Z(1 2 3, 3 4 5, 5 6 7)')"
A = "st_geomfromtext('POLYGON ((40 170, 90 30, 180 100, 40 170))')"
WKT = "st_geomfromtext('{}')"


def g(text):
    return WKT.format(text)


VALUES = [
    ("st_area(st_geomfromtext('POLYGON((743238 2967416,743238 2967450,743265 2967450,743265.625 2967416,743238 2967416))'))", 928.625),
    (f"st_distance({g('POINT(-72.1235 42.3521)')}, {g('LINESTRING(-72.1260 42.45, -72.123 42.1546)')})", 0.00150567726382282),
    (f"st_distance({g('POINT EMPTY')}, {g('POINT(1 1)')})", None),
    (f"st_distance({g('POLYGON((0 0,4 0,4 4,0 4,0 0))')}, {g('POINT(1 1)')})", 0.0),
    (f"st_length({g('LINESTRING(0 0, 3 4)')})", 5.0),
    (f"st_length({g('MULTILINESTRING((0 0, 3 4), (0 0, 4 3))')})", 10.0),
    (f"st_length2d({g('POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))')})", 0.0),
    (f"st_x(st_centroid({g('MULTIPOINT ( -1 0, -1 2, -1 3, -1 4, -1 7, 0 1, 0 3, 1 1, 2 0, 6 0, 7 8, 9 8, 10 6 )')}))", 2.3076923076923075),
    (f"st_y(st_centroid({g('MULTIPOINT ( -1 0, -1 2, -1 3, -1 4, -1 7, 0 1, 0 3, 1 1, 2 0, 6 0, 7 8, 9 8, 10 6 )')}))", 3.3076923076923075),
    (f"st_astext(st_centroid({g('GEOMETRYCOLLECTION(POINT(9 9),POLYGON((0 0,2 0,2 2,0 2,0 0)))')}))", "POINT(1 1)"),
    (f"st_centroid({g('POLYGON EMPTY')})", None),
    ("st_geohash(st_point(-126D, 48D))", "c0w3hf1s70w3"),
    ("st_geohash(st_point(-126D, 48D), 5)", "c0w3h"),
    (f"st_geohash({g('LINESTRING(0 0,1 1)')})", None),
    ("st_astext(st_pointfromgeohash('9qqj'))", "POINT(-115.13671875 36.123046875)"),
    ("st_xmin(st_box2dfromgeohash('ww8p1r4t8'))", 112.55836486816406), ("st_ymin(st_box2dfromgeohash('ww8p1r4t8'))", 37.83236503601074),
    ("st_xmax(st_box2dfromgeohash('WW8P1R4T8'))", 112.5584077835083), ("st_ymax(st_box2dfromgeohash('ww8p1r4t8'))", 37.83240795135498),
    *((f"st_{e}({LINE_Z})", v) for e, v in zip(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), (1.0, 2.0, 3.0, 5.0, 6.0, 7.0), strict=True)),
    ("st_zmax(st_3dmakebox(st_pointz(0D,5D,1D), st_pointz(10D,20D,30D)))", 30.0),
    ("st_xmin(st_makebox2d(st_point(9D,5D), st_point(1D,20D)))", 9.0),
    ("st_xmin(st_expand(st_makebox2d(st_point(0D,5D), st_point(10D,20D)), 10D, 20D))", -10.0), ("st_ymax(st_expand(st_makebox2d(st_point(0D,5D), st_point(10D,20D)), 10D, 20D))", 40.0),
    ("st_z(st_pointm(1D,2D,3D))", None), ("st_m(st_pointm(1D,2D,3D))", 3.0), ("st_z(st_pointzm(1D,2D,3D,4D))", 3.0), ("st_m(st_pointzm(1D,2D,3D,4D))", 4.0),
    ("st_point(1D, NULL)", None), ("st_pointz(1D, 2D, NULL)", None), ("st_x(st_point(NULL, 2D))", None), (f"st_x({g('LINESTRING(0 0,1 1)')})", None), (f"st_x({g('POINT EMPTY')})", None),
    (f"st_startpoint({g('LINESTRING EMPTY')})", None), (f"st_endpoint({g('LINESTRING EMPTY')})", None), (f"st_xmin({g('POINT EMPTY')})", None), (f"box2d({g('POLYGON EMPTY')})", None),
    (f"st_npoints({g('LINESTRING(77.29 29.07,77.42 29.26,77.27 29.31,77.29 29.07)')})", 4), ("st_npoints(box2d(st_point(1D,1D)))", 4),
    (f"geometrytype({LINE_Z})", "LINESTRINGZ"), (f"st_geometrytype({g('MULTILINESTRING((0 0,1 1))')})", "ST_MultilineString"),
    (f"st_astext(st_simplify({g('LINESTRING(0.0 0.0, 5.0 4.0, 11.0 5.5, 17.3 3.2, 27.8 0.1)')}, 1D))", "LINESTRING(0 0,5 4,11 5.5,27.8 0.1)"),
    (f"st_astext(st_simplifyvw({g('LINESTRING(5 2, 3 8, 6 20, 7 25, 10 10)')}, 30D))", "LINESTRING(5 2,7 25,10 10)"),
    (f"st_intersects({g('POINT(0 0)')}, {g('LINESTRING ( 0 0, 0 2 )')})", True), (f"st_intersects({g('POINT(0 0)')}, {g('LINESTRING ( 2 0, 0 2 )')})", False),
    *((f"st_{p}({g('POINT (100 100)')}, {g('LINESTRING (30 50, 40 160, 160 40, 180 160)')})", v) for p, v in (("overlaps", False), ("crosses", False), ("intersects", True), ("within", True))),
    *((f"st_{p}({A}, {g('LINESTRING(10 10, 190 190)')})", v) for p, v in (("overlaps", False), ("crosses", True), ("intersects", True), ("within", False))),
    *((f"st_{p}({A}, {g('POLYGON ((110 180, 20 60, 130 90, 110 180))')})", v) for p, v in (("overlaps", True), ("crosses", False), ("intersects", True), ("within", False))),
    ("st_intersects(NULL, st_point(1D,1D))", None), ("st_contains(st_point(1D,1D), NULL)", None), (f"st_intersects({g('POINT EMPTY')}, st_point(1D,1D))", False), (f"st_equals({g('POINT EMPTY')}, {g('POINT EMPTY')})", True),
    *((f"st_isclosed({g(t)})", v) for t, v in (
        ("LINESTRING(0 0, 1 1, 0 1, 0 0)", True), ("LINESTRING(0 0, 0 0)", True), ("MULTILINESTRING((0 0, 1 1, 0 0), (2 2, 3 3, 2 2))", True), ("POINT(0 0)", True), ("MULTIPOINT(0 0, 1 1)", True),
        ("POLYGON((0 0, 1 0, 1 1, 0 0))", True), ("MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))", True), ("LINESTRING(0 0, 1 1, 1 0)", False), ("LINESTRING EMPTY", False), ("MULTILINESTRING EMPTY", False), ("MULTILINESTRING((0 0, 1 1, 0 0), (2 2, 3 3, 2 3))", False))),
    *((f"st_isempty({g(t)})", v) for t, v in (
        *((f"{k} EMPTY", True) for k in ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")), ("GEOMETRYCOLLECTION(POINT EMPTY, POLYGON EMPTY)", True),
        ("GEOMETRYCOLLECTION(MULTIPOINT EMPTY, MULTIPOLYGON EMPTY)", True), ("MULTILINESTRING(EMPTY, EMPTY)", True), ("POLYGON((1 2, 3 4, 5 6, 1 2))", False), ("GEOMETRYCOLLECTION(POINT(0 0), POLYGON EMPTY)", False), ("MULTILINESTRING(EMPTY, (0 0, 1 1))", False))),
    ("st_isempty(st_geomfromwkb(unhex('010400000000000000')))", True), ("st_isempty(st_geomfromwkb(unhex('0104000000020000000101000000000000000000f87f000000000000f87f010100000000000000000000000000000000000000')))", False),
    ("st_isempty(NULL)", None),
    *((f"st_astext(st_linemerge({g(t)}{d}))", v) for t, d, v in (
        ("MULTILINESTRING((10 160, 60 120), (120 140, 60 120), (120 140, 180 120))", "", "LINESTRING(10 160,60 120,120 140,180 120)"),
        ("MULTILINESTRING((10 160, 60 120), (120 140, 60 120), (120 140, 180 120), (100 180, 120 140))", "", "MULTILINESTRING((10 160,60 120,120 140),(100 180,120 140),(120 140,180 120))"),
        ("MULTILINESTRING((-29 -27,-30 -29.7,-36 -31,-45 -33),(-45.2 -33.2,-46 -32))", "", "MULTILINESTRING((-45.2 -33.2,-46 -32),(-29 -27,-30 -29.7,-36 -31,-45 -33))"),
        ("LINESTRING(0 0, 1 1)", "", "LINESTRING(0 0,1 1)"), ("POINT(0 0)", "", "GEOMETRYCOLLECTION EMPTY"), ("POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", "", "LINESTRING(0 0,1 0,1 1,0 1,0 0)"), ("LINESTRING EMPTY", "", "LINESTRING EMPTY"),
        ("MULTILINESTRING((60 30, 10 70), (120 50, 60 30), (120 50, 180 30))", ", true", "MULTILINESTRING((120 50,60 30,10 70),(120 50,180 30))"),
        ("MULTILINESTRING((60 30, 10 70), (120 50, 60 30), (120 50, 180 30))", ", false", "LINESTRING(180 30,120 50,60 30,10 70)"))),
    ("st_linemerge(NULL)", None),
    *((f"st_isvalidreason({g(t)})", v) for t, v in (
        ("POLYGON((0 0,1 1,1 0,0 1,0 0))", "Self-intersection"), ("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", "Valid Geometry"), ("POLYGON((0 0,4 0,4 4,0 4,0 0),(5 5,6 5,6 6,5 6,5 5))", "Hole lies outside shell"),
        ("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((1 1,2 1,2 2,1 2,1 1)))", "Nested shells"), ("POLYGON((0 0,4 0,4 4,0 4,0 0),(0 2,2 0,4 2,2 4,0 2))", "Interior is disconnected"))),
    (f"array_join(transform(st_dump({g('GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5))),POINT(5 5))')}), d -> array_join(d.path, '.')), ' ')", "1.1 1.2 2"),
    (f"array_join(transform(st_dump({g('GEOMETRYCOLLECTION(POINT(0 0), POLYGON EMPTY)')}), d -> concat(array_join(d.path, '.'), ':', d.geom.kind)), ' ')", "1:1 2:3"),
    (f"size(st_dump({g('GEOMETRYCOLLECTION(POINT EMPTY, POLYGON EMPTY)')}))", 0), ("st_dump(NULL)", None), (f"size(st_dump({g('LINESTRING(0 0,1 1)')})[0].path)", 0),
]


@pytest.fixture(scope="module")
def sql(spark):
    return register_all(spark)


def test_known_answers(sql):
    at = 0
    while at < len(VALUES):
        part = VALUES[at : at + 12]
        row = sql.sql("SELECT " + ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(part))).first()
        for (expression, want), got in zip(part, row, strict=True):
            if isinstance(want, float):
                assert got is not None and math.isclose(got, want, rel_tol=1e-12), (expression, got, want)
            else:
                assert got == want, (expression, got, want)
        at += 12


@pytest.mark.parametrize("expression", ["st_geomfromtext('POINT(1)')", "st_geomfromtext('NOPE(1 2)')", "st_geomfromwkb(unhex('0101'))", "st_pointfromgeohash('9a')", "st_geohash(st_point(500D, 0D))"])
def test_malformed_input_is_an_error(sql, expression):
    with pytest.raises(Exception):  # noqa: B017
        sql.sql(f"SELECT {expression} AS v").collect()


def test_aliases_are_registered(sql):
    for name in ("st_numpoints", "st_numinteriorring", "st_length2d", "st_geometryfromtext", "st_wkttosql", "st_wkbtosql", "st_extent"):
        assert sql.sql(f"SHOW USER FUNCTIONS LIKE '{name}'").count() == 1


def test_expressions_stay_in_the_jvm(sql):
    plan = sql.sql("SELECT st_area(box2d(st_point(id, id))), st_x(st_centroid(st_makebox2d(st_point(id, 1), st_point(2, id)))) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
