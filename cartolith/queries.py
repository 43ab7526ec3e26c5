"""Queries over the test tables, each beside its plain SQL.

Tables have no geometries, so these are made of their numbers. ``{name}`` stands for a table.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as st
from .operators import dump_rows, spatial_join
from .plans import spatial_filter
from .register import register_all
from .sources import copy_to, read_flatgeobuf, read_geojson, read_geoparquet, register_table, write_flatgeobuf, write_geojsonl, write_geoparquet
from .streaming import windowed_extent

_TABLE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events)\}")

_CUSTOMER = "SELECT c_custkey k, c_nationkey n, CAST(c_custkey % 50 AS DOUBLE) + 0.5 x, CAST((c_custkey div 50) % 50 AS DOUBLE) + 0.5 y FROM {customer}"
_CUSTOMER_DUCK = "SELECT c_custkey k, c_nationkey n, (c_custkey % 50)::DOUBLE + 0.5 x, ((c_custkey // 50) % 50)::DOUBLE + 0.5 y FROM customer"
_RECT = "st_geomfromtext('POLYGON((10 10,30 10,30 25.5,10 25.5,10 10))')"
_PART_RECT = "st_geomfromtext(concat('POLYGON((0 0,', p_size, ' 0,', p_size, ' ', p_partkey % 17 + 1, ',0 ', p_partkey % 17 + 1, ',0 0))'))"
_KINDS = [
    "POINT(1 2)", "LINESTRING(0 0,1 1,0 1,0 0)", "POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 2,1 1),(4 4,5 4,5 5,4 5,4 4))", "MULTIPOINT((0 0),(1 1),(2 2))",
    "MULTILINESTRING((0 0,1 1),(2 2,3 3,4 5))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION(POINT(0 0),POLYGON EMPTY)", "LINESTRING EMPTY", "POINT Z(1 2 3)", "POINT M(1 2 3)",
]
_KIND_SQL = f"st_geomfromtext(element_at(array({', '.join(repr(k) for k in _KINDS)}), CAST(p_partkey % {len(_KINDS)} AS INT) + 1))"


def _case(*values, of: str = f"p_partkey % {len(_KINDS)}") -> str:
    """A CASE over the kinds of _KINDS."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _text(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


_B32 = "0123456789bcdefghjkmnpqrstuvwxyz"

#: name -> (Spark SQL, DuckDB SQL)
SQL: dict[str, tuple[str, str]] = {
    # a square and one point inside it, nearest to the lower edge, which is dug in to it
    "concave_hull": (
        "SELECT k, round(st_area(st_concavehull(g, 0D)), 6) dug, round(st_area(st_concavehull(g, 1D)), 6) whole, st_npoints(st_concavehull(g, 0D)) n FROM (SELECT p_partkey k, "
        "st_geomfromtext(concat('MULTIPOINT((0 0),(10 0),(10 10),(0 10),(5 ', p_partkey % 4 + 1, '))')) g FROM {part})",
        "SELECT p_partkey k, 100.0::DOUBLE - 5 * (p_partkey % 4 + 1) dug, 100.0::DOUBLE whole, 6 n FROM part",
    ),
    # grids in the form of an L, one cell wide: the triangles in its notch all have longer outer edges than its cells
    "concave_hull_of_grids": (
        "SELECT k, round(st_area(st_concavehull(g, 0.02D)), 6) dug, round(st_area(st_concavehull(g, 1D)), 6) whole, st_npoints(st_concavehull(g, 0.02D)) n FROM (SELECT s_suppkey k, "
        "st_geomfromtext(concat('MULTIPOINT(', array_join(transform(filter(sequence(0, (a + 1) * (b + 1) - 1), i -> i % (a + 1) < 2 OR i div (a + 1) < 2), i -> concat(i % (a + 1), ' ', i div (a + 1))), ','), ')')) g "
        "FROM (SELECT s_suppkey, CAST(s_suppkey % 6 + 3 AS INT) a, CAST(s_suppkey % 5 + 3 AS INT) b FROM {supplier}))",
        "SELECT s_suppkey k, (a + b - 1)::DOUBLE dug, a * b - (a - 1) * (b - 1) / 2.0::DOUBLE whole, (2 * a + 2 * b + 1)::INT n FROM (SELECT s_suppkey, s_suppkey % 6 + 3 a, s_suppkey % 5 + 3 b FROM supplier)",
    ),
    # the triangle of the second point has an area of 2.5, that of the third one of 45
    "preserve_topology": (
        "SELECT k, st_astext(st_simplifypreservetopology(g, 3D)) t, st_astext(st_simplifypreservetopology(g, 1D)) u, st_npoints(st_simplifypreservetopology(r, 1000D)) n FROM (SELECT n_nationkey k, "
        "st_geomfromtext(concat('LINESTRING(0 0,5 0.5,10 0,', n_nationkey + 20, ' 9)')) g, st_geomfromtext('POLYGON((0 0,4 0,8 0,8 8,4 9,0 8,0 0))') r FROM {nation})",
        "SELECT n_nationkey k, 'LINESTRING(0 0,10 0,' || (n_nationkey + 20) || ' 9)' t, 'LINESTRING(0 0,5 0.5,10 0,' || (n_nationkey + 20) || ' 9)' u, 4 n FROM nation",
    ),
    # a ring, a bow tie, a hole inside and a hole outside, of the sizes of the table
    "valid_shapes": (
        "SELECT k, st_isvalid(g) v, st_isvalidreason(g) = 'Valid Geometry' r FROM (SELECT p_partkey k, st_geomfromtext(concat('POLYGON(', CASE p_partkey % 4 WHEN 0 THEN concat('(0 0,', s, ' 0,', s, ' ', s, ',0 ', s, ',0 0)') "
        "WHEN 1 THEN concat('(0 0,', s, ' ', s, ',', s, ' 0,0 ', s, ',0 0)') WHEN 2 THEN concat('(-1 -1,', s, ' -1,', s, ' ', s, ',-1 ', s, ',-1 -1),(0 0,0.5 0,0.5 0.5,0 0.5,0 0)') "
        "ELSE concat('(0 0,', s, ' 0,', s, ' ', s, ',0 ', s, ',0 0),(-3 -3,-2 -3,-2 -2,-3 -2,-3 -3)') END, ')')) g FROM (SELECT *, p_size + 1 s FROM {part}))",
        "SELECT p_partkey k, p_partkey % 4 IN (0, 2) v, p_partkey % 4 IN (0, 2) r FROM part",
    ),
    "st_point_xy": (
        "SELECT k, st_x(p) x, st_y(p) y, st_z(p) z, p.srid srid FROM (SELECT c_custkey k, st_point(c_acctbal, CAST(c_custkey AS DOUBLE), 4326) p FROM {customer})",
        "SELECT c_custkey k, c_acctbal x, c_custkey::DOUBLE y, NULL::DOUBLE z, 4326 srid FROM customer",
    ),
    "st_point_zm": (
        "SELECT l_orderkey, l_linenumber, st_x(p) x, st_z(p) z, st_m(p) m, st_z(q) qz, st_m(q) qm, st_z(r) rz, st_m(r) rm, st_coorddim(p) d, st_ndims(r) nd FROM (SELECT l_orderkey, l_linenumber, "
        "st_pointzm(l_quantity, l_extendedprice, l_discount, l_tax) p, st_pointz(l_quantity, l_extendedprice, l_discount) q, st_pointm(l_quantity, l_extendedprice, l_tax) r FROM {lineitem})",
        "SELECT l_orderkey, l_linenumber, l_quantity x, l_discount z, l_tax m, l_discount qz, NULL::DOUBLE qm, NULL::DOUBLE rz, l_tax rm, 4 d, 3 nd FROM lineitem",
    ),
    "st_makepoint": (
        "SELECT s_suppkey k, geometrytype(a) ta, geometrytype(b) tb, geometrytype(c) tc, geometrytype(d) td, st_z(b) z, st_m(c) m, st_m(d) md FROM (SELECT s_suppkey, st_makepoint(s_acctbal, 1D) a, "
        "st_makepoint(s_acctbal, 1D, 2D) b, st_makepoint(s_acctbal, 1D, 2D, 3D) c, st_makepointm(s_acctbal, 1D, 4D) d FROM {supplier})",
        "SELECT s_suppkey k, 'POINT' ta, 'POINTZ' tb, 'POINTZM' tc, 'POINTM' td, 2.0::DOUBLE z, 3.0::DOUBLE m, 4.0::DOUBLE md FROM supplier",
    ),
    "geometry_types": (
        f"SELECT k, geometrytype(g) t, st_geometrytype(g) st FROM (SELECT p_partkey k, {_KIND_SQL} g FROM {{part}})",
        "SELECT p_partkey k, " + _case(*_text("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "LINESTRING", "POINTZ", "POINTM")) + " t, "
        + _case(*_text("ST_Point", "ST_LineString", "ST_Polygon", "ST_MultiPoint", "ST_MultilineString", "ST_MultiPolygon", "ST_GeometryCollection", "ST_LineString", "ST_Point", "ST_Point")) + " st FROM part",
    ),
    "accessors": (
        f"SELECT k, st_npoints(g) n, st_numpoints(g) n2, coalesce(st_numinteriorrings(g), -1) r, coalesce(st_numinteriorring(g), -1) r2, st_isclosed(g) c, st_isempty(g) e, st_coorddim(g) d FROM (SELECT p_partkey k, {_KIND_SQL} g FROM {{part}})",
        "SELECT p_partkey k, " + _case(1, 4, 15, 3, 5, 8, 1, 0, 1, 1) + " n, " + _case(1, 4, 15, 3, 5, 8, 1, 0, 1, 1) + " n2, " + _case(-1, -1, 2, *[-1] * 7) + " r, " + _case(-1, -1, 2, *[-1] * 7) + " r2, "
        + _case("true", "true", "true", "true", "false", "true", "false", "false", "true", "true") + " c, " + _case(*["false"] * 7, "true", "false", "false") + " e, " + _case(*[2] * 8, 3, 3) + " d FROM part",
    ),
    "astext": (
        f"SELECT k, st_astext(g) t, st_astext(st_geometryfromtext(st_astext(g))) t2, st_astext(st_wkttosql(st_astext(g))) t3 FROM (SELECT p_partkey k, {_KIND_SQL} g FROM {{part}})",
        "SELECT p_partkey k, " + ", ".join(_case(*_text(*_KINDS)) + f" {n}" for n in ("t", "t2", "t3")) + " FROM part",
    ),
    "asbinary": (
        "SELECT c_custkey k, hex(st_asbinary(st_point(CAST(c_custkey AS DOUBLE), CAST(c_nationkey AS DOUBLE)))) w FROM {customer}",
        "SELECT c_custkey k, hex(st_asbinary(('POINT(' || c_custkey || ' ' || c_nationkey || ')')::GEOMETRY)) w FROM customer",
    ),
    "wkb_round_trip": (
        f"SELECT k, st_astext(st_geomfromwkb(st_asbinary(g))) t, st_astext(st_wkbtosql(st_asbinary(g))) t2 FROM (SELECT p_partkey k, {_KIND_SQL} g FROM {{part}})",
        "SELECT p_partkey k, " + _case(*_text(*_KINDS)) + " t, " + _case(*_text(*_KINDS)) + " t2 FROM part",
    ),
    "asgeojson": (
        "SELECT k, st_asgeojson(st_point(x, y)) j, st_astext(st_geomfromgeojson(st_asgeojson(st_point(x, y)))) t FROM (" + _CUSTOMER + ")",
        "SELECT k, '{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ']}' j, 'POINT(' || x || ' ' || y || ')' t FROM (" + _CUSTOMER_DUCK + ")",
    ),
    "line_points": (
        "SELECT k, st_x(st_startpoint(g)) sx, st_y(st_endpoint(g)) ey, st_x(st_pointn(g, 2)) x2, st_x(st_pointn(g, -1)) xl, st_x(st_startpoint(st_point(1D, 1D))) no FROM (SELECT o_orderkey k, "
        "st_geomfromtext(concat('LINESTRING(', o_custkey, ' 0,5 7,', o_orderkey, ' ', o_orderkey % 10, ')')) g FROM {orders})",
        "SELECT o_orderkey k, o_custkey::DOUBLE sx, (o_orderkey % 10)::DOUBLE ey, 5.0::DOUBLE x2, o_orderkey::DOUBLE xl, NULL::DOUBLE no FROM orders",
    ),
    "st_dump": (
        "SELECT k, array_join(d.path, '.') path, st_x(d.geom) x, geometrytype(d.geom) t FROM (SELECT k, explode(parts) d FROM (SELECT p_partkey k, st_dump(st_geomfromtext(concat('MULTIPOINT(', array_join(transform(sequence(1, p_size % 5 + 1), i -> concat(i, ' ', p_size)), ','), ')'))) parts FROM {part}))",
        "SELECT k, i::VARCHAR path, i::DOUBLE x, 'POINT' t FROM (SELECT p_partkey k, unnest(range(1, p_size % 5 + 2)) i FROM part)",
    ),
    "extremes": (
        "SELECT k, st_xmin(g) x0, st_ymin(g) y0, st_zmin(g) z0, st_xmax(g) x1, st_ymax(g) y1, st_zmax(g) z1, st_xmax(box2d(g)) bx, st_zmax(box2d(g)) bz, st_zmin(box3d(g)) cz, st_npoints(box3d(g)) n FROM "
        "(SELECT o_orderkey k, st_geomfromtext(concat('LINESTRING Z(', o_custkey, ' 0 3,5 7 1,', o_orderkey, ' -1 2)')) g FROM {orders})",
        "SELECT o_orderkey k, least(o_custkey, 5, o_orderkey)::DOUBLE x0, -1.0::DOUBLE y0, 1.0::DOUBLE z0, greatest(o_custkey, 5, o_orderkey)::DOUBLE x1, 7.0::DOUBLE y1, 3.0::DOUBLE z1, greatest(o_custkey, 5, o_orderkey)::DOUBLE bx, NULL::DOUBLE bz, 1.0::DOUBLE cz, 4 n FROM orders",
    ),
    "make_boxes": (
        "SELECT k, st_xmin(b) x0, st_ymax(b) y1, st_area(b) a, st_zmax(c) z1 FROM (SELECT n_nationkey k, st_makebox2d(st_point(n_nationkey * 1D, 0D), st_point(n_nationkey + 2D, 3D)) b, st_3dmakebox(st_pointz(0D, 0D, 1D), st_pointz(1D, 1D, n_nationkey + 5D)) c FROM {nation})",
        "SELECT n_nationkey k, n_nationkey::DOUBLE x0, 3.0::DOUBLE y1, 6.0::DOUBLE a, n_nationkey + 5.0::DOUBLE z1 FROM nation",
    ),
    "envelope_expand": (
        "SELECT k, st_astext(st_envelope(g)) e, st_xmin(st_expand(g, 2D)) x0, st_ymax(st_expand(g, 2D, 3D)) y1 FROM (SELECT n_nationkey k, st_geomfromtext(concat('LINESTRING(0 0,', n_nationkey + 1, ' 4,1 1)')) g FROM {nation})",
        "SELECT n_nationkey k, 'POLYGON((0 0,0 4,' || (n_nationkey + 1) || ' 4,' || (n_nationkey + 1) || ' 0,0 0))' e, -2.0::DOUBLE x0, 7.0::DOUBLE y1 FROM nation",
    ),
    "st_area": (f"SELECT p_partkey k, round(st_area({_PART_RECT}), 6) a FROM {{part}}", "SELECT p_partkey k, (p_size * (p_partkey % 17 + 1))::DOUBLE a FROM part"),
    "st_length": (
        "SELECT k, round(st_length(g), 6) l, round(st_length2d(g), 6) l2, st_length(st_point(1D, 1D)) p FROM (SELECT p_partkey k, st_geomfromtext(concat('LINESTRING(0 0,', p_size, ' ', p_partkey % 7, ',', p_size, ' 100)')) g FROM {part})",
        "SELECT p_partkey k, round(sqrt(p_size * p_size + (p_partkey % 7) * (p_partkey % 7)) + 100 - p_partkey % 7, 6) l, round(sqrt(p_size * p_size + (p_partkey % 7) * (p_partkey % 7)) + 100 - p_partkey % 7, 6) l2, 0.0::DOUBLE p FROM part",
    ),
    "st_distance": (
        "SELECT k, round(st_distance(st_point(x, y), st_point(10D, 20D)), 6) pp, round(st_distance(st_point(x, y), st_geomfromtext('LINESTRING(0 0,30 0)')), 6) ps FROM (" + _CUSTOMER + ")",
        "SELECT k, round(sqrt((x - 10) ** 2 + (y - 20) ** 2), 6) pp, round(sqrt((x - least(greatest(x, 0), 30)) ** 2 + y ** 2), 6) ps FROM (" + _CUSTOMER_DUCK + ")",
    ),
    "st_centroid": (
        f"SELECT p_partkey k, round(st_x(st_centroid({_PART_RECT})), 6) x, round(st_y(st_centroid({_PART_RECT})), 6) y, round(st_x(st_centroid(st_geomfromtext(concat('MULTIPOINT(0 0,', p_size, ' 3,1 3)')))), 6) mx, st_x(st_centroid(st_geomfromtext('LINESTRING(0 0,8 0)'))) lx FROM {{part}}",
        "SELECT p_partkey k, round(p_size / 2.0, 6)::DOUBLE x, round((p_partkey % 17 + 1) / 2.0, 6)::DOUBLE y, round((p_size + 1) / 3.0::DOUBLE, 6) mx, 4.0::DOUBLE lx FROM part",
    ),
    "hulls": (
        "SELECT k, round(st_area(st_convexhull(g)), 6) a, round(st_area(st_orientedenvelope(g)), 6) o, round(st_area(st_concavehull(g, 1D)), 6) c, st_covers(st_convexhull(g), st_pointonsurface(st_convexhull(g))) s FROM "
        "(SELECT p_partkey k, st_geomfromtext(concat('MULTIPOINT(0 0,', p_size + 1, ' 0,', p_size + 1, ' 5,0 5,1 1)')) g FROM {part})",
        "SELECT p_partkey k, 5.0 * (p_size + 1)::DOUBLE a, 5.0 * (p_size + 1)::DOUBLE o, 5.0 * (p_size + 1)::DOUBLE c, true s FROM part",
    ),
    "simplify": (
        "SELECT k, st_astext(st_simplify(g, 1D)) dp, st_astext(st_simplifyvw(v, 30D)) vw, st_npoints(st_simplifypreservetopology(g, 0D)) p FROM (SELECT n_nationkey k, st_geomfromtext(concat('LINESTRING(0 0,5 0.5,10 0,', n_nationkey + 20, ' 9)')) g, st_geomfromtext('LINESTRING(5 2,3 8,6 20,7 25,10 10)') v FROM {nation})",
        "SELECT n_nationkey k, 'LINESTRING(0 0,10 0,' || (n_nationkey + 20) || ' 9)' dp, 'LINESTRING(5 2,7 25,10 10)' vw, 4 p FROM nation",
    ),
    "st_linemerge": (
        "SELECT k, st_astext(st_linemerge(st_geomfromtext(concat('MULTILINESTRING((0 0,1 1),(', k, ' 9,1 1))')))) u, st_astext(st_linemerge(st_geomfromtext('MULTILINESTRING((60 30,10 70),(120 50,60 30),(120 50,180 30))'), true)) d FROM (SELECT n_nationkey + 2 k FROM {nation})",
        "SELECT n_nationkey + 2 k, 'LINESTRING(0 0,1 1,' || (n_nationkey + 2) || ' 9)' u, 'MULTILINESTRING((120 50,60 30,10 70),(120 50,180 30))' d FROM nation",
    ),
    "point_in_rectangle": (
        f"SELECT k, st_intersects({_RECT}, p) i, st_disjoint({_RECT}, p) d, st_contains({_RECT}, p) c, st_within(p, {_RECT}) w, st_covers({_RECT}, p) v, st_coveredby(p, {_RECT}) cb, st_touches(p, {_RECT}) t, st_equals(p, {_RECT}) e, st_crosses(p, {_RECT}) x, st_overlaps(p, {_RECT}) o, st_contains(p, {_RECT}) rev "
        "FROM (SELECT k, st_point(x - 0.5, y) p FROM (" + _CUSTOMER + "))",
        "SELECT k, inside OR edge i, NOT (inside OR edge) d, inside c, inside w, inside OR edge v, inside OR edge cb, edge t, false e, false x, false o, false rev FROM (SELECT k, x > 10 AND x < 30 AND y > 10 AND y < 25.5 inside, "
        "x BETWEEN 10 AND 30 AND y BETWEEN 10 AND 25.5 AND NOT (x > 10 AND x < 30 AND y > 10 AND y < 25.5) edge FROM (SELECT k, x - 0.5 x, y FROM (" + _CUSTOMER_DUCK + ")))",
    ),
    "rectangle_pairs": (
        "SELECT k, st_intersects(a, b) i, st_overlaps(a, b) o, st_equals(a, b) e, st_touches(a, b) t, st_contains(a, b) c, st_within(a, b) w, st_covers(a, b) v, st_disjoint(a, b) d, st_relate(a, a) r FROM (SELECT p_partkey k, st_geomfromtext('POLYGON((0 0,10 0,10 5,0 5,0 0))') a, "
        "st_geomfromtext(concat('POLYGON((', x, ' 0,', x + w, ' 0,', x + w, ' 5,', x, ' 5,', x, ' 0))')) b FROM (SELECT p_partkey, p_partkey % 13 x, p_size % 10 + 1 w FROM {part}))",
        "SELECT k, x <= 10 i, x < 10 AND (x > 0 OR w <> 10) AND x + w > 10 o, x = 0 AND w = 10 e, x = 10 t, x + w <= 10 c, x = 0 AND w = 10 w, x + w <= 10 v, x > 10 d, '2FFF1FFF2' r FROM (SELECT p_partkey k, p_partkey % 13 x, p_size % 10 + 1 w FROM part)",
    ),
    "line_crosses": (
        "SELECT k, st_crosses(l, r) c, st_intersects(l, r) i, st_touches(l, r) t, st_within(l, r) w FROM (SELECT p_partkey k, st_geomfromtext(concat('LINESTRING(', p_size % 12, ' 1,', p_size % 12 + 3, ' 1)')) l, st_geomfromtext('POLYGON((5 0,10 0,10 5,5 5,5 0))') r FROM {part})",
        "SELECT p_partkey k, (x < 5 AND x + 3 > 5) OR (x < 10 AND x + 3 > 10) c, x + 3 >= 5 AND x <= 10 i, x + 3 = 5 OR x = 10 t, x >= 5 AND x + 3 <= 10 w FROM (SELECT *, p_size % 12 x FROM part)",
    ),
    "validity": (
        "SELECT k, st_isvalid(g) v, st_isvalidreason(g) r FROM (SELECT n_nationkey k, st_geomfromtext(IF(n_nationkey % 2 = 0, concat('POLYGON((0 0,', n_nationkey + 1, ' 0,1 1,0 0))'), 'POLYGON((0 0,1 1,1 0,0 1,0 0))')) g FROM {nation})",
        "SELECT n_nationkey k, n_nationkey % 2 = 0 v, CASE WHEN n_nationkey % 2 = 0 THEN 'Valid Geometry' ELSE 'Self-intersection' END r FROM nation",
    ),
    "st_geohash": (
        "SELECT c_custkey k, st_geohash(st_point(CAST(c_custkey * 37 % 360 - 180 AS DOUBLE), CAST(c_custkey * 17 % 180 - 90 AS DOUBLE))) h FROM {customer}",
        f"""WITH p AS (SELECT c_custkey k, least(floor((c_custkey * 37 % 360) / 360.0::DOUBLE * 1073741824)::BIGINT, 1073741823) lon, least(floor((c_custkey * 17 % 180) / 180.0::DOUBLE * 1073741824)::BIGINT, 1073741823) lat FROM customer)
SELECT k, array_to_string(list_transform(range(0, 12), lambda i: substr('{_B32}', 1 + list_sum(list_transform(range(0, 5), lambda j: (((CASE WHEN (5 * i + j) % 2 = 0 THEN lon ELSE lat END) >> (29 - (5 * i + j) // 2)::INTEGER) & 1) << (4 - j)::INTEGER))::INTEGER, 1)), '') h FROM p""",
    ),
    "geohash_cells": (
        "SELECT k, abs(st_x(c) - x) <= (st_xmax(b) - st_xmin(b)) / 2 cx, st_ymin(b) <= y AND y <= st_ymax(b) cy, st_x(st_pointfromgeohash('9qqj')) gx FROM (SELECT k, x, y, st_pointfromgeohash(h) c, st_box2dfromgeohash(h) b FROM (SELECT k, x, y, st_geohash(st_point(x, y), 7) h FROM (" + _CUSTOMER + ")))",
        "SELECT k, true cx, true cy, -115.13671875::DOUBLE gx FROM (" + _CUSTOMER_DUCK + ")",
    ),
    "cte_values_order": (
        "WITH v(k, w) AS (VALUES (1, 'MULTILINESTRING((0 0,1 1),(1 1,2 2))'), (2, CAST(NULL AS STRING)), (CAST(NULL AS INT), 'LINESTRING(5 5,6 6)')) SELECT coalesce(k, -1) k, st_astext(st_linemerge(st_geomfromtext(w))) t FROM v ORDER BY k NULLS LAST LIMIT 3",
        "SELECT * FROM (VALUES (1, 'LINESTRING(0 0,1 1,2 2)'), (2, NULL), (-1, 'LINESTRING(5 5,6 6)')) v(k, t)",
    ),
    "nearest_by_nation": (
        "SELECT n, s, r, round(d, 6) d FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, s) r FROM (SELECT n_nationkey n, s_suppkey s, st_distance(st_point(n_nationkey % 5 * 10D, 7D), st_point(s_suppkey % 50 * 1D, s_nationkey * 1D)) d "
        "FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey)) WHERE r <= 3",
        "SELECT n, s, r::INTEGER r, round(d, 6) d FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, s) r FROM (SELECT n_nationkey n, s_suppkey s, sqrt((n_nationkey % 5 * 10 - s_suppkey % 50) ** 2 + (7 - s_nationkey) ** 2) d FROM supplier JOIN nation ON s_nationkey = n_nationkey)) WHERE r <= 3",
    ),
    "path_length_by_user": (
        "SELECT u, round(sum(st_distance(p, q)), 3) l, count(*) n FROM (SELECT user_id u, p, lag(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) q FROM (SELECT user_id, ts, event_id, st_point(event_id % 100 * 1D, value) p FROM {events})) GROUP BY u",
        "SELECT u, round(sum(sqrt((x - qx) ** 2 + (y - qy) ** 2)), 3) l, count(*) n FROM (SELECT user_id u, x, y, lag(x) OVER w qx, lag(y) OVER w qy FROM (SELECT user_id, ts, event_id, (event_id % 100)::DOUBLE x, value y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY u",
    ),
    "extent_rollup": (
        "SELECT coalesce(m, '-') m, coalesce(n, -1) n, min(st_xmin(p)) x0, max(st_ymax(p)) y1, count(*) c FROM (SELECT c_mktsegment m, c_nationkey n, st_point(c_acctbal, c_custkey * 1D) p FROM {customer}) GROUP BY ROLLUP (m, n)",
        "SELECT coalesce(m, '-') m, coalesce(n, -1) n, min(x) x0, max(y) y1, count(*) c FROM (SELECT c_mktsegment m, c_nationkey n, c_acctbal x, c_custkey::DOUBLE y FROM customer) GROUP BY ROLLUP (m, n)",
    ),
    "set_operations": (
        "SELECT t FROM (SELECT st_astext(st_point(s_suppkey % 50 * 1D, s_nationkey * 1D)) t FROM {supplier} UNION SELECT st_astext(st_point(n_nationkey * 1D, n_regionkey * 1D)) FROM {nation}) EXCEPT SELECT st_astext(st_point(n_nationkey * 1D, 1D)) FROM {nation}",
        "SELECT t FROM (SELECT 'POINT(' || (s_suppkey % 50) || ' ' || s_nationkey || ')' t FROM supplier UNION SELECT 'POINT(' || n_nationkey || ' ' || n_regionkey || ')' FROM nation) EXCEPT SELECT 'POINT(' || n_nationkey || ' 1)' FROM nation",
    ),
    "st_extent_sql": (
        "SELECT n, e.xmin x0, e.ymin y0, e.xmax x1, e.ymax y1 FROM (SELECT n, st_extent(st_point(x, y)) e FROM (" + _CUSTOMER + ") GROUP BY n)",
        "SELECT n, min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM (" + _CUSTOMER_DUCK + ") GROUP BY n",
    ),
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_all(spark)
        return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))

    return run


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(_CUSTOMER)(spark, sf_dir).select("k", "n", st.st_point("x", "y").alias("p"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    x, y = (F.col("n_nationkey") % 5 * 10).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double") * 10
    return nation.select("n_nationkey", st.st_makebox2d(st.st_point(x, y), st.st_point(x + 10, y + 10)).alias("cell"))


def extent_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: extents of customers by nation, by built-in aggregates."""
    e = _customers(spark, sf_dir).groupBy("n").agg(F.count("*").alias("customers"), st.extent("p").alias("e"))
    area = (F.col("e.xmax") - F.col("e.xmin")) * (F.col("e.ymax") - F.col("e.ymin"))
    return e.select("n", "customers", "e.xmin", "e.ymin", "e.xmax", "e.ymax", F.round(area, 6).alias("area"))


def join_customers_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = spatial_join(_customers(spark, sf_dir), _cells(spark, sf_dir), "p", "cell")
    return met.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.sum("k").alias("keys"))


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = _cells(spark, sf_dir).where("n_nationkey < 12")
    return spatial_join(_customers(spark, sf_dir), few, "p", "cell", "within", "left_anti").select("k")


def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = _cells(spark, sf_dir).where("n_nationkey < 12")
    return spatial_join(_customers(spark, sf_dir), few, "p", "cell", "within", "left").select("k", "n_nationkey")


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = _cells(spark, sf_dir).where("n_nationkey < 12")
    return spatial_join(_customers(spark, sf_dir), few, "p", "cell", "within", "left_semi").select("k")


def filter_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_filter(_customers(spark, sf_dir), "p", "POLYGON((10 10,30 10,30 25.5,10 25.5,10 10))", "within").select("k")


def literal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal and column in both orders of an asymmetric predicate."""
    box = st.geom_lit("POLYGON((10 10,30 10,30 25.5,10 25.5,10 10))")
    return _customers(spark, sf_dir).select("k", st.st_contains(box, "p").alias("a"), st.st_contains("p", box).alias("b"), st.st_within("p", box).alias("c"), st.st_coveredby(box, "p").alias("d"))


def dumped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _sql("SELECT n_nationkey k, st_geomfromtext(concat('GEOMETRYCOLLECTION(MULTIPOINT(0 0,', n_nationkey, ' 1),POINT(5 5))')) g FROM {nation}")(spark, sf_dir)
    return dump_rows(lines, "g").select("k", F.array_join("path", ".").alias("path"), st.st_astext("geom").alias("t"))


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cartolith-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("id"), "s_name", "s_acctbal", st.st_point((F.col("s_suppkey") % 50).cast("double"), F.col("s_nationkey").cast("double")).alias("geometry"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), "s_name", "s_acctbal", st.st_astext("geometry").alias("t"))


def geoparquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "geoparquet")
    write_geoparquet(_suppliers(spark, sf_dir), path, srid=4326)
    return _shown(read_geoparquet(spark, path, bbox=(0.0, 5.0, 30.0, 20.0)))


def geoparquet_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwritten, then appended to, then read by a box."""
    path, s = _folder(spark, "geoparquet"), _suppliers(spark, sf_dir)
    write_geoparquet(s, path)
    write_geoparquet(s.where("id % 2 = 0"), path, mode="overwrite")
    write_geoparquet(s.where("id % 2 = 1"), path, mode="append")
    return _shown(read_geoparquet(spark, path, bbox=(0.0, 0.0, 20.0, 20.0)))


def flatgeobuf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "flatgeobuf")
    write_flatgeobuf(_suppliers(spark, sf_dir), path)
    return _shown(read_flatgeobuf(spark, path, bbox=(0.0, 5.0, 30.0, 20.0)))


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers from FlatGeobuf files of a quarter of a megabyte, in the order of a curve over their extent."""
    path = _folder(spark, "flatgeobuf")
    write_flatgeobuf(_customers(spark, sf_dir), path, file_bytes=1 << 18)
    return read_flatgeobuf(spark, path, boxes=True)


def flatgeobuf_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on boxes, which leave features unfetched, and on a property, after which geometries are decoded."""
    c = _customer_files(spark, sf_dir).where("bbox.xmin <= 20 AND bbox.xmax >= 10 AND bbox.ymin < 30 AND n > 3")
    return c.select("k", "n", st.st_x("geometry").alias("x"), st.st_y("geometry").alias("y"))


def flatgeobuf_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property and the boxes; no geometry is decoded."""
    return _customer_files(spark, sf_dir).groupBy("n").agg(F.count("*").alias("customers"), F.min("bbox.xmin").alias("xmin"), F.max("bbox.ymax").alias("ymax"))


def flatgeobuf_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwritten, then appended to, then read by a shape."""
    path, s = _folder(spark, "flatgeobuf"), _suppliers(spark, sf_dir)
    write_flatgeobuf(s, path)
    write_flatgeobuf(s.where("id % 2 = 0"), path, mode="overwrite")
    write_flatgeobuf(s.where("id % 2 = 1"), path, mode="append")
    return _shown(read_flatgeobuf(spark, path, intersects="POLYGON((0 0,20 0,20 20,0 20,0 0))"))


def tables_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied from SQL to a path of each format, and read from there by SQL."""
    name = "suppliers_" + uuid.uuid4().hex
    _suppliers(spark, sf_dir).createOrReplaceTempView(name)
    parts = []
    for extension in ("fgb", "geojsonl", "parquet"):
        path = f"{_folder(spark, 'tables')}/suppliers.{extension}"
        copy_to(spark, f"SELECT id, s_name, geometry FROM {name} WHERE id % 3 > 0", path)
        copy_to(spark, f"SELECT id, s_name, geometry FROM {name} WHERE id % 3 = 0", path, mode="append")
        register_table(spark, f"{name}_{extension}", path)
        parts.append(f"SELECT '{extension}' extension, CAST(id AS BIGINT) id, s_name, st_astext(geometry) t FROM {name}_{extension}")
    return spark.sql(" UNION ALL ".join(parts))


def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "geojson")
    write_geojsonl(_suppliers(spark, sf_dir), path)
    return _shown(read_geojson(spark, path, "s_name string, s_acctbal double"))


def window_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", st.st_point(F.col("user_id").cast("double"), "value").alias("p"))
    w = windowed_extent(events, "ts", "p", "1 day")
    return w.select(F.col("window.start").cast("string").alias("day"), "n", "extent.xmin", "extent.xmax", F.round("extent.ymin", 6).alias("ymin"), F.round("extent.ymax", 6).alias("ymax"))


_POINTS = "SELECT k, n, x, y FROM (" + _CUSTOMER_DUCK + ")"
_ROUND_TRIP = "SELECT s_suppkey id, s_name, s_acctbal, 'POINT(' || (s_suppkey % 50) || ' ' || s_nationkey || ')' t FROM supplier"

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "extent_by_nation": (
        extent_by_nation,
        f"SELECT n, count(*) customers, min(x) xmin, min(y) ymin, max(x) xmax, max(y) ymax, round((max(x) - min(x)) * (max(y) - min(y)), 6) area FROM ({_POINTS}) GROUP BY n",
    ),
    "join_customers_cells": (
        join_customers_cells,
        f"SELECT n_nationkey, count(*) customers, sum(k)::BIGINT keys FROM ({_POINTS}) JOIN nation ON x BETWEEN n_nationkey % 5 * 10 AND n_nationkey % 5 * 10 + 10 AND y BETWEEN n_nationkey // 5 * 10 AND n_nationkey // 5 * 10 + 10 GROUP BY n_nationkey",
    ),
    "join_anti": (
        join_anti,
        f"SELECT k FROM ({_POINTS}) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 12 AND x > n_nationkey % 5 * 10 AND x < n_nationkey % 5 * 10 + 10 AND y > n_nationkey // 5 * 10 AND y < n_nationkey // 5 * 10 + 10)",
    ),
    "join_left": (join_left, f"SELECT k, n_nationkey FROM ({_POINTS}) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON x > n_nationkey % 5 * 10 AND x < n_nationkey % 5 * 10 + 10 AND y > n_nationkey // 5 * 10 AND y < n_nationkey // 5 * 10 + 10"),
    "join_semi": (join_semi, f"SELECT k FROM ({_POINTS}) WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 12 AND x > n_nationkey % 5 * 10 AND x < n_nationkey % 5 * 10 + 10 AND y > n_nationkey // 5 * 10 AND y < n_nationkey // 5 * 10 + 10)"),
    "filter_literal": (filter_literal, f"SELECT k FROM ({_POINTS}) WHERE x > 10 AND x < 30 AND y > 10 AND y < 25.5"),
    "literal_columns": (literal_columns, f"SELECT k, x > 10 AND x < 30 AND y > 10 AND y < 25.5 a, false b, x > 10 AND x < 30 AND y > 10 AND y < 25.5 c, false d FROM ({_POINTS})"),
    "dump_rows": (dumped_rows, "SELECT n_nationkey k, '1.1' path, 'POINT(0 0)' t FROM nation UNION ALL SELECT n_nationkey, '1.2', 'POINT(' || n_nationkey || ' 1)' FROM nation UNION ALL SELECT n_nationkey, '2', 'POINT(5 5)' FROM nation"),
    "geoparquet_round_trip": (geoparquet_round_trip, _ROUND_TRIP + " WHERE s_suppkey % 50 <= 30 AND s_nationkey BETWEEN 5 AND 20"),
    "geoparquet_append": (geoparquet_append, _ROUND_TRIP + " WHERE s_suppkey % 50 <= 20 AND s_nationkey <= 20"),
    "flatgeobuf_round_trip": (flatgeobuf_round_trip, _ROUND_TRIP + " WHERE s_suppkey % 50 <= 30 AND s_nationkey BETWEEN 5 AND 20"),
    "flatgeobuf_conditions": (flatgeobuf_conditions, f"SELECT k, n, x, y FROM ({_POINTS}) WHERE x BETWEEN 10 AND 20 AND y < 30 AND n > 3"),
    "flatgeobuf_columns": (flatgeobuf_columns, f"SELECT n, count(*) customers, min(x) xmin, max(y) ymax FROM ({_POINTS}) GROUP BY n"),
    "flatgeobuf_append": (flatgeobuf_append, _ROUND_TRIP + " WHERE s_suppkey % 50 <= 20 AND s_nationkey <= 20"),
    "tables_by_path": (tables_by_path, f"SELECT extension, id, s_name, t FROM ({_ROUND_TRIP}), (VALUES ('fgb'), ('geojsonl'), ('parquet')) AS e(extension)"),
    "geojson_round_trip": (geojson_round_trip, _ROUND_TRIP),
    "window_extents": (
        window_extents,
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) n, min(user_id)::DOUBLE xmin, max(user_id)::DOUBLE xmax, round(min(value), 6) ymin, round(max(value), 6) ymax FROM events GROUP BY 1",
    ),
}

QUERIES = {name: _sql(text) for name, (text, _) in SQL.items()} | {name: f for name, (f, _) in FRAMES.items()}
ORACLE = {name: duck for name, (_, duck) in SQL.items()} | {name: duck for name, (_, duck) in FRAMES.items()}
