"""The SQL functions: built-in expressions wherever these can say it, vectorised Python elsewhere.

Every entry is a SQL function with a body, which the analyzer inlines, so Catalyst sees plain expressions.
Names that start with an underscore are helpers.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..types import COORD_DDL, DUMP_DDL, GEOM_DDL, PAIR_DDL

G = GEOM_DDL
_BOUNDS = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"


@dataclass(frozen=True)
class SqlFunction:
    name: str
    params: str
    returns: str
    body: str
    doc: str
    aliases: tuple[str, ...] = ()
    group: str = "native"


def _coord(x: str, y: str, z: str = "CAST(NULL AS DOUBLE)", m: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"named_struct('x', {x}, 'y', {y}, 'z', {z}, 'm', {m})"


_NO_PATH = "CAST(array() AS ARRAY<INT>)"


def _geom(kind: str, dim: str, srid: str, rings: str, part_kind: str | None = None) -> str:
    part = f"named_struct('kind', {part_kind or kind}, 'path', {_NO_PATH}, 'rings', {rings})"
    return f"named_struct('kind', {kind}, 'dim', {dim}, 'srid', {srid}, 'parts', array({part}))"


def _point(dim: int, names: str, srid: str = "srid") -> str:
    null = " OR ".join(f"{n} IS NULL" for n in [*names, *([srid] if srid == "srid" else [])])
    z = "z" if "z" in names else "CAST(NULL AS DOUBLE)"
    m = "m" if "m" in names else "CAST(NULL AS DOUBLE)"
    return f"IF({null}, NULL, {_geom('1Y', f'{dim}Y', srid, f'array(array({_coord("x", "y", z, m)}))')})"


_COORDS = "flatten(flatten(transform(g.parts, p -> p.rings)))"
_FIRST = "get(get(get(g.parts, 0).rings, 0), 0)"


def _ordinate(name: str, dims: str = "") -> str:
    return f"IF(g.kind = 1{dims}, {_FIRST}.{name}, NULL)"


def _extreme(fn: str, name: str, corner: int) -> str:
    """Of a box the corner as it is."""
    return f"IF(g.kind = 8, get(get(get(g.parts, 0).rings, 0), {corner}).{name}, array_{fn}(transform({_COORDS}, c -> c.{name})))"


def _box(low: str, high: str, dim: str = "0Y", srid: str = "g.srid") -> str:
    return _geom("8Y", dim, srid, f"array(array({low}, {high}))")


_RECT = "array(array({a}, {b}, {c}, {d}, {a}))".format(
    a=_coord("st_xmin(g)", "st_ymin(g)"), b=_coord("st_xmin(g)", "st_ymax(g)"), c=_coord("st_xmax(g)", "st_ymax(g)"), d=_coord("st_xmax(g)", "st_ymin(g)")
)


# Functions can't be called with variables of lambdas, so what lambdas share is text.


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _pairs(r: str, each: str) -> str:
    """``each`` for every segment e, from e.sa to e.sb, of a ring; o is its first point.

    An inner lambda never names a variable of an outer one: Python calls above such a lambda aren't found
    when they are taken out of the plan.
    """
    n = f"greatest(size({r}) - 1, 0)"
    ends = f"zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), (sa, sb) -> named_struct('sa', sa, 'sb', sb))"
    return f"zip_with({ends}, array_repeat(get({r}, 0), {n}), (e, o) -> {each})"


_CROSS = "(e.sa.x - o.x) * (e.sb.y - o.y) - (e.sb.x - o.x) * (e.sa.y - o.y)"
_SEGMENT = "sqrt((e.sb.x - e.sa.x) * (e.sb.x - e.sa.x) + (e.sb.y - e.sa.y) * (e.sb.y - e.sa.y))"
_SUM = "0D, (acc, v) -> acc + v"
_MOMENTS = "STRUCT<w: DOUBLE, x: DOUBLE, y: DOUBLE>"
_ZERO = "named_struct('w', 0D, 'x', 0D, 'y', 0D)"


def _ring_area(r: str) -> str:
    return f"abs(aggregate({_pairs(r, _CROSS)}, {_SUM})) / 2"


def _ring_moments(r: str) -> str:
    """Doubled area and first moments of a ring, signed by its direction."""
    each = f"named_struct('w', {_CROSS}, 'x', e.sa.x + e.sb.x + o.x, 'y', e.sa.y + e.sb.y + o.y)"
    return f"aggregate({_pairs(r, each)}, {_ZERO}, (acc, v) -> named_struct('w', acc.w + v.w, 'x', acc.x + v.w * v.x / 3, 'y', acc.y + v.w * v.y / 3))"


def _line_moments(r: str) -> str:
    each = f"named_struct('w', {_SEGMENT}, 'x', (e.sa.x + e.sb.x) / 2, 'y', (e.sa.y + e.sb.y) / 2)"
    return f"aggregate({_pairs(r, each)}, {_ZERO}, (acc, v) -> named_struct('w', acc.w + v.w, 'x', acc.x + v.w * v.x, 'y', acc.y + v.w * v.y))"


_CLOSED = "coalesce(size(get(p.rings, 0)) > 1 AND get(get(p.rings, 0), 0).x = get(get(p.rings, 0), size(get(p.rings, 0)) - 1).x AND get(get(p.rings, 0), 0).y = get(get(p.rings, 0), size(get(p.rings, 0)) - 1).y, false)"
_LEAN = "(e.sb.x - e.sa.x) * (y - e.sa.y)"
_RISE = "(e.sb.y - e.sa.y) * (x - e.sa.x)"
#: A ray cast from (x, y): 0 outside, 1 inside so far, 2 on the ring, 3 too near to tell in doubles.
_STATE = (
    "CASE WHEN st > 1 THEN st WHEN e.sa.x = x AND e.sa.y = y OR e.sb.x = x AND e.sb.y = y THEN 2 "
    "WHEN (e.sa.y > y) = (e.sb.y > y) THEN IF(e.sa.y = y AND e.sb.y = y AND least(e.sa.x, e.sb.x) <= x AND x <= greatest(e.sa.x, e.sb.x), 2, st) "
    "WHEN e.sa.x = e.sb.x THEN IF(x = e.sa.x, 2, IF(x < e.sa.x, 1 - st, st)) WHEN x < least(e.sa.x, e.sb.x) THEN 1 - st WHEN x > greatest(e.sa.x, e.sb.x) THEN st "
    f"WHEN abs({_LEAN} - {_RISE}) <= 1e-14 * (abs({_LEAN}) + abs({_RISE})) THEN 3 WHEN ({_LEAN} - {_RISE} > 0) = (e.sb.y > e.sa.y) THEN 1 - st ELSE st END"
)


def _ring_state(r: str) -> str:
    return f"aggregate({_pairs(r, "e")}, 0, (st, e) -> {_STATE})"


#: Place to a polygon by the states of its rings; 9 if one can't be told.
_PLACE = (
    "CASE WHEN exists(states, v -> v = 3) THEN 9 WHEN get(states, 0) = 2 THEN 0 WHEN get(states, 0) = 0 THEN -1 WHEN exists(slice(states, 2, size(states)), v -> v = 2) THEN 0 "
    "WHEN exists(slice(states, 2, size(states)), v -> v = 1) THEN -1 ELSE 1 END"
)
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Value of the k-th character, counted by fives, of a geohash.
_DIGIT = f"(instr('{_BASE32}', lower(substring(h, 1 + CAST(k div 5 AS INT), 1))) - 1)"
_NON_EMPTY = "size(p.rings) > 0 AND size(get(p.rings, 0)) > 0"


def _predicate(name: str, apart: str, point_b: str, point_a: str, doc: str) -> SqlFunction:
    """Boxes that are apart and points in polygons are settled by expressions, the rest by the matrix.

    ``point_b``: by w, the place of the point b to the polygon a (1 inside, 0 on it, -1 outside).
    """
    by_b = point_b.replace("w", "_point_in(b, a)")
    by_a = point_a.replace("w", "_point_in(a, b)")
    quick = (
        f"CASE WHEN a IS NULL OR b IS NULL OR st_isempty(a) OR st_isempty(b) THEN NULL WHEN _apart(a, b) THEN {apart} "
        f"WHEN b.kind = 1 AND a.kind IN (3, 6, 8) THEN {by_b} WHEN a.kind = 1 AND b.kind IN (3, 6, 8) THEN {by_a} END"
    )
    body = f"_settle({quick}, a, b, '{name}')"
    return SqlFunction(f"st_{name}", f"a {G}, b {G}", "BOOLEAN", body, doc, group="geo")


# Python gets pairs of geometries in one column, and an empty pair where it has nothing to do: with each row the JVM measures
# all arrays of a batch anew, and goes over all null lists at its end.
_NO_PAIR = f"CAST(named_struct('a', 0Y, 'b', 0Y, 'n', 0, 'parts', array()) AS {PAIR_DDL})"
_POINTS = "a.kind = 1 AND b.kind = 1"
_PAIR = f"IF(a.parts IS NULL OR b.parts IS NULL OR {_POINTS}, {_NO_PAIR}, named_struct('a', a.kind, 'b', b.kind, 'n', size(a.parts), 'parts', concat(a.parts, b.parts)))"
_POSITION = "concat('[', c.x, ',', c.y, IF(c.z IS NULL, '', concat(',', c.z)), ']')"
_RING_JSON = f"concat('[', array_join(transform(r, c -> {_POSITION}), ','), ']')"


def _part_json(p: str) -> str:
    """Coordinates of a part: a position, positions, or rings of these."""
    rings = f"transform({p}.rings, r -> {_RING_JSON})"
    point = f"transform(coalesce(get({p}.rings, 0), array()), c -> {_POSITION})"
    return f"CASE {p}.kind WHEN 1 THEN coalesce(get({point}, 0), '[]') WHEN 2 THEN coalesce(get({rings}, 0), '[]') ELSE concat('[', array_join({rings}, ','), ']') END"


_NAMES_JSON = "array('Point', 'LineString', 'Polygon', 'MultiPoint', 'MultiLineString', 'MultiPolygon')"
_BOX_JSON = "concat('[[[', st_xmin(g), ',', st_ymin(g), '],[', st_xmin(g), ',', st_ymax(g), '],[', st_xmax(g), ',', st_ymax(g), '],[', st_xmax(g), ',', st_ymin(g), '],[', st_xmin(g), ',', st_ymin(g), ']]]')"
_PART_TEXTS = f"transform(g.parts, p -> named_struct('n', get(p.path, 0), 'multi', size(p.path) > 1, 'kind', p.kind, 'c', {_part_json('p')}))"
_MEMBER_STEP = (
    "(acc, v) -> named_struct('n', v.n, 'multi', v.multi, 'out', concat(acc.out, IF(v.multi AND acc.multi AND v.n = acc.n, concat(',', v.c), "
    "concat(IF(acc.multi, ']}', ''), IF(acc.n > 0, ',', ''), '{\"type\":\"', element_at(" + _NAMES_JSON + ", v.kind + IF(v.multi, 3, 0)), '\",\"coordinates\":', IF(v.multi, '[', ''), v.c, IF(v.multi, '', '}')))))"
)
_COLLECTION_JSON = f"aggregate({_PART_TEXTS}, named_struct('n', 0, 'multi', false, 'out', ''), {_MEMBER_STEP}, acc -> concat(acc.out, IF(acc.multi, ']}}', '')))"
_JSON = (
    f"CASE WHEN g.kind = 8 THEN {_BOX_JSON} WHEN g.kind = 7 THEN {_COLLECTION_JSON} WHEN g.kind IN (1, 2, 3) THEN coalesce(get(transform(g.parts, p -> {_part_json('p')}), 0), '[]') "
    f"ELSE concat('[', array_join(transform(g.parts, p -> {_part_json('p')}), ','), ']') END"
)


CATALOG: list[SqlFunction] = [
    # --- constructors
    SqlFunction("st_point", "x DOUBLE, y DOUBLE, srid INT DEFAULT 0", G, _point(0, "xy"), "Point of x and y, with an SRID if given. Null if any argument is."),
    SqlFunction("st_pointz", "x DOUBLE, y DOUBLE, z DOUBLE, srid INT DEFAULT 0", G, _point(1, "xyz"), "Point of x, y and z."),
    SqlFunction("st_pointm", "x DOUBLE, y DOUBLE, m DOUBLE, srid INT DEFAULT 0", G, _point(2, "xym"), "Point of x, y and measure."),
    SqlFunction("st_pointzm", "x DOUBLE, y DOUBLE, z DOUBLE, m DOUBLE, srid INT DEFAULT 0", G, _point(3, "xyzm"), "Point of x, y, z and measure."),
    SqlFunction("_makepoint2", "x DOUBLE, y DOUBLE", G, _point(0, "xy", "0"), ""),
    SqlFunction("_makepoint3", "x DOUBLE, y DOUBLE, z DOUBLE", G, _point(1, "xyz", "0"), ""),
    SqlFunction("_makepoint4", "x DOUBLE, y DOUBLE, z DOUBLE, m DOUBLE", G, _point(3, "xyzm", "0"), ""),
    SqlFunction("st_makepoint", "x DOUBLE, y DOUBLE, z DOUBLE DEFAULT 'NaN', m DOUBLE DEFAULT 'NaN'", G,
        "CASE WHEN isnan(m) AND isnan(z) THEN _makepoint2(x, y) WHEN isnan(m) THEN _makepoint3(x, y, z) ELSE _makepoint4(x, y, z, m) END",
        "Point of two, three or four ordinates, without an SRID. NaN stands for an ordinate left out."),
    SqlFunction("st_makepointm", "x DOUBLE, y DOUBLE, m DOUBLE", G, _point(2, "xym", "0"), "Point of x, y and measure, without an SRID."),
    # --- accessors
    SqlFunction("geometrytype", f"g {G}", "STRING",
        "concat(element_at(array('POINT', 'LINESTRING', 'POLYGON', 'MULTIPOINT', 'MULTILINESTRING', 'MULTIPOLYGON', 'GEOMETRYCOLLECTION', 'POLYGON'), g.kind), element_at(array('', 'Z', 'M', 'ZM'), IF(g.kind = 8, 1, g.dim + 1)))",
        "Type in upper case, with Z, M or ZM. A box is a polygon."),
    SqlFunction("st_geometrytype", f"g {G}", "STRING",
        "element_at(array('ST_Point', 'ST_LineString', 'ST_Polygon', 'ST_MultiPoint', 'ST_MultilineString', 'ST_MultiPolygon', 'ST_GeometryCollection', 'ST_Polygon'), g.kind)",
        "Type as ST_Point and the like. A box is ST_Polygon."),
    SqlFunction("st_coorddim", f"g {G}", "INT", "element_at(array(2, 3, 3, 4), g.dim + 1)", "Ordinates of a coordinate."),
    SqlFunction("st_ndims", f"g {G}", "INT", "element_at(array(2, 3, 3, 4), g.dim + 1)", "Ordinates of a coordinate."),
    SqlFunction("st_npoints", f"g {G}", "INT", "IF(g.kind = 8, 4, aggregate(g.parts, 0, (n, p) -> n + aggregate(p.rings, 0, (k, r) -> k + size(r))))",
        "Number of coordinates, closing ones included. 4 for a box.", ("st_numpoints",)),
    SqlFunction("st_numinteriorrings", f"g {G}", "INT", "IF(g.kind = 3, greatest(size(coalesce(get(g.parts, 0).rings, array())) - 1, 0), NULL)",
        "Holes of a polygon; null for other types.", ("st_numinteriorring",)),
    SqlFunction("st_x", f"g {G}", "DOUBLE", _ordinate("x"), "x of a point; null for other types and empty points."),
    SqlFunction("st_y", f"g {G}", "DOUBLE", _ordinate("y"), "y of a point."),
    SqlFunction("st_z", f"g {G}", "DOUBLE", _ordinate("z", " AND g.dim IN (1, 3)"), "z of a point; null if it has none."),
    SqlFunction("st_m", f"g {G}", "DOUBLE", _ordinate("m", " AND g.dim IN (2, 3)"), "Measure of a point; null if it has none."),
    SqlFunction("_line_point", f"g {G}, c {COORD_DDL}", G, f"IF(g.kind = 2 AND c IS NOT NULL, {_geom('1Y', 'g.dim', 'g.srid', 'array(array(c))')}, NULL)", ""),
    SqlFunction("st_startpoint", f"g {G}", G, f"_line_point(g, {_FIRST})", "First point of a line; null for other types and empty lines."),
    SqlFunction("st_endpoint", f"g {G}", G, "_line_point(g, get(get(get(g.parts, 0).rings, 0), size(get(get(g.parts, 0).rings, 0)) - 1))", "Last point of a line."),
    SqlFunction("st_pointn", f"g {G}, n INT", G, "_line_point(g, get(get(get(g.parts, 0).rings, 0), IF(n > 0, n - 1, n + size(get(get(g.parts, 0).rings, 0)))))",
        "The n-th point of a line, from 1; from the end if negative."),
    SqlFunction("st_isclosed", f"g {G}", "BOOLEAN",
        f"CASE WHEN g.kind IN (2, 5) THEN size(g.parts) > 0 AND forall(g.parts, p -> {_CLOSED}) WHEN g.kind IN (1, 3, 4, 6) THEN true WHEN g.kind IS NOT NULL THEN false END",
        "Whether all lines end where they start. True for points and polygons, false for collections and boxes."),
    SqlFunction("st_isempty", f"g {G}", "BOOLEAN", f"NOT exists(g.parts, p -> {_NON_EMPTY})", "Whether no part has a coordinate; of a polygon the shell counts."),
    SqlFunction("st_dump", f"g {G}", DUMP_DDL,
        f"CASE WHEN g IS NULL THEN NULL WHEN NOT exists(g.parts, p -> {_NON_EMPTY}) THEN array() WHEN g.kind IN (1, 2, 3, 8) THEN array(named_struct('path', {_NO_PATH}, 'geom', g)) "
        f"ELSE transform(g.parts, p -> named_struct('path', p.path, 'geom', named_struct('kind', p.kind, 'dim', g.dim, 'srid', g.srid, 'parts', filter(array(named_struct('kind', p.kind, 'path', {_NO_PATH}, 'rings', p.rings)), q -> size(q.rings) > 0)))) END",
        "Single parts with their paths. Empty geometries give none, but empty members of others are kept. Unnest with inline()."),
    # --- boxes
    SqlFunction("st_xmin", f"g {G}", "DOUBLE", _extreme("min", "x", 0), "Smallest x; null if empty."),
    SqlFunction("st_ymin", f"g {G}", "DOUBLE", _extreme("min", "y", 0), "Smallest y."),
    SqlFunction("st_zmin", f"g {G}", "DOUBLE", _extreme("min", "z", 0), "Smallest z; null if there is none."),
    SqlFunction("st_xmax", f"g {G}", "DOUBLE", _extreme("max", "x", 1), "Largest x."),
    SqlFunction("st_ymax", f"g {G}", "DOUBLE", _extreme("max", "y", 1), "Largest y."),
    SqlFunction("st_zmax", f"g {G}", "DOUBLE", _extreme("max", "z", 1), "Largest z; null if there is none."),
    SqlFunction("box2d", f"g {G}", G, f"IF(g IS NULL OR st_isempty(g), NULL, {_box(_coord('st_xmin(g)', 'st_ymin(g)'), _coord('st_xmax(g)', 'st_ymax(g)'))})", "Bounding box in x and y; null if empty."),
    SqlFunction("box3d", f"g {G}", G, f"IF(g IS NULL OR st_isempty(g), NULL, {_box(_coord('st_xmin(g)', 'st_ymin(g)', 'st_zmin(g)'), _coord('st_xmax(g)', 'st_ymax(g)', 'st_zmax(g)'), '1Y')})",
        "Bounding box in x, y and z; z is null if there is none."),
    SqlFunction("st_makebox2d", f"a {G}, b {G}", G, f"IF(st_x(a) IS NULL OR st_x(b) IS NULL, NULL, {_box(_coord('st_x(a)', 'st_y(a)'), _coord('st_x(b)', 'st_y(b)'), srid='0')})",
        "Box of two points, its corners as given."),
    SqlFunction("st_3dmakebox", f"a {G}, b {G}", G, f"IF(st_z(a) IS NULL OR st_z(b) IS NULL, NULL, {_box(_coord('st_x(a)', 'st_y(a)', 'st_z(a)'), _coord('st_x(b)', 'st_y(b)', 'st_z(b)'), '1Y', '0')})",
        "Box of two points with z."),
    SqlFunction("st_envelope", f"g {G}", G,
        f"CASE WHEN g IS NULL OR st_isempty(g) THEN g WHEN st_xmin(g) = st_xmax(g) AND st_ymin(g) = st_ymax(g) THEN st_point(st_xmin(g), st_ymin(g), g.srid) "
        f"WHEN st_xmin(g) = st_xmax(g) OR st_ymin(g) = st_ymax(g) THEN {_geom('2Y', '0Y', 'g.srid', f'array(array({_coord("st_xmin(g)", "st_ymin(g)")}, {_coord("st_xmax(g)", "st_ymax(g)")}))')} "
        f"ELSE {_geom('3Y', '0Y', 'g.srid', _RECT)} END",
        "Bounding box as a polygon, or a line or point where it has no area."),
    SqlFunction("st_expand", f"g {G}, dx DOUBLE, dy DOUBLE DEFAULT 'NaN'", G,
        f"IF(g IS NULL OR st_isempty(g) OR dx IS NULL OR dy IS NULL, NULL, {_box(_coord('st_xmin(g) - dx', 'st_ymin(g) - IF(isnan(dy), dx, dy)'), _coord('st_xmax(g) + dx', 'st_ymax(g) + IF(isnan(dy), dx, dy)'))})",
        "Bounding box grown by dx, and dy if it differs, on each side."),
    # --- measurement
    SqlFunction("st_area", f"g {G}", "DOUBLE",
        f"IF(g.kind = 8, abs((st_xmax(g) - st_xmin(g)) * (st_ymax(g) - st_ymin(g))), aggregate(filter(g.parts, p -> p.kind = 3), 0D, (s, p) -> s + aggregate(transform(p.rings, (r, i) -> IF(i = 0, 1, -1) * {_ring_area('r')}), 0D, (t, u) -> t + u)))",
        "Planar area, never negative.", group="geo"),
    SqlFunction("st_length", f"g {G}", "DOUBLE", f"aggregate(filter(g.parts, p -> p.kind = 2), 0D, (s, p) -> s + coalesce(aggregate({_pairs('get(p.rings, 0)', _SEGMENT)}, {_SUM}), 0D))",
        "Planar length of lines; 0 for points and polygons.", ("st_length2d",), "geo"),
    SqlFunction("st_distance", f"a {G}, b {G}", "DOUBLE",
        f"coalesce(IF({_POINTS}, hypot(st_x(a) - st_x(b), st_y(a) - st_y(b)), NULL), _py_distance({_PAIR}))",
        "Smallest planar distance; null for empty geometries.", group="geo"),
    # --- processing
    SqlFunction("_total", f"m ARRAY<{_MOMENTS}>", _MOMENTS,
        f"aggregate(m, {_ZERO}, (s, v) -> named_struct('w', s.w + v.w, 'x', s.x + v.x, 'y', s.y + v.y), s -> IF(s.w > 0, s, NULL))", "", group="geo"),
    SqlFunction("_moments", f"g {G}", _MOMENTS,
        f"coalesce(_total(transform(flatten(transform(filter(g.parts, p -> p.kind = 3), p -> transform(p.rings, (r, i) -> named_struct('s', IF(i = 0, 1D, -1D), 'm', {_ring_moments('r')})))), "
        "u -> named_struct('w', u.s * abs(u.m.w), 'x', u.s * sign(u.m.w) * u.m.x, 'y', u.s * sign(u.m.w) * u.m.y))), "
        f"_total(flatten(transform(filter(g.parts, p -> p.kind IN (2, 3)), p -> transform(p.rings, r -> {_line_moments('r')})))), "
        f"_total(transform({_COORDS}, c -> named_struct('w', 1D, 'x', c.x, 'y', c.y))))", "", group="geo"),
    SqlFunction("_balance", f"m {_MOMENTS}, srid INT", G, "st_point(m.x / m.w, m.y / m.w, srid)", "", group="geo"),
    SqlFunction("st_centroid", f"g {G}", G,
        "IF(g.kind = 8, st_point((st_xmin(g) + st_xmax(g)) / 2, (st_ymin(g) + st_ymax(g)) / 2, g.srid), _balance(_moments(g), g.srid))",
        "Mean point of the parts of highest dimension, by area, length or count; null if empty.", group="geo"),
    SqlFunction("st_convexhull", f"g {G}", G, "_py_convexhull(g)", "Convex hull, always a polygon.", group="geo"),
    SqlFunction("st_concavehull", f"g {G}, ratio DOUBLE DEFAULT 0.3", G, "_py_concavehull(g, ratio)", "Hull with long edges dug in; ratio 1 gives the convex hull.", group="geo"),
    SqlFunction("st_orientedenvelope", f"g {G}", G, "_py_orientedenvelope(g)", "Rectangle of smallest area at any angle.", group="geo"),
    SqlFunction("st_pointonsurface", f"g {G}", G, "_py_pointonsurface(g)", "A point of the geometry, inside it if it has an inside.", group="geo"),
    SqlFunction("st_simplify", f"g {G}, tolerance DOUBLE", G, "_py_simplify(g, tolerance, 'dp')", "Lines and polygons without points nearer than the tolerance to what remains.", group="geo"),
    SqlFunction("st_simplifyvw", f"g {G}, tolerance DOUBLE", G, "_py_simplify(g, tolerance, 'vw')", "Without points whose triangle has less area than the tolerance.", group="geo"),
    SqlFunction("st_simplifypreservetopology", f"g {G}, tolerance DOUBLE", G, "_py_simplify(g, tolerance, 'vw-preserve')", "As st_simplifyvw, but without new crossings; rings keep four points.", group="geo"),
    SqlFunction("st_linemerge", f"g {G}, directed BOOLEAN DEFAULT false", G, "_py_linemerge(g, coalesce(directed, false))", "Lines joined where exactly two ends meet, only head to tail if directed.", group="geo"),
    # --- relationships
    SqlFunction("_apart", f"a {G}, b {G}", "BOOLEAN", "_apart_boxes(_bounds(a), _bounds(b))", "", group="geo"),
    SqlFunction("_box_place", f"x DOUBLE, y DOUBLE, b {_BOUNDS}", "INT",
        "CASE WHEN x < b.x0 OR x > b.x1 OR y < b.y0 OR y > b.y1 THEN -1 WHEN x > b.x0 AND x < b.x1 AND y > b.y0 AND y < b.y1 THEN 1 ELSE 0 END", "", group="geo"),
    SqlFunction("_polygon_place", f"x DOUBLE, y DOUBLE, g {G}", "INT",
        f"nullif(aggregate(filter(g.parts, p -> size(p.rings) > 0), -1, (w, p) -> greatest(w, {_let(f'transform(p.rings, r -> {_ring_state("r")})', 'states', _PLACE)})), 9)", "", group="geo"),
    SqlFunction("_point_in", f"p {G}, g {G}", "INT", "IF(g.kind = 8, _box_place(st_x(p), st_y(p), _bounds(g)), _polygon_place(st_x(p), st_y(p), g))", "", group="geo"),
    _predicate("intersects", "false", "w >= 0", "w >= 0", "Whether a and b share a point."),
    _predicate("disjoint", "true", "w < 0", "w < 0", "Whether a and b share no point."),
    _predicate("contains", "false", "w = 1", "IF(w IS NULL, NULL, false)", "Whether b lies in a and their interiors meet."),
    _predicate("within", "false", "IF(w IS NULL, NULL, false)", "w = 1", "Whether a lies in b and their interiors meet."),
    _predicate("covers", "false", "w >= 0", "IF(w IS NULL, NULL, false)", "Whether no point of b is outside a."),
    _predicate("coveredby", "false", "IF(w IS NULL, NULL, false)", "w >= 0", "Whether no point of a is outside b."),
    _predicate("equals", "false", "IF(w IS NULL, NULL, false)", "IF(w IS NULL, NULL, false)", "Whether a and b are the same set of points."),
    _predicate("touches", "false", "w = 0", "w = 0", "Whether a and b meet but their interiors don't."),
    _predicate("crosses", "false", "IF(w IS NULL, NULL, false)", "IF(w IS NULL, NULL, false)", "Whether the interiors meet in less than the larger dimension, and neither holds the other."),
    _predicate("overlaps", "false", "IF(w IS NULL, NULL, false)", "IF(w IS NULL, NULL, false)", "Whether a and b, of one dimension, share part but not all of their interiors."),
    SqlFunction("st_relate", f"a {G}, b {G}", "STRING", "_py_relate(a, b)", "The nine-intersection matrix as text.", group="geo"),
    # --- validation
    SqlFunction("st_isvalid", f"g {G}", "BOOLEAN", "_py_isvalidreason(g) = 'Valid Geometry'", "Whether the geometry keeps the simple-features rules.", group="geo"),
    SqlFunction("st_isvalidreason", f"g {G}", "STRING", "_py_isvalidreason(g)", "'Valid Geometry', or what is wrong.", group="geo"),
    # --- geohash
    SqlFunction("_geohash_bits", "v DOUBLE, low DOUBLE, span DOUBLE", "BIGINT",
        "CASE WHEN v < low OR v > low + span OR isnan(v) THEN CAST(raise_error(concat('coordinate out of range for a geohash: ', v)) AS BIGINT) ELSE least(CAST(floor((v - low) / span * 1073741824D) AS BIGINT), 1073741823L) END", "", group="geohash"),
    SqlFunction("_interleave", "lon BIGINT, lat BIGINT, n INT", "STRING",
        f"array_join(transform(sequence(0, n - 1), i -> substring('{_BASE32}', 1 + aggregate(sequence(0, 4), 0, (a, j) -> 2 * a + CAST(shiftright(IF((5 * i + j) % 2 = 0, lon, lat), 29 - CAST((5 * i + j) div 2 AS INT)) & 1L AS INT)), 1)), '')", "", group="geohash"),
    SqlFunction("st_geohash", f"g {G}, maxchars INT DEFAULT 12", "STRING",
        "IF(g.kind = 1 AND st_x(g) IS NOT NULL AND maxchars IS NOT NULL, _interleave(_geohash_bits(st_x(g), -180D, 360D), _geohash_bits(st_y(g), -90D, 180D), greatest(1, least(maxchars, 12))), NULL)",
        "Geohash of a point of longitude and latitude; null for other types.", group="geohash"),
    SqlFunction("_geohash_checked", "h STRING", "STRING", f"IF(h RLIKE '^[{_BASE32}{_BASE32.upper()}]+$', h, IF(h IS NULL, NULL, CAST(raise_error(concat('not a geohash: ', h)) AS STRING)))", "", group="geohash"),
    SqlFunction("_geohash_cell", "h STRING", "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>",
        f"aggregate(sequence(0, 5 * length(h) - 1), named_struct('x', -180D, 'y', -90D, 'w', 360D, 'h', 180D), (s, k) -> IF(k % 2 = 0, "
        f"named_struct('x', s.x + s.w / 2 * (shiftright({_DIGIT}, 4 - k % 5) & 1), 'y', s.y, 'w', s.w / 2, 'h', s.h), "
        f"named_struct('x', s.x, 'y', s.y + s.h / 2 * (shiftright({_DIGIT}, 4 - k % 5) & 1), 'w', s.w, 'h', s.h / 2)))", "", group="geohash"),
    SqlFunction("_cell_box", "c STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>", G, f"IF(c IS NULL, NULL, {_box(_coord('c.x', 'c.y'), _coord('c.x + c.w', 'c.y + c.h'), srid='0')})", "", group="geohash"),
    SqlFunction("_cell_centre", "c STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>", G, "st_point(c.x + c.w / 2, c.y + c.h / 2)", "", group="geohash"),
    SqlFunction("st_box2dfromgeohash", "h STRING", G, "_cell_box(_geohash_cell(_geohash_checked(h)))", "Box of the cell of a geohash.", group="geohash"),
    SqlFunction("st_pointfromgeohash", "h STRING", G, "_cell_centre(_geohash_cell(_geohash_checked(h)))", "Centre of the cell of a geohash.", group="geohash"),
    # --- input and output
    SqlFunction("st_geomfromtext", "wkt STRING", G, "_py_geomfromtext(wkt)", "Geometry of well-known text; malformed text is an error.", ("st_geometryfromtext", "st_wkttosql")),
    SqlFunction("st_geomfromgeojson", "json STRING", G, "_py_geomfromgeojson(json)", "Geometry of a GeoJSON geometry."),
    SqlFunction("st_asgeojson", f"g {G}", "STRING", f"CASE WHEN g IS NULL THEN NULL ELSE concat('{{\"type\":\"', element_at(array('Point', 'LineString', 'Polygon', 'MultiPoint', 'MultiLineString', 'MultiPolygon', 'GeometryCollection', 'Polygon'), g.kind), IF(g.kind = 7, '\",\"geometries\":[', '\",\"coordinates\":'), {_JSON}, IF(g.kind = 7, ']', ''), '}}') END",
        "GeoJSON geometry with x, y and z."),
    SqlFunction("st_astext", f"g {G}", "STRING", "_py_astext(g)", "Well-known text."),
]

#: Helpers that others need before them.
HELPERS = [
    SqlFunction("_bounds", f"g {G}", _BOUNDS, "named_struct('x0', st_xmin(g), 'y0', st_ymin(g), 'x1', st_xmax(g), 'y1', st_ymax(g))", "", group="geo"),
    SqlFunction("_apart_boxes", f"a {_BOUNDS}, b {_BOUNDS}", "BOOLEAN", "a.x1 < b.x0 OR b.x1 < a.x0 OR a.y1 < b.y0 OR b.y1 < a.y0", "", group="geo"),
    SqlFunction("_settle", f"quick BOOLEAN, a {G}, b {G}, name STRING", "BOOLEAN", "coalesce(quick, _py_predicate(IF(quick IS NULL, a, NULL), b, name))", "", group="geo"),
]
at = next(i for i, f in enumerate(CATALOG) if f.name == "_apart")
CATALOG[at:at] = HELPERS
