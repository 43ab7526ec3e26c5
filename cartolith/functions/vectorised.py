"""Functions on Arrow arrays, for what built-in expressions can't say."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import geojson, shapes, validity
from ..kernels.relate import PREDICATES, Shape, relate
from ..types import ARROW_GEOM, GEOM
from . import codecs
from .arrays import Column, decode, encode
from .distances import distances

_OUT = {"geom": (GEOM, ARROW_GEOM), "string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "binary": (T.BinaryType(), pa.binary())}


def _values(column: pa.Array) -> list:
    return decode(column) if pa.types.is_struct(column.type) else column.to_pylist()


def _function(kind: str, kernel: Callable, arity: int):
    """A null argument gives null."""
    spark_type, arrow_type = _OUT[kind]

    def run(*columns):
        rows = zip(*map(_values, columns), strict=True)
        out = [None if any(v is None for v in row) else kernel(*row) for row in rows]
        return encode(out) if kind == "geom" else pa.array(out, arrow_type)

    if arity == 1:

        def f(a: pa.Array) -> pa.Array:
            return run(a)

    elif arity == 2:

        def f(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

    else:

        def f(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

    return F.arrow_udf(f, spark_type)


#: Shapes and matrices that a batch keeps: constants and repeated pairs are worked out once.
_KEPT = 8192


def _matrices(a: pa.Array, b: pa.Array):
    """(matrix, shape, shape) of each pair, none where one is null."""
    if a.null_count == len(a) or b.null_count == len(b):
        yield from [None] * len(a)
        return
    left, right = Column(a), Column(b)
    known: dict[bytes, Shape] = {}

    def shape(side: Column, i: int, key: bytes) -> Shape:
        found = known.get(key)
        if found is None:
            found = known[key] = Shape(side.geometry(i))
        return found

    codes: dict[tuple, str] = {}
    for i in range(len(a)):
        if not (left.valid[i] and right.valid[i]):
            yield None
            continue
        ka, kb = left.key(i), right.key(i)
        x, y = shape(left, i, ka), shape(right, i, kb)
        code = codes.get((ka, kb))
        if code is None:
            code = codes[ka, kb] = relate(x, y)
        yield code, x, y
        if len(known) > _KEPT:
            known.clear()
        if len(codes) > _KEPT:
            codes.clear()


def _predicate_batch(a: pa.Array, b: pa.Array, name: pa.Array) -> pa.Array:
    tests = [PREDICATES[n] if n else None for n in name.to_pylist()]
    return pa.array([None if m is None or t is None else bool(t(*m)) for m, t in zip(_matrices(a, b), tests, strict=True)], pa.bool_())


def _relate_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([m and m[0] for m in _matrices(a, b)], pa.string())


def _distance_batch(pairs: pa.Array) -> pa.Array:
    return distances(pairs)


#: name -> (result, kernel, arguments)
KERNELS: dict[str, tuple[str, Callable, int]] = {
    "_py_geomfromgeojson": ("geom", geojson.read, 1),
    "_py_convexhull": ("geom", shapes.convex_hull, 1),
    "_py_concavehull": ("geom", shapes.concave_hull, 2),
    "_py_orientedenvelope": ("geom", shapes.oriented_envelope, 1),
    "_py_pointonsurface": ("geom", shapes.point_on_surface, 1),
    "_py_simplify": ("geom", shapes.simplify, 3),
    "_py_linemerge": ("geom", shapes.line_merge, 2),
    "_py_isvalidreason": ("string", validity.reason, 1),
}

#: name -> (result, function of whole columns)
CODECS: dict[str, tuple[str, Callable[[pa.Array], pa.Array]]] = {
    "_py_geomfromtext": ("geom", codecs.read_wkt),
    "_py_astext": ("string", codecs.write_wkt),
    "st_geomfromwkb": ("geom", codecs.read_wkb),
    "st_wkbtosql": ("geom", codecs.read_wkb),
    "st_asbinary": ("binary", codecs.write_wkb),
}


def _columns(kind: str, codec: Callable[[pa.Array], pa.Array]):
    def f(a: pa.Array) -> pa.Array:
        return codec(a)

    return F.arrow_udf(f, _OUT[kind][0])


UDFS = {name: _function(*spec) for name, spec in KERNELS.items()} | {name: _columns(*spec) for name, spec in CODECS.items()}
UDFS["_py_distance"] = F.arrow_udf(_distance_batch, T.DoubleType())
UDFS["_py_predicate"] = F.arrow_udf(_predicate_batch, T.BooleanType())
UDFS["_py_relate"] = F.arrow_udf(_relate_batch, T.StringType())


def _extent(g: pa.Array) -> float:
    coords = g.filter(g.is_valid()).field("parts").flatten().field("rings").flatten().flatten()
    if not len(coords):
        return None
    x, y = pc.min_max(coords.field("x")), pc.min_max(coords.field("y"))
    return {"xmin": x["min"].as_py(), "ymin": y["min"].as_py(), "xmax": x["max"].as_py(), "ymax": y["max"].as_py()}


#: Grouped extent for SQL: the struct that the DataFrame function ``extent`` gives. It gathers a group in one task;
#: ``extent`` doesn't.
EXTENT = F.arrow_udf(_extent, T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")]))
