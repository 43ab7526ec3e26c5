"""Column builders: one for every SQL function, plus ``extent``, ``geom_lit`` and ``as_geom``.

    from cartolith import functions as st
    df.select(st.st_area("geometry"), st.st_distance("a", "b"))

Functions are registered in the active session when first used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import GEOM, GEOM_DDL, extension_metadata
from .catalog import CATALOG

_ready: set[int] = set()


def _session() -> SparkSession:
    spark = SparkSession.active()
    if id(spark) not in _ready:
        from ..register import register_all

        register_all(spark)
        _ready.add(id(spark))
    return spark


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def _builder(name: str, params: str, doc: str):
    def build(*args, coord_type: str | None = None) -> Column:
        if coord_type is not None and coord_type.lower() not in ("interleaved", "separated"):
            raise ValueError(f"unknown coordinate layout: {coord_type}")
        _session()
        return F.call_function(name, *[_column(a) for a in args])

    build.__name__ = build.__qualname__ = name
    build.__doc__ = f"{doc}\n\nArguments: {params.replace(GEOM_DDL, 'geometry')}. Strings name columns; ``coord_type`` is taken for compatibility and has no effect."
    return build


for _f in CATALOG:
    if not _f.name.startswith("_"):
        for _name in (_f.name, *_f.aliases):
            globals()[_name] = _builder(_name, _f.params, _f.doc)
for _name, _doc in (("st_geomfromwkb", "Geometry of well-known binary."), ("st_wkbtosql", "Geometry of well-known binary."), ("st_asbinary", "Well-known binary, ISO, little-endian.")):
    globals()[_name] = _builder(_name, "g", _doc)


def extent(g) -> Column:
    """Aggregate: struct xmin, ymin, xmax, ymax of all geometries; null if there are none.

    Built of min and max, so it has a partial step before the shuffle and works in streams.
    """
    low_x, low_y = F.min(st_xmin(g)), F.min(st_ymin(g))  # noqa: F821
    high_x, high_y = F.max(st_xmax(g)), F.max(st_ymax(g))  # noqa: F821
    return F.when(low_x.isNotNull(), F.struct(low_x.alias("xmin"), low_y.alias("ymin"), high_x.alias("xmax"), high_y.alias("ymax")))


def geom_lit(wkt: str) -> Column:
    """A geometry literal, parsed here and foldable in the plan."""
    from ..kernels.wkt import read

    g = read(wkt)
    number = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"{v!r}D" if v == v and abs(v) != float("inf") else f"double('{v}')"

    def array(items: list[str], kind: str) -> str:
        return f"array({', '.join(items)})" if items else f"CAST(array() AS ARRAY<{kind}>)"

    coord = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, m: DOUBLE>"
    row = g.row()
    parts = []
    for p in row["parts"]:
        rings = [array([f"named_struct({', '.join(f"'{k}', {number(c[k])}" for k in 'xyzm')})" for c in r], coord) for r in p["rings"]]
        parts.append(f"named_struct('kind', {p['kind']}Y, 'path', {array([str(i) for i in p['path']], 'INT')}, 'rings', {array(rings, f'ARRAY<{coord}>')})")
    body = array(parts, GEOM_DDL.split("parts: ARRAY<", 1)[1][:-2])
    return F.expr(f"CAST(named_struct('kind', {row['kind']}Y, 'dim', {row['dim']}Y, 'srid', {row['srid']}, 'parts', {body}) AS {GEOM_DDL})")


def as_geom(df: DataFrame, name: str) -> Column:
    """A column as geometries, whatever it holds: geometries, well-known binary or well-known text."""
    kind = df.schema[name].dataType
    if kind == GEOM or isinstance(kind, T.StructType) and kind.names == GEOM.names:
        return F.col(name)
    if isinstance(kind, T.BinaryType):
        return st_geomfromwkb(name)  # noqa: F821
    if isinstance(kind, T.StringType):
        return st_geomfromtext(name)  # noqa: F821
    raise TypeError(f"{name} holds {kind.simpleString()}, not geometries")


def with_crs(g, name: str, srid: int) -> Column:
    """A geometry column under a name, with its reference system in the values and in the column's metadata."""
    g = _column(g)
    moved = F.when(g.isNotNull(), g.withField("srid", F.lit(srid)))
    return moved.alias(name, metadata=extension_metadata(srid))


def crs_of(df: DataFrame, name: str) -> str | None:
    """The reference system in a column's metadata, as EPSG:n."""
    text = df.schema[name].metadata.get("ARROW:extension:metadata")
    return json.loads(text).get("crs") if text else None
