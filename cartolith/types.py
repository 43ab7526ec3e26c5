"""The geometry type: a struct that built-in expressions can take apart.

``parts`` lists the points, lines and polygons of a geometry. A point part has one ring of one
coordinate, a line one ring, a polygon its shell and holes. ``path`` is the 1-based place of the part in
its multi-geometry or collection. A box is kind 8 with one ring of its two corners. Parts without rings
are empty members; in collections, kinds 4 to 6 stand for empty multi-geometries.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION, BOX = range(1, 9)
XY, XYZ, XYM, XYZM = range(4)
KIND_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
#: Part kind of the members of a multi-geometry.
MEMBER = {MULTIPOINT: POINT, MULTILINESTRING: LINESTRING, MULTIPOLYGON: POLYGON}

COORD_DDL = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, m: DOUBLE>"
PART_DDL = f"STRUCT<kind: TINYINT, path: ARRAY<INT>, rings: ARRAY<ARRAY<{COORD_DDL}>>>"
GEOM_DDL = f"STRUCT<kind: TINYINT, dim: TINYINT, srid: INT, parts: ARRAY<{PART_DDL}>>"
#: Two geometries: their kinds, and the parts of both, of which n are the first one's.
PAIR_DDL = f"STRUCT<a: TINYINT, b: TINYINT, n: INT, parts: ARRAY<{PART_DDL}>>"
DUMP_DDL = f"ARRAY<STRUCT<path: ARRAY<INT>, geom: {GEOM_DDL}>>"

COORD = T.StructType([T.StructField(n, T.DoubleType()) for n in "xyzm"])
PART = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("rings", T.ArrayType(T.ArrayType(COORD)))])
GEOM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("dim", T.ByteType()), T.StructField("srid", T.IntegerType()), T.StructField("parts", T.ArrayType(PART))])

_ARROW_COORD = pa.struct([(n, pa.float64()) for n in "xyzm"])
_ARROW_PART = pa.struct([("kind", pa.int8()), ("path", pa.list_(pa.int32())), ("rings", pa.list_(pa.list_(_ARROW_COORD)))])
ARROW_GEOM = pa.struct([("kind", pa.int8()), ("dim", pa.int8()), ("srid", pa.int32()), ("parts", pa.list_(_ARROW_PART))])


def extension_metadata(srid: int | None = None, name: str = "geoarrow.wkb") -> dict[str, str]:
    """Column metadata that names the encoding and, if known, the coordinate reference system."""
    import json

    crs = {"crs": f"EPSG:{srid}", "crs_type": "authority_code"} if srid else {}
    return {"ARROW:extension:name": name, "ARROW:extension:metadata": json.dumps(crs, separators=(",", ":"))}
