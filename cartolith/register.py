"""Registration of the functions in a session: all, or by group."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.catalog import CATALOG
from .functions.vectorised import EXTENT, UDFS

_PYTHON_NATIVE = ("_py_geomfromtext", "_py_astext", "_py_geomfromgeojson", "st_geomfromwkb", "st_wkbtosql", "st_asbinary")


def _register(spark: SparkSession, group: str) -> None:
    for name, udf in UDFS.items():
        if (name in _PYTHON_NATIVE) == (group == "native"):
            spark.udf.register(name, udf)
    for f in CATALOG:
        if f.group == group:
            for name in (f.name, *f.aliases):
                comment = f" COMMENT '{f.doc.replace(chr(39), chr(39) * 2)}'" if f.doc else ""
                spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f.params}) RETURNS {f.returns}{comment} RETURN {f.body}")


def register_all_native(spark: SparkSession) -> None:
    """Constructors, accessors, boxes, text and binary."""
    _register(spark, "native")
    spark.udf.register("st_extent", EXTENT)


def register_all_geo(spark: SparkSession) -> None:
    """Measurement, processing, relationships and validation; needs the native ones."""
    _register(spark, "geo")


def register_all_geohash(spark: SparkSession) -> None:
    """Geohashes; needs the native ones."""
    _register(spark, "geohash")


def register_all(spark: SparkSession) -> SparkSession:
    """All functions and the file format, once a session."""
    from .sources import register_sources

    if not any(r.function.endswith("st_pointfromgeohash") for r in spark.sql("SHOW USER FUNCTIONS LIKE 'st_pointfromgeohash'").collect()):
        register_all_native(spark)
        register_all_geo(spark)
        register_all_geohash(spark)
        register_sources(spark)
    return spark
