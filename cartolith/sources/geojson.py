"""GeoJSON: features by line are written and read, and collections in one file are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as st


def write_geojsonl(df: DataFrame, path: str, geom: str = "geometry", id_col: str = "id", mode: str = "errorifexists") -> None:
    """One feature a line. The column ``id`` becomes the feature's id, all others its properties."""
    features(df, geom, id_col).write.mode(mode).option("compression", "none").text(path)


def features(df: DataFrame, geom: str = "geometry", id_col: str = "id") -> DataFrame:
    """A column ``value`` of features as text, by built-in expressions alone."""
    names = [c for c in df.columns if c not in (geom, id_col)]
    keep_nulls = {"ignoreNullFields": "false"}
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), keep_nulls) if names else F.lit("{}")
    geometry = F.coalesce(st.st_asgeojson(st.as_geom(df, geom)), F.lit("null"))
    pieces: list[Column] = [F.lit('{"type":"Feature",')]
    if id_col in df.columns:
        # a struct of one field, without its braces and name
        one = F.to_json(F.struct(F.col(f"`{id_col}`").alias("i")), keep_nulls)
        pieces.append(F.when(F.col(f"`{id_col}`").isNotNull(), F.concat(F.lit('"id":'), F.substring(one, F.lit(6), F.length(one) - 6), F.lit(","))).otherwise(F.lit("")))
    pieces += [F.lit('"geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")]
    return df.select(F.concat(*pieces).alias("value"))


def read_geojson(spark: SparkSession, path: str, properties: str | T.StructType, multiline: bool = False) -> DataFrame:
    """Features with the properties of a schema, ``id`` as text, and ``geometry``.

    A line holds a feature; with ``multiline`` a file holds a collection of features.
    """
    schema = properties if isinstance(properties, T.StructType) else T._parse_datatype_string(properties)
    st._session()
    if multiline:
        inner = T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", schema), T.StructField("geometry", T.StringType())])
        whole = spark.read.text(path, wholetext=True)
        each = whole.select(F.explode(F.from_json("value", T.StructType([T.StructField("features", T.ArrayType(inner))]))["features"]).alias("f"))
        rows = each.select(F.col("f.id").alias("id"), F.col("f.properties").alias("p"), F.col("f.geometry").alias("g"))
    else:
        text = spark.read.text(path).where(F.trim("value") != "")
        rows = text.select(F.get_json_object("value", "$.id").alias("id"), F.from_json(F.get_json_object("value", "$.properties"), schema).alias("p"), F.get_json_object("value", "$.geometry").alias("g"))
    return rows.select("id", *[F.col(f"p.`{f.name}`").alias(f.name) for f in schema], F.call_function("st_geomfromgeojson", F.col("g")).alias("geometry"))
