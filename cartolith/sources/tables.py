"""Tables by path: reader and writer follow from the path's extension, in SQL by way of views."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .flatgeobuf import read_flatgeobuf, write_flatgeobuf
from .geojson import read_geojson, write_geojsonl
from .geoparquet import read_geoparquet, write_geoparquet


def _geojson(spark: SparkSession, path: str, properties: str | T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """GeoJSON, the properties' schema inferred by a pass over the file if it isn't given."""
    if properties is None:
        found = spark.read.option("multiLine", str(multiline).lower()).json(path).schema
        feature = found["features"].dataType.elementType if multiline else found
        properties = feature["properties"].dataType if "properties" in feature.names else T.StructType()
    return read_geojson(spark, path, properties if isinstance(properties, str | T.StructType) else T.StructType(), multiline)


def _collection(spark: SparkSession, path: str, **options) -> DataFrame:
    return _geojson(spark, path, **{"multiline": True, **options})


def _written(writer: Callable[..., None]) -> Callable[..., None]:
    """Takes "error" for what Spark calls "errorifexists"."""
    return lambda df, path, mode, **options: writer(df, path, mode="errorifexists" if mode == "error" else mode, **options)


def _flatgeobuf(df: DataFrame, path: str, mode: str, **options) -> None:
    from .flatgeobuf import _files

    if mode == "error":
        try:
            old = _files(path)
        except FileNotFoundError:
            old = []
        if old:
            raise FileExistsError(path)
    write_flatgeobuf(df, path, mode="overwrite" if mode == "overwrite" else "append", **options)


#: Extension: reader, writer.
FORMATS: dict[str, tuple[Callable[..., DataFrame], Callable[..., None] | None]] = {
    ".parquet": (read_geoparquet, write_geoparquet),
    ".geoparquet": (read_geoparquet, write_geoparquet),
    ".fgb": (read_flatgeobuf, _flatgeobuf),
    ".geojsonl": (_geojson, _written(write_geojsonl)),
    ".geojson": (_collection, None),
}


def _format(path: str) -> tuple[Callable[..., DataFrame], Callable[..., None] | None]:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no format for {path}: known extensions are {', '.join(FORMATS)}")
    return FORMATS[suffix]


def open_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The table at a path, a file or a folder of files, by its extension. Options are those of the format's reader."""
    return _format(path)[0](spark, path, **options)


def register_table(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Makes a table at a path known to SQL by a name, for the session."""
    df = open_table(spark, path, **options)
    df.createOrReplaceTempView(name)
    return df


def copy_to(spark: SparkSession, source: DataFrame | str, path: str, mode: str = "error", **options) -> None:
    """Writes a DataFrame, a table or the result of a query to a folder, in the format of its extension.

    ``mode``: error (if there is something), overwrite or append. Options are those of the format's writer.
    """
    if mode not in ("error", "overwrite", "append"):
        raise ValueError("mode must be error, overwrite or append")
    writer = _format(path)[1]
    if writer is None:
        raise ValueError(f"{path} can't be written; .geojsonl can")
    if isinstance(source, str):
        source = spark.sql(source) if " " in source.strip() else spark.table(source)
    writer(source, path, mode=mode, **options)
