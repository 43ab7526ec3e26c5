"""GeoParquet: Spark's own Parquet scan, so pruning and pushdown stay, with geometries decoded after it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as st
from ..plans.filter import bbox_column
from ..types import GEOM_DDL, extension_metadata


#: Native encodings: kind, part kind, and lists around a coordinate within a part.
NATIVE = {"point": (1, 1, 0), "linestring": (2, 2, 1), "polygon": (3, 3, 2), "multipoint": (4, 1, 0), "multilinestring": (5, 2, 1), "multipolygon": (6, 3, 2)}


def native_geometry(name: str, kind: T.DataType, encoding: str, srid: int) -> Column:
    """A column of separated coordinates in nested lists as geometries, by built-in expressions alone."""
    code, part, depth = NATIVE[encoding]
    inner = kind
    while isinstance(inner, T.ArrayType):
        inner = inner.elementType
    z, m = "z" in inner.names, "m" in inner.names
    dim = z + 2 * m

    def coord(c: str) -> str:
        return f"named_struct('x', {c}.x, 'y', {c}.y, 'z', {f'{c}.z' if z else 'CAST(NULL AS DOUBLE)'}, 'm', {f'{c}.m' if m else 'CAST(NULL AS DOUBLE)'})"

    def rings(g: str) -> str:
        if depth == 0:
            return f"array(array({coord(g)}))"
        if depth == 1:
            return f"array(transform({g}, c -> {coord('c')}))"
        return f"transform({g}, r -> transform(r, c -> {coord('c')}))"

    def one(g: str, path: str) -> str:
        return f"named_struct('kind', {part}Y, 'path', {path}, 'rings', {rings(g)})"

    g = f"`{name}`"
    no_path = "CAST(array() AS ARRAY<INT>)"
    if code > 3:
        parts = f"transform({g}, (p, i) -> {one('p', 'array(i + 1)')})"
    else:
        empty = f"isnan({g}.x)" if code == 1 else f"size({g}) = 0"
        parts = f"filter(array({one(g, no_path)}), p -> NOT {empty})"
    return F.expr(f"IF({g} IS NULL, NULL, CAST(named_struct('kind', {code}Y, 'dim', {dim}Y, 'srid', {srid}, 'parts', {parts}) AS {GEOM_DDL}))")


#: What of a column's entry files may differ in: it is put together.
_OWN = ("bbox", "geometry_types")


class Entry:
    """The "geo" entries of files that say the same but for extents and kinds of geometries, put together."""

    def __init__(self, text: str | None, file: str):
        self.file, self.files = file, 1
        self.geo = json.loads(text) if text else {}
        columns = self.geo.get("columns", {})
        self.own = {c: {k: spec.pop(k, None) for k in _OWN} for c, spec in columns.items()}
        #: What must be the same in all files. A covering need not be there: boxes are computed where it is missing.
        self.key = json.dumps({**{k: v for k, v in self.geo.items() if k != "version"}, "columns": {c: {k: v for k, v in spec.items() if k != "covering"} for c, spec in columns.items()}}, sort_keys=True)

    def add(self, other: Entry) -> None:
        self.files += other.files
        for c, own in self.own.items():
            its = other.own[c]
            kinds = own["geometry_types"], its["geometry_types"]
            own["geometry_types"] = sorted({*kinds[0], *kinds[1]}) if kinds[0] and kinds[1] else []  # none given: any
            boxes = own["bbox"], its["bbox"]
            half = len(boxes[0] or ()) // 2
            own["bbox"] = [*map(min, boxes[0][:half], boxes[1][:half]), *map(max, boxes[0][half:], boxes[1][half:])] if boxes[0] and boxes[1] and len(boxes[0]) == len(boxes[1]) else None
            specs = self.geo["columns"][c], other.geo["columns"][c]
            coverings = [x["covering"] for x in specs if "covering" in x]
            if coverings and all(x == coverings[0] for x in coverings):
                specs[0]["covering"] = coverings[0]
            else:
                specs[0].pop("covering", None)

    def whole(self) -> dict:
        for c, own in self.own.items():
            self.geo["columns"][c] |= {k: v for k, v in own.items() if v is not None}
        return self.geo


def _differences(a: Entry, b: Entry) -> str:
    if not a.geo or not b.geo:
        return 'one has no "geo" entry'
    x, y = json.loads(a.key), json.loads(b.key)
    found = [k for k in sorted({*x, *y} - {"columns"}) if x.get(k) != y.get(k)]
    for c in sorted({*x["columns"], *y["columns"]}):
        own = x["columns"].get(c), y["columns"].get(c)
        found += [c] if None in own else [f"{k} of {c}" for k in sorted({*own[0], *own[1]}) if own[0].get(k, "") != own[1].get(k, "")]
    return ", ".join(found)


def together(entries: Iterable[Entry]) -> list[Entry]:
    """One for all entries that agree."""
    found: dict[str, Entry] = {}
    for e in entries:
        if e.key in found:
            found[e.key].add(e)
        else:
            found[e.key] = e
    return list(found.values())


#: Schemes that Arrow opens as well, so that tasks can read footers.
_ARROW = ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    import pyarrow.parquet as pq

    from .flatgeobuf import _open

    def entries() -> Iterator[Entry]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, where = _open(file)
                text = (pq.read_metadata(where, filesystem=system).metadata or {}).get(b"geo")
                yield Entry(text and text.decode(), file)

    found = together(entries())[:2]  # two that differ are enough to say so
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(e) for e in found], pa.binary())], names=["entry"])


def _jvm_footer(spark: SparkSession, file: str) -> Entry:
    """As Spark reads files, on the driver."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) if "://" in file or file.startswith("file:") else jvm.org.apache.hadoop.fs.Path(file)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, spark._jsc.hadoopConfiguration()))
    try:
        return Entry(reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo"), file)
    finally:
        reader.close()


def geo_metadata(spark: SparkSession, path: str, recursive: bool = False) -> dict:
    """The "geo" entry of the files of a table, put together; empty if they have none.

    Footers are read in tasks, a file alone or of a file system that Arrow doesn't know by the driver, and put
    together there as far as they agree. Raises ValueError if files differ in their columns, encodings or reference
    systems, or if some have no entry. Partition folders are read as Spark does, all folders below if ``recursive``.
    """
    import pickle
    from urllib.parse import urlparse

    from pyspark.errors import AnalysisException

    try:
        files = sorted(_scan(spark, path, recursive).inputFiles())
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e):  # a folder without files
            return {}
        raise
    if len(files) > 1 and all(urlparse(f).scheme in _ARROW for f in files):
        tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
        names = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
        entries = [pickle.loads(r.entry) for r in names.mapInArrow(_footers, "entry binary").collect()]
    else:
        entries = [_jvm_footer(spark, f) for f in files]
    found = together(entries)
    if len(found) > 1:
        raise ValueError(f"{found[0].file} and {found[1].file} differ: {_differences(*found[:2])}")
    return found[0].whole() if found else {}


def _scan(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true") if recursive else spark.read).parquet(path)


def _meets(at: dict[str, Column], bbox: tuple) -> Column:
    return (at["xmin"] <= bbox[2]) & (at["xmax"] >= bbox[0]) & (at["ymin"] <= bbox[3]) & (at["ymax"] >= bbox[1])


def read_geoparquet(spark: SparkSession, path: str, bbox: tuple | None = None, decode: bool = True, recursive: bool = False) -> DataFrame:
    """The table, its geometry columns as geometries; those in WKB as binary if not ``decode``.

    Geometry columns carry their encoding and reference system as column metadata. ``bbox`` keeps rows
    whose primary geometry's box meets it. Where the files have a covering column, the scan skips row groups
    by it; without one, or where it is null, boxes are computed. All files must agree, see ``geo_metadata``.
    """
    meta = geo_metadata(spark, path, recursive)
    df = _scan(spark, path, recursive)
    columns = meta.get("columns", {})
    primary, unsettled = meta.get("primary_column"), None
    if bbox:
        if primary not in columns:
            raise ValueError(f"{path} names no primary geometry column, which bbox needs")
        cover = (columns[primary].get("covering") or {}).get("bbox")
        if cover and cover["xmin"][0] in df.columns:
            at = {k: F.col(".".join(f"`{x}`" for x in v)) for k, v in cover.items()}
            unsettled = at["xmin"].isNull() | at["xmax"].isNull() | at["ymin"].isNull() | at["ymax"].isNull()
            df = df.where(_meets(at, bbox) | unsettled)
        else:
            unsettled = F.lit(True)
    out = []
    for name in df.columns:
        spec = columns.get(name)
        if not spec:
            out.append(F.col(f"`{name}`"))
            continue
        code = ((spec.get("crs") or {}).get("id") or {}) if "crs" in spec else {"authority": "OGC", "code": 4326}
        srid = int(code["code"]) if str(code.get("code", "")).isdigit() else 0
        encoding = spec.get("encoding", "WKB")
        if encoding != "WKB" and encoding not in NATIVE:
            raise ValueError(f"{name} has the unknown encoding {encoding}")
        native = encoding != "WKB"
        g = native_geometry(name, df.schema[name].dataType, encoding, srid) if native else st.st_geomfromwkb(name) if decode else F.col(name)
        if bbox and name == primary:
            shape = g if native or decode else st.st_geomfromwkb(name)
            box = {"xmin": st.st_xmin(shape), "xmax": st.st_xmax(shape), "ymin": st.st_ymin(shape), "ymax": st.st_ymax(shape)}
            df = df.where(F.when(unsettled, _meets(box, bbox)).otherwise(True))
        if decode and srid and not native:
            g = F.when(g.isNotNull(), g.withField("srid", F.lit(srid)))
        out.append(g.alias(name, metadata=extension_metadata(srid or None)))
    return df.select(*out)


def write_geoparquet(df: DataFrame, path: str, geom: str = "geometry", srid: int = 0, mode: str = "append") -> None:
    """Files with the geometry as WKB, a covering column ``bbox`` and the "geo" entry in their footers.

    Each task writes a file into a folder of this write, through Arrow's file system of the path, and
    returns its name. When all are done, the named files are moved to their place: those of attempts that
    failed or ran twice never get there. ``mode``: append, overwrite or error (if there are files).
    """
    if mode not in ("append", "overwrite", "error"):
        raise ValueError("mode must be append, overwrite or error")
    from pyarrow import fs

    from .flatgeobuf import _open

    from pyspark.sql.pandas.types import to_arrow_type

    g = st.as_geom(df, geom)
    others = [c for c in df.columns if c not in (geom, "bbox")]
    out = df.select(*[F.col(f"`{c}`") for c in others], bbox_column(g).alias("bbox"), st.st_asbinary(g).alias(geom))
    crs = {"id": {"authority": "EPSG", "code": srid}} if srid else None
    cover = {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}
    meta = {"version": "1.1.0", "primary_column": geom, "columns": {geom: {"encoding": "WKB", "geometry_types": [], "covering": {"bbox": cover}, "crs": crs}}}
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.schema], metadata={"geo": json.dumps(meta)})

    system, where = _open(path)
    system.create_dir(where, recursive=True)
    old = [f.path for f in system.get_file_info(fs.FileSelector(where)) if f.is_file and f.path.endswith(".parquet")]
    if old and mode == "error":
        raise FileExistsError(path)
    run = f"_temporary-{uuid.uuid4().hex}"
    system.create_dir(f"{where}/{run}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, where = _open(path)
        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if batch.num_rows:
                writer = writer or pq.ParquetWriter(f"{where}/{run}/{name}", schema, filesystem=system, compression="zstd")
                writer.write_table(pa.Table.from_batches([batch]).cast(schema))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["name"])

    try:
        written = out.mapInArrow(write, T.StructType([T.StructField("name", T.StringType())])).collect()
        for row in written:
            system.move(f"{where}/{run}/{row.name}", f"{where}/{row.name}")
        for name in old if mode == "overwrite" else ():
            system.delete_file(name)
    finally:
        system.delete_dir(f"{where}/{run}")
