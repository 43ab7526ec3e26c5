"""GeoParquet over many files: entries put together, differences refused, folders."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cartolith import functions as st
from cartolith.sources import geo_metadata, geoparquet, read_geoparquet, write_geoparquet


def points(spark, a, b):
    return spark.range(a, b).select("id", st.st_point(F.col("id").cast("double"), F.lit(1.0)).alias("geometry"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def change(folder, edit):
    """Rewrites the entries of a folder's files."""
    for file in folder.glob("*.parquet"):
        t = pq.read_table(file)
        geo = json.loads(t.schema.metadata[b"geo"])
        edit(geo)
        pq.write_table(t.replace_schema_metadata({"geo": json.dumps(geo)}), file)


def test_files_that_agree(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        write_geoparquet(points(spark, 10 * i, 10 * i + 10).coalesce(1), path, srid=4326)
    boxes = iter([[0, 1, 9, 2], [5, -1, 20, 1], [7, 0, 8, 0], [1, 1, 1, 1]])
    change(tmp_path / "t", lambda geo: geo["columns"]["geometry"].update(bbox=next(boxes), geometry_types=["Point"]))
    geo = geo_metadata(spark, path)
    assert geo["columns"]["geometry"]["bbox"] == [0, -1, 20, 2] and geo["columns"]["geometry"]["geometry_types"] == ["Point"] and "covering" in geo["columns"]["geometry"]
    assert ids(read_geoparquet(spark, path)) == list(range(40)) and ids(read_geoparquet(spark, path, bbox=(8, 0, 21, 2))) == list(range(8, 22))


def test_files_that_differ(spark, tmp_path):
    path = str(tmp_path / "t")
    write_geoparquet(points(spark, 0, 3), path, srid=4326)
    write_geoparquet(points(spark, 3, 6), path, srid=3857)
    with pytest.raises(ValueError, match="crs of geometry"):
        read_geoparquet(spark, path)
    change(tmp_path / "t", lambda geo: geo["columns"]["geometry"].update(crs=None))
    assert ids(read_geoparquet(spark, path)) == list(range(6))
    pq.write_table(pa.table({"id": pa.array([9], pa.int64())}), tmp_path / "t" / "plain.parquet")
    with pytest.raises(ValueError, match="no .geo. entry"):
        geo_metadata(spark, path)


def test_a_covering_that_some_files_have(spark, tmp_path):
    path = str(tmp_path / "t")
    write_geoparquet(points(spark, 0, 5).coalesce(1), path)
    change(tmp_path / "t", lambda geo: geo["columns"]["geometry"].pop("covering"))
    for file in (tmp_path / "t").glob("*.parquet"):
        t = pq.read_table(file)
        gone = t.set_column(t.schema.get_field_index("bbox"), "bbox", pa.nulls(len(t), t.schema.field("bbox").type))
        pq.write_table(gone.replace_schema_metadata(t.schema.metadata), file)
    write_geoparquet(points(spark, 5, 10).coalesce(1), path)
    assert "covering" in geo_metadata(spark, path)["columns"]["geometry"]
    assert ids(read_geoparquet(spark, path, bbox=(3, 0, 6, 2))) == [3, 4, 5, 6]


def test_entries_one_by_one():
    entry = lambda f, **spec: geoparquet.Entry(json.dumps({"version": "1.1.0", "primary_column": "g", "columns": {"g": {"encoding": "WKB", **spec}}}), f)
    a, b = entry("a", geometry_types=["Point"], bbox=[0, 0, 1, 1]), entry("b", geometry_types=[], bbox=[0, 0, 0, 1, 1, 1])
    (one,) = geoparquet.together([a, b])
    assert one.files == 2 and one.whole()["columns"]["g"] == {"encoding": "WKB", "geometry_types": []}
    assert len(geoparquet.together([entry("a"), entry("b", crs=None), geoparquet.Entry(None, "c"), entry("d", edges="spherical")])) == 4
    x, y = entry("a", covering={"bbox": {"xmin": ["b", "x"]}}), entry("b", covering={"bbox": {"xmin": ["c", "x"]}})
    assert "covering" not in geoparquet.together([x, y])[0].whole()["columns"]["g"]


def test_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    write_geoparquet(points(spark, 0, 3), path + "/part=1", srid=4326)
    write_geoparquet(points(spark, 3, 6), path + "/part=2", srid=4326)
    df = read_geoparquet(spark, path)
    assert ids(df) == list(range(6)) and ids(df.where("part = 2")) == [3, 4, 5] and st.crs_of(df, "geometry") == "EPSG:4326"
    deep = str(tmp_path / "d")
    write_geoparquet(points(spark, 0, 3), deep + "/x y/z")
    write_geoparquet(points(spark, 3, 6), deep + "/w")
    assert ids(read_geoparquet(spark, deep, recursive=True)) == list(range(6))
    (tmp_path / "none").mkdir()
    assert geo_metadata(spark, str(tmp_path / "none")) == {}
