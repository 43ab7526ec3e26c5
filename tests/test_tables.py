"""Tables by path."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cartolith import functions as st
from cartolith.register import register_all
from cartolith.sources import copy_to, open_table, register_table


@pytest.fixture(scope="module")
def points(spark):
    rows = spark.range(12).select("id", F.concat(F.lit("n"), "id").alias("name"), st.st_point(F.col("id").cast("double"), F.lit(1.0)).alias("geometry"))
    rows.createOrReplaceTempView("some_points")
    return rows


@pytest.mark.parametrize("extension", ["fgb", "geojsonl", "parquet", "geoparquet"])
def test_copies(spark, points, tmp_path, extension):
    path = str(tmp_path / f"out.{extension}")
    copy_to(spark, "some_points", path)
    with pytest.raises((FileExistsError, AnalysisException)):
        copy_to(spark, "some_points", path)
    register_table(spark, "copied", path)
    shown = spark.sql("SELECT CAST(id AS INT) id, name, st_astext(geometry) t FROM copied WHERE st_x(geometry) < 3 ORDER BY id").collect()
    assert [tuple(r) for r in shown] == [(i, f"n{i}", f"POINT({i} 1)") for i in range(3)]
    copy_to(spark, "SELECT * FROM some_points WHERE id < 2", path, "append")
    assert open_table(spark, path).count() == 14
    copy_to(spark, points.where("id = 7"), path, "overwrite")
    assert [r.name for r in open_table(spark, path).collect()] == ["n7"]


def test_collections_and_refusals(spark, tmp_path):
    feature = '{"type":"Feature","properties":{"a":%d},"geometry":{"type":"Point","coordinates":[%d,2]}}'
    (tmp_path / "x.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join(feature % (i, i) for i in range(3)) + "]}")
    found = open_table(spark, str(tmp_path / "x.geojson"))
    assert sorted((r.a, r.x) for r in found.select("a", st.st_x("geometry").alias("x")).collect()) == [(0, 0), (1, 1), (2, 2)]
    for bad in ("x.shp", "folder"):
        with pytest.raises(ValueError, match="no format"):
            open_table(spark, bad)
    with pytest.raises(ValueError, match="written"):
        copy_to(spark, found, str(tmp_path / "y.geojson"))
    with pytest.raises(ValueError, match="mode"):
        copy_to(spark, found, str(tmp_path / "y.fgb"), "ignore")


def test_the_format_is_registered_with_the_functions(spark, points, tmp_path):
    register_all(spark)
    copy_to(spark, points, str(tmp_path / "p.fgb"))
    assert spark.read.format("fgb").option("path", str(tmp_path / "p.fgb")).load().count() == 12
