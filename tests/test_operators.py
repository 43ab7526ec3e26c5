import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartolith import functions as st
from cartolith.kernels import wkb, wkt
from cartolith.operators import dump_rows, spatial_join
from cartolith.plans import bbox_column, spatial_filter
from cartolith.sources import geo_metadata, read_flatgeobuf, read_geojson, read_geoparquet, write_flatgeobuf, write_geojsonl, write_geoparquet
from cartolith.sources.flatgeobuf import MAGIC, Header, levels
from cartolith.streaming import windowed_extent

WKTS = [
    "POINT(1 2)", "LINESTRING(0 0,1 1.5)", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))", "MULTIPOINT((0 0),(1 1))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))",
    "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION(MULTIPOINT((0 0),(1 1)),POINT(5 5),LINESTRING(0 0,9 9))", None, "POINT(7 7)",
]


@pytest.fixture
def table(spark):
    rows = [(i, f"n{i}", float(i) if i != 2 else None, w) for i, w in enumerate(WKTS)]
    return spark.createDataFrame(rows, "id int, name string, v double, w string").select("id", "name", "v", st.st_geomfromtext("w").alias("geometry"))


def shown(df):
    return sorted((str(r.id), r.name, r.v, r.g) for r in df.select("id", "name", "v", st.st_astext("geometry").alias("g")).collect())


def square(x, y, w):
    return f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + w},{x} {y + w},{x} {y}))"


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(1)
    points = spark.createDataFrame([(i, r.uniform(0, 50), r.uniform(0, 50)) for i in range(300)] + [(900, None, 1.0), (901, 5.0, 5.0), (901, 5.0, 5.0)], "i int, x double, y double").select("i", st.st_point("x", "y").alias("p"))
    squares = spark.createDataFrame([(j, square(r.randint(0, 45), r.randint(0, 45), r.choice([1, 2, 20]))) for j in range(25)] + [(99, None), (98, "POLYGON EMPTY")], "j int, w string")
    return points, squares


@pytest.mark.parametrize("predicate,salt,cell", [("intersects", 1, None), ("within", 3, 3.0), ("coveredby", 1, 100.0)])
def test_spatial_join_is_the_cross_join(sides, predicate, salt, cell):
    points, squares = sides
    want = sorted(map(tuple, points.crossJoin(squares).where(F.call_function(f"st_{predicate}", F.col("p"), st.st_geomfromtext("w"))).select("i", "j").collect()))
    got = sorted(map(tuple, spatial_join(points, squares, "p", "w", predicate, salt=salt, cell=cell).select("i", "j").collect()))
    assert got == want and len(want) > 20
    assert "CartesianProduct" not in spatial_join(points, squares, "p", "w", predicate, cell=cell)._jdf.queryExecution().executedPlan().toString()


def test_other_joins(sides):
    points, squares = sides
    inner = spatial_join(points, squares, "p", "w").select("i").collect()
    met = {r.i for r in inner}
    semi = [r.i for r in spatial_join(points, squares, "p", "w", how="left_semi").select("i").collect()]
    anti = [r.i for r in spatial_join(points, squares, "p", "w", how="left_anti").select("i").collect()]
    every = [r.i for r in points.select("i").collect()]
    assert sorted(semi) == sorted(i for i in every if i in met) and sorted(semi + anti) == sorted(every)
    left = spatial_join(points, squares, "p", "w", how="left")
    assert left.count() == len(inner) + len(anti) and left.columns == ["i", "p", "j", "w"]
    with pytest.raises(ValueError):
        spatial_join(points, squares, "p", "w", how="full")


def test_spatial_filter(sides, spark, tmp_path):
    points, _ = sides
    area = square(0, 0, 10)
    want = sorted(r.i for r in points.where(st.st_intersects("p", st.geom_lit(area))).collect())
    assert sorted(r.i for r in spatial_filter(points, "p", area).collect()) == want and want
    assert spatial_filter(points, "p", area, "disjoint").count() + len(want) == points.where("p is not null").count()
    points.withColumn("bbox", bbox_column("p")).write.parquet(str(tmp_path / "boxed"))
    boxed = spatial_filter(spark.read.parquet(str(tmp_path / "boxed")), "p", area)
    assert sorted(r.i for r in boxed.collect()) == want
    assert "PushedFilters: [IsNotNull(bbox.x" in boxed._jdf.queryExecution().executedPlan().toString()
    assert spatial_filter(points, "p", "POINT EMPTY").count() == 0


def test_extent(spark, sides):
    points, _ = sides
    e = points.repartition(7).agg(st.extent("p").alias("e")).first().e
    want = points.agg(F.min(st.st_x("p")), F.min(st.st_y("p")), F.max(st.st_x("p")), F.max(st.st_y("p"))).first()
    assert tuple(e) == tuple(want)
    assert points.where("false").agg(st.extent("p").alias("e")).first().e is None
    points.createOrReplaceTempView("extent_points")
    assert tuple(spark.sql("SELECT st_extent(p) e FROM extent_points").first().e) == tuple(want)
    assert spark.sql("SELECT st_extent(p) e FROM extent_points WHERE i = 900").first().e is None


def test_columns_and_crs(spark, table):
    df = spark.createDataFrame([(bytes(wkb.write(wkt.read("POINT(1 2)"))), "POINT(3 4)")], "b binary, t string")
    assert df.select(st.st_x(st.as_geom(df, "b")), st.st_y(st.as_geom(df, "t"))).first() == (1.0, 4.0)
    with pytest.raises(TypeError):
        st.as_geom(spark.range(1), "id")
    marked = table.select(st.with_crs("geometry", "g", 4326))
    assert st.crs_of(marked, "g") == "EPSG:4326" and marked.select("g.srid").distinct().where("srid is not null").first().srid == 4326
    assert marked.schema["g"].metadata["ARROW:extension:metadata"] == '{"crs":"EPSG:4326","crs_type":"authority_code"}'
    assert table.select(st.st_convexhull("geometry", coord_type="Separated")).count() == len(WKTS)
    with pytest.raises(ValueError):
        st.st_area("geometry", coord_type="mixed")
    assert "longitude" in st.st_geohash.__doc__


def test_dump_rows(table):
    rows = dump_rows(table.where("id in (0, 6, 7)"), "geometry").select("id", "path", st.st_astext("geom").alias("t")).collect()
    assert sorted((r.id, tuple(r.path), r.t) for r in rows) == [(0, (), "POINT(1 2)"), (6, (1, 1), "POINT(0 0)"), (6, (1, 2), "POINT(1 1)"), (6, (2,), "POINT(5 5)"), (6, (3,), "LINESTRING(0 0,9 9)")]


def test_geojson(spark, table, tmp_path):
    write_geojsonl(table, str(tmp_path / "a"))
    lines = [x for f in Path(tmp_path / "a").glob("part-*") for x in f.read_text().splitlines()]
    assert '{"type":"Feature","id":0,"geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"name":"n0","v":0.0}}' in lines
    assert shown(read_geojson(spark, str(tmp_path / "a"), "name string, v double")) == shown(table)
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[' + ",".join(lines) + "]}")
    assert shown(read_geojson(spark, str(tmp_path / "c.json"), "name string, v double", multiline=True)) == shown(table)


@pytest.mark.parametrize("index", [0, 2, 16])
def test_flatgeobuf(spark, table, tmp_path, index):
    path = str(tmp_path / "f")
    some = table.where("geometry is not null")
    write_flatgeobuf(some.coalesce(1), path, index_node_size=index)
    (file,) = Path(path).glob("*.fgb")
    with open(file, "rb") as f:
        header = Header(f)
    assert header.count == 8 and header.levels == levels(8, index) and file.read_bytes()[:8] == MAGIC
    assert shown(read_flatgeobuf(spark, path)) == shown(some)
    assert sorted(r.id for r in read_flatgeobuf(spark, path, (6.5, 6.5, 8, 8)).select("id").collect()) == [6, 8]
    assert [r.id for r in read_flatgeobuf(spark, path, intersects="POLYGON((6 8,8 8,8 6.5,6 8))").select("id").collect()] == [6]  # its box holds 8 too
    write_flatgeobuf(table, path, "overwrite")
    assert shown(read_flatgeobuf(spark, path)) == shown(table)


def test_flatgeobuf_in_partitions(spark, tmp_path):
    points = spark.range(100).select("id", F.lit(True).alias("flag"), F.col("id").cast("string").alias("s"), F.encode(F.lit("x"), "utf-8").alias("b"), F.current_date().alias("d"), st.st_pointz(F.col("id").cast("double"), F.lit(1.0), F.lit(2.0)).alias("g"))
    write_flatgeobuf(points, str(tmp_path / "p"))
    back = spark.read.format("fgb").option("path", str(tmp_path / "p")).option("features", "7").load()
    assert back.rdd.getNumPartitions() > 10
    assert sorted((r.id, r.flag, r.s, bytes(r.b), r.z) for r in back.select("id", "flag", "s", "b", st.st_z("geometry").alias("z")).collect()) == [(i, True, str(i), b"x", 2.0) for i in range(100)]


def test_geoparquet(spark, table, tmp_path):
    path = str(tmp_path / "g")
    write_geoparquet(table, path, srid=4326)
    assert geo_metadata(spark, path)["columns"]["geometry"]["encoding"] == "WKB"
    df = read_geoparquet(spark, path)
    assert shown(df) == shown(table) and st.crs_of(df, "geometry") == "EPSG:4326"
    near = read_geoparquet(spark, path, bbox=(6.5, 6.5, 8, 8))
    assert sorted(r.id for r in near.select("id").collect()) == [6, 8] and "PushedFilters: [Or(And(And(And(LessThanOrEqual(bbox.xmin" in near._jdf.queryExecution().executedPlan().toString()
    assert dict(read_geoparquet(spark, path, decode=False).dtypes)["geometry"] == "binary"
    table.select("id").write.parquet(str(tmp_path / "plain"))
    assert geo_metadata(spark, str(tmp_path / "plain")) == {}


def test_geoparquet_box_without_or_with_null_covering(spark, table, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    write_geoparquet(table.coalesce(1), str(tmp_path / "g"))
    file = next((tmp_path / "g").glob("*.parquet"))
    whole = pq.read_table(file)
    geo = json.loads(whole.schema.metadata[b"geo"])
    near = lambda path: sorted(r.id for r in read_geoparquet(spark, str(path), bbox=(6.5, 6.5, 8, 8)).select("id").collect())
    null = whole.set_column(whole.schema.get_field_index("bbox"), "bbox", pa.nulls(len(whole), whole.schema.field("bbox").type))
    pq.write_table(null.replace_schema_metadata(whole.schema.metadata), tmp_path / "null.parquet")
    del geo["columns"]["geometry"]["covering"]
    pq.write_table(whole.drop(["bbox"]).replace_schema_metadata({"geo": json.dumps(geo)}), tmp_path / "none.parquet")
    assert near(tmp_path / "g") == near(tmp_path / "null.parquet") == near(tmp_path / "none.parquet") == [6, 8]


def test_geoparquet_modes_and_failed_writes(spark, table, tmp_path):
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    path, marks = str(tmp_path / "g"), tmp_path / "marks"
    marks.mkdir()

    @F.udf("long")
    def once(i):
        """Fails in the first attempt of each task."""
        seen = marks / str(TaskContext.get().partitionId())
        if not seen.exists():
            seen.touch()
            raise RuntimeError("lost")
        return i

    write_geoparquet(table, path)
    n = table.count()
    write_geoparquet(table, path)
    assert read_geoparquet(spark, path).count() == 2 * n
    write_geoparquet(table, path, mode="overwrite")
    assert read_geoparquet(spark, path).count() == n and not list((tmp_path / "g").glob("_temporary*"))
    with pytest.raises(FileExistsError):
        write_geoparquet(table, path, mode="error")
    with pytest.raises(Exception, match="lost"):  # local mode runs a task once: nothing of a failed write is left
        write_geoparquet(table.withColumn("id", once("id")), path, mode="overwrite")
    assert read_geoparquet(spark, path).count() == n and not list((tmp_path / "g").glob("_temporary*"))


def test_native_geoparquet(spark, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    c = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    columns = {
        "point": [c((1, 2))[0], None], "linestring": [c((0, 0), (1, 1)), []], "polygon": [[c((0, 0), (4, 0), (4, 4), (0, 0)), c((2, 1), (3, 1), (3, 2), (2, 1))], None],
        "multipoint": [c((0, 0), (1, 1)), []], "multilinestring": [[c((0, 0), (1, 1)), c((2, 2), (3, 3))], None], "multipolygon": [[[c((0, 0), (1, 0), (1, 1), (0, 0))]], None],
    }
    meta = {"version": "1.1.0", "primary_column": "point", "columns": {n: {"encoding": n, "geometry_types": []} for n in columns}}
    table = pa.table(columns)
    pq.write_table(table.replace_schema_metadata({"geo": json.dumps(meta)}), tmp_path / "n.parquet")
    df = read_geoparquet(spark, str(tmp_path / "n.parquet"))
    first, second = df.select(*[st.st_astext(n).alias(n) for n in columns]).collect()
    assert first.asDict() == {
        "point": "POINT(1 2)", "linestring": "LINESTRING(0 0,1 1)", "polygon": "POLYGON((0 0,4 0,4 4,0 0),(2 1,3 1,3 2,2 1))", "multipoint": "MULTIPOINT((0 0),(1 1))",
        "multilinestring": "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "multipolygon": "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))",
    }
    assert second.asDict() == {"point": None, "linestring": "LINESTRING EMPTY", "polygon": None, "multipoint": "MULTIPOINT EMPTY", "multilinestring": None, "multipolygon": None}


def test_wkb_of_other_encodings():
    big = struct.pack(">BIdd", 0, 1, 1.5, -2.0)
    extended = struct.pack("<BIIddd", 1, 1 | 0x80000000 | 0x20000000, 4326, 1.0, 2.0, 3.0)
    assert wkt.write(wkb.read(big)) == "POINT(1.5 -2)" and wkt.write(wkb.read(extended)) == "POINT Z(1 2 3)" and wkb.read(extended).srid == 4326
    with pytest.raises(ValueError):
        wkb.read(b"\x01\x02")
    with pytest.raises(ValueError):
        wkt.read("GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT(0 0)))")


def test_stream_of_extents(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", float(h), float(-h)) for h in range(6)], "t string, x double, y double").select(F.to_timestamp("t").alias("t"), "x", "y")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).select("t", st.st_point("x", "y").alias("p"))
    query = windowed_extent(stream, "t", "p", "2 hours").writeStream.outputMode("complete").format("memory").queryName("extents").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    streamed = sorted((r.window.start, r.n, tuple(r.extent)) for r in spark.table("extents").collect())
    batch = windowed_extent(rows.select("t", st.st_point("x", "y").alias("p")), "t", "p", "2 hours")
    assert streamed == sorted((r.window.start, r.n, tuple(r.extent)) for r in batch.collect()) and len(streamed) == 3
