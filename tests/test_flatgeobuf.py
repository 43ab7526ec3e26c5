"""FlatGeobuf: conditions, columns and planning of reads; ordered, bounded and repeated writes."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith import functions as st
from cartolith.sources import flatgeobuf, read_flatgeobuf, write_flatgeobuf
from cartolith.sources.flatgeobuf import NODE, FlatGeobufSource, Header, dealt, hilbert, leaves, subtrees


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    """10,000 points of a grid in several files."""
    path = str(tmp_path_factory.mktemp("grid") / "g")
    rows = spark.range(10_000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).cast("double").alias("v"), st.st_point((F.col("id") % 100).cast("double"), F.floor(F.col("id") / 100).cast("double")).alias("geometry"))
    write_flatgeobuf(rows, path, file_bytes=200_000)
    return path


def fetched(df):
    """Rows that the query returns, and how many features it fetched and geometries it decoded."""
    rows, found = df.collect(), {}

    def walk(node):
        text = node.toString().split("\n")[0]
        if node.nodeName() == "ArrowEvalPython":
            for name in ("fetched", "parse"):
                if name + "(" in text:
                    found[name] = found.get(name, 0) + node.metrics().get("pythonNumRowsReceived").get().value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, found


class Counted:
    """A stream that counts what is read."""

    def __init__(self, stream):
        self.stream, self.bytes = stream, 0

    def seek(self, at):
        self.stream.seek(at)

    def read(self, n):
        data = self.stream.read(n)
        self.bytes += len(data)
        return data


def test_conditions_in_sql_save_fetching(spark, grid):
    read_flatgeobuf(spark, grid, boxes=True).createOrReplaceTempView("grid")
    rows, n = fetched(spark.sql("SELECT id FROM grid WHERE bbox.xmin <= 12 AND bbox.xmax >= 10.5 AND bbox.ymin < 3 AND bbox.ymax >= 1"))
    assert sorted(r.id for r in rows) == [y * 100 + x for y in (1, 2) for x in (11, 12)] and n["fetched"] == 4
    rows, n = fetched(spark.sql("SELECT id FROM grid WHERE bbox.xmin = 5 AND bbox.ymin > 97"))
    assert sorted(r.id for r in rows) == [9805, 9905] and n["fetched"] == 2
    rows, n = fetched(spark.sql("SELECT id, bbox FROM grid WHERE bbox.xmin > 1e9"))
    assert rows == [] and n["fetched"] == 0
    # a query doesn't see another one's conditions, nor one side of a join those of the other
    assert spark.sql("SELECT id FROM grid WHERE bbox.xmin <= 1 OR id = 5").count() == 201
    assert spark.sql("SELECT a.id FROM grid a JOIN grid b ON a.id = b.id + 1 WHERE a.bbox.xmin = 4 AND b.bbox.xmin = 3").count() == 100


def test_columns_that_nobody_wants_are_not_parsed(spark, grid):
    df = read_flatgeobuf(spark, grid, boxes=True)
    plan = lambda q: q._jdf.queryExecution().executedPlan().toString()
    assert plan(df.select("id")).count("parse(") == 1 and plan(df).count("parse(") == 4
    assert "ArrowEvalPython" not in plan(df.select("bbox.xmin")) and df.select("bbox.xmin").agg(F.max("xmin")).first()[0] == 99
    rows, n = fetched(df.where("id = 77").select("name", "geometry"))
    assert [r.name for r in rows] == ["n77"] and n["parse"] == 10_001  # the geometry of one row alone
    assert df.agg(F.sum("id"), F.sum("v")).first()[:] == (49_995_000, float(sum(i % 7 for i in range(10_000))))


def test_the_source_takes_a_schema_of_some_columns(spark, grid):
    some = spark.read.format("fgb").option("path", grid).schema("v double, id long").load()
    assert some.columns == ["v", "id"] and some.agg(F.sum("id")).first()[0] == 49_995_000
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW direct USING fgb OPTIONS (path '{grid}', boxes 'true', bbox '0,0,1,1')")
    assert sorted(r.id for r in spark.sql("SELECT id, bbox.xmin FROM direct").collect()) == [0, 1, 100, 101]


def test_a_shape_is_looked_up_in_the_index(spark, grid):
    near = read_flatgeobuf(spark, grid, intersects="POLYGON((0 0,4 0,0 4,0 0))", boxes=True)
    assert len(near.collect()) == 15 and {"bbox", "name"} <= set(near.columns)
    assert read_flatgeobuf(spark, grid, (0, 0, 1, 1), "POLYGON Z((0 0 1,4 0 1,0 4 1,0 0 1))").count() == 4


def test_the_driver_reads_upper_levels_only(grid):
    rng = np.random.default_rng(4)
    for file in Path(grid).glob("*.fgb"):
        with open(file, "rb") as f:
            header = Header(f)
            every = [(tuple(b), s) for boxes, begin, _ in leaves(f, header, [(0, header.count)], None) for b, s in zip(boxes.tolist(), begin.tolist(), strict=True)]
            assert len(every) == header.count and [s for _, s in every] == sorted(s for _, s in every)
            for features in (1, 40, 65536):
                x, y = rng.integers(0, 100, 2).tolist()
                box = (x - 2.0, y - 2.0, x + 2.0, y + 2.0)
                counted = Counted(f)
                parts = dealt(subtrees(counted, header, box, features), features)
                assert counted.bytes <= NODE * header.levels[-1][0] and all(sum(b - a for a, b in p) <= features for p in parts)
                found = sorted(s for p in parts for _, begin, _ in leaves(f, header, p, box) for s in begin.tolist())
                assert found == [s for b, s in every if b[0] <= box[2] and b[2] >= box[0] and b[1] <= box[3] and b[3] >= box[1]]
            assert dealt(subtrees(Counted(f), header, None, 1000), 1000)[0] == [(0, min(1000, header.count))]


def test_features_in_any_order(tmp_path, spark):
    """Files whose features don't follow their index are read too."""
    path = tmp_path / "x"
    write_flatgeobuf(spark.range(50).select("id", st.st_point(F.col("id").cast("double"), F.lit(0.0)).alias("geometry")).coalesce(1), str(path))
    (file,) = path.glob("*.fgb")
    data = file.read_bytes()
    with open(file, "rb") as f:
        header = Header(f)
    body, first = data[header.features_at :], header.index_at + NODE * header.levels[-1][0]
    nodes = [struct.unpack_from("<4dQ", data, first + NODE * i) for i in range(50)]
    order = np.random.default_rng(1).permutation(50).tolist()
    sizes = [4 + struct.unpack_from("<I", body, n[4])[0] for n in nodes]
    moved, at = {}, 0
    for i in order:
        moved[i] = at
        at += sizes[i]
    new = b"".join(struct.pack("<4dQ", *n[:4], moved[i]) for i, n in enumerate(nodes))
    file.write_bytes(data[:first] + new + b"".join(body[nodes[i][4] : nodes[i][4] + sizes[i]] for i in order))
    assert sorted(r.id for r in read_flatgeobuf(spark, str(path)).collect()) == list(range(50))
    assert sorted(r.id for r in read_flatgeobuf(spark, str(path), bbox=(7, 0, 9, 0)).collect()) == [7, 8, 9]


def test_files_are_bounded_and_apart(spark, grid):
    files = list(Path(grid).glob("*.fgb"))
    assert len(files) > 4 and max(f.stat().st_size for f in files) < 300_000
    area = 0
    for file in files:
        with open(file, "rb") as f:
            header = Header(f)
            (box,) = (n for n in flatgeobuf._nodes(f, header, 0, 1)["box"])
            area += (box[2] - box[0]) * (box[3] - box[1])
    assert area < 1.5 * 99 * 99  # random files would take that each
    assert not list(Path(grid).glob("_temporary*"))


def test_a_task_that_runs_twice_leaves_no_duplicate(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(30).select("id", st.st_point(F.col("id").cast("double"), F.lit(0.0)).alias("geometry"))
    batches = rows.toArrow().to_batches()
    writer = FlatGeobufSource({"path": path}).writer(rows.schema, False)
    writer.write(iter(batches))
    writer.commit([writer.write(iter(batches)), None])
    assert sorted(r.id for r in read_flatgeobuf(spark, path).collect()) == list(range(30)) and len(list(Path(path).iterdir())) == 1
    again = FlatGeobufSource({"path": path}).writer(rows.schema, True)
    again.write(iter(batches))
    again.abort([None])
    assert sorted(r.id for r in read_flatgeobuf(spark, path).collect()) == list(range(30)) and len(list(Path(path).iterdir())) == 1


def test_a_failed_overwrite_keeps_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(30).select("id", st.st_point(F.col("id").cast("double"), F.lit(0.0)).alias("geometry"))
    write_flatgeobuf(rows, path)
    bad = rows.withColumn("id", F.when(F.col("id") == 29, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        write_flatgeobuf(bad, path, "overwrite", ordered=False)
    assert read_flatgeobuf(spark, path).count() == 30 and not list(Path(path).glob("_temporary*"))
    write_flatgeobuf(rows.where("id < 3"), path, "overwrite")
    assert read_flatgeobuf(spark, path).count() == 3


def test_dimensions_and_missing_geometries_go_to_files_of_their_own(spark, tmp_path):
    path = str(tmp_path / "m")
    wkts = ["POINT(1 2)", None, "POINT Z(1 2 3)", "LINESTRING(0 0,5 5)", "POINT EMPTY", "POINT Z(7 8 9)"]
    rows = spark.createDataFrame(list(enumerate(wkts)), "id int, w string").select("id", st.st_geomfromtext("w").alias("geometry"))
    write_flatgeobuf(rows, path)
    back = {r.id: r.t for r in read_flatgeobuf(spark, path).select("id", st.st_astext("geometry").alias("t")).collect()}
    assert back == {r.id: r.t for r in rows.select("id", st.st_astext("geometry").alias("t")).collect()}
    assert sorted(r.id for r in read_flatgeobuf(spark, path, bbox=(1, 2, 1, 2)).collect()) == [0, 2, 3]
    plain = str(tmp_path / "unindexed")
    write_flatgeobuf(rows.where("id <> 2 AND id <> 5"), plain, index_node_size=0)
    found = read_flatgeobuf(spark, plain, boxes=True)
    assert sorted((r.id, r.bbox and tuple(r.bbox)) for r in found.collect()) == [(0, (1, 2, 1, 2)), (1, None), (3, (0, 0, 5, 5)), (4, None)]
    assert sorted(r.id for r in read_flatgeobuf(spark, plain, bbox=(1, 2, 1, 2)).collect()) == [0, 3]
    write_flatgeobuf(rows.where("false"), str(tmp_path / "none"))
    assert not list(Path(tmp_path / "none").glob("*.fgb"))


def test_the_curve(spark):
    n = 1 << 5
    x, y = (v.ravel() << 11 for v in np.meshgrid(np.arange(n), np.arange(n)))
    order = np.argsort(hilbert(x, y))
    steps = np.abs(np.diff(x[order] >> 11)) + np.abs(np.diff(y[order] >> 11))
    assert (steps == 1).all()
    rng = np.random.default_rng(2)
    points = [(float(a), float(b)) for a, b in rng.random((300, 2))] + [(0.0, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame(points, "x double, y double").select("x", "y", flatgeobuf.hilbert_key(st.st_point("x", "y"), (0.0, 0.0, 1.0, 1.0)).alias("d"))
    got = df.collect()
    assert [r.d for r in got] == hilbert(*(np.array([r[i] for r in got]) * 65535 for i in (0, 1))).tolist()


def test_clashing_names(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("bbox"), st.st_point(F.lit(1.0), F.lit(2.0)).alias("geometry"))
    write_flatgeobuf(rows, str(tmp_path / "c"))
    assert sorted(r.bbox for r in read_flatgeobuf(spark, str(tmp_path / "c")).collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="bbox"):
        read_flatgeobuf(spark, str(tmp_path / "c"), boxes=True).count()
