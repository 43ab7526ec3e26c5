import random

from cartolith.llm.common import BATCH_BYTES, BATCH_ROWS, Scratch, UnionFind, ascii_words, bounded_batches, components, shared_dir, words_of
from pyspark.sql import functions as F

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_lowered_but_never_raised(spark):
    spark.conf.unset(ROWS)
    spark.conf.unset(BYTES)
    bounded_batches(spark)
    assert spark.conf.get(ROWS) == str(BATCH_ROWS) and spark.conf.get(BYTES).rstrip("b") == str(BATCH_BYTES)
    spark.conf.set(ROWS, "100")
    bounded_batches(spark)
    assert spark.conf.get(ROWS) == "100"
    spark.conf.set(ROWS, str(BATCH_ROWS))


def test_scratch_tables_go_to_the_shared_folder(spark):
    scratch = Scratch(spark)
    saved = scratch.save(spark.range(3).withColumn("x", F.lit(None).cast("string")), "t")
    assert scratch.root.startswith(shared_dir(spark)) and saved.count() == 3 and scratch.root.split(":")[-1].strip("/") in saved.inputFiles()[0]
    scratch.drop(saved)
    assert not spark._jvm.org.apache.hadoop.fs.Path(saved._cartolith_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(saved._cartolith_path))


def test_words(spark):
    text = "\tOne two\x0b\x0cthree\r\n four\xa0five İX "
    assert spark.createDataFrame([(text,)], "t string").select(words_of(F.col("t"))).first()[0] == ["One", "two", "three", "four\xa0five", "İX"]
    assert ascii_words(text) == ["one".encode(), b"two", b"three", "four\xa0five".encode(), "İx".encode()] and ascii_words(None) == []


def test_components_of_paths_stars_and_random_edges(spark):
    rng = random.Random(3)
    path = list(range(1000, 1400))
    rng.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((5000 + k, 5300) for k in range(600)), (7, 7), *((rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300))]
    forest = UnionFind()
    for a, b in edges:
        forest.union(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    scratch = Scratch(spark)
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(7), scratch).collect()
    assert sorted((r.node, r.component) for r in rows) == sorted((x, forest.find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_stars_take_no_round(spark):
    """What is settled isn't gone through again: one table is written."""
    scratch = Scratch(spark)
    edges = spark.createDataFrame([(k, k % 10) for k in range(10, 400)], "a long, b long").repartition(7, "a")
    assert components(edges, scratch).count() == 400 and scratch.made == 1
