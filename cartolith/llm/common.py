"""Shared pieces of the corpus operators: scratch tables, word expressions, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java regex class and as literal characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is made only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="cartolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows and bytes of the batches in which rows are handed to Python, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches to those above, if they are higher.

    A batch is held, outside the heap and more than once, by every running task: with whole texts in the
    rows, the default of 10,000 rows takes hundreds of megabytes an executor.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        digits = re.match(r"\d+", spark.conf.get(key))
        if not digits or not 0 < int(digits[0]) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written to the shared folder, to cut lineage; ``drop`` deletes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/cartolith-{uuid.uuid4().hex}"
        self.made = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)  # with the driver

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._cartolith_path = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(df._cartolith_path)
            path.getFileSystem(conf).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_hashes(names: list[str]) -> tuple[Column, Column]:
    """128 bits of a row. Hashes skip nulls, so their places are hashed too."""
    columns = [F.col(f"`{n}`") for n in names]
    nulls = [c.isNull() for c in columns]
    return F.xxhash64(*columns, *nulls), F.xxhash64(F.lit(1), *columns, *nulls)


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash_bits(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    h, ones = np.asarray(h, "<u8"), np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


# --- connected components -------------------------------------------------------------------------


class UnionFind:
    """Union by smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if a > b:
                a, b = b, a
            self.parent[b] = a
            self.parent.setdefault(a, a)


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it reaches) that connect what the edges a-b do."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):  # of the ends and of what they are labelled with
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


#: Edges of a partition that are held before they are contracted.
HELD_EDGES = 1 << 21
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition by stars: each node, once, with the smallest node it reaches."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy())
        if len(a) > HELD_EDGES:  # stars need no more room than their nodes
            a, b = star_edges(a, b)
    a, b = star_edges(a, b)
    for i in range(0, len(a), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536]), pa.array(b[i : i + 65536])], schema=_EDGES)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has a link; component: smallest node reachable.

    ``edges``: two long columns a, b. Rounds over a table, until it holds stars alone: each edge moves to the
    smallest neighbour of its smaller end, then the edges of a larger end meet; after either, partitions are
    contracted by union-find. That keeps what is connected and lowers the sum of all ends, unless all are
    stars. Nothing is gathered on the driver but a count a round.
    """

    def contracted(e: DataFrame) -> DataFrame:
        return e.mapInArrow(_contract, "a long, b long")

    def settled(e: DataFrame) -> bool:
        """Whether each larger end has one edge and is no smaller end."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n"))
        return not ends.where("n > 1").agg(F.count(F.lit(1))).first()[0]

    now = scratch.save(contracted(edges.toDF("a", "b").where("a <> b")), "links")
    while not settled(now):
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        moved = contracted(now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")))
        after = scratch.save(contracted(moved.repartition("a")), "links")
        scratch.drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def spanning_edges(n: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 512) -> list[tuple[int, int]]:
    """Edges that connect 0..n-1 just as all pairs with ``close`` do, without making all pairs.

    Leaders take the nodes close to them; nodes of different components alone are compared after that,
    so a dense group costs nodes times leaders. ``close(i, j)``: matrix of booleans for index arrays.
    """
    forest, edges, rest = UnionFind(), [], np.arange(n)
    while len(rest):
        near = close(rest[:1], rest)[0]
        near[0] = True
        for j in rest[near][1:].tolist():
            forest.union(int(rest[0]), j)
            edges.append((int(rest[0]), j))
        rest = rest[~near]
    label = np.array([forest.find(i) for i in range(n)])
    for i in range(0, n, block):
        if (label == label[0]).all():
            break
        mine = np.arange(i, min(n, i + block))
        other = np.flatnonzero(np.arange(n) > i)
        hit = close(mine, other) & (label[mine][:, None] != label[other][None, :])
        for x, y in zip(*np.nonzero(hit), strict=True):
            a, b = int(mine[x]), int(other[y])
            if forest.find(a) != forest.find(b):
                forest.union(a, b)
                edges.append((a, b))
                label = np.array([forest.find(k) for k in range(n)])
    return edges
