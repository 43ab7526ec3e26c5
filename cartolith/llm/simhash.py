"""SimHash near-duplicates by multi-index hashing, and their completion to a similarity of shingle sets.

Distinct fingerprints are split into segments. By the pigeonhole rule two fingerprints within
``distance`` differ by at most ``distance // segments`` bits in some segment, so each enumerates a small
Hamming ball of every segment and is put in the buckets of these values. Rows of a bucket are compared
over the whole fingerprint as sorted runs; a run gives the edges of a spanning forest, never all pairs.

``one_of_each`` asks for a similarity of shingle sets. Sets of similarity 0.8 differ by some ten bits of 64,
far beyond any radius that can be enumerated, so fingerprints give the close pairs, which hold large groups
together, and ``jaccard`` the rest; all pairs are verified by their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import Scratch, ascii_words, components, row_hashes, simhash_bits, spanning_edges

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Up to so many distinct fingerprints three segments keep buckets small; beyond, two of 32 bits.
THREE_SEGMENTS = 1 << 27
#: Runs longer than this are compared by leaders rather than by offsets.
LONG_RUN = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; zero without words."""
    words = ascii_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype="<u8")
    return simhash_bits(h)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): fingerprints as signed longs."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints, "id long, print long")


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    widths = [22, 21, 21] if n <= THREE_SEGMENTS else [32, 32]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def _probes(parts: list[tuple[int, int]]) -> Callable:
    """Bucket rows of fingerprints.

    Three segments: some segment differs by one bit at most, so it's enough that the one with a zero
    there also takes the bucket with a one. Two: by two bits at most, so both take their ball of
    radius one and meet halfway.
    """
    upward = len(parts) == 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for step in range(0, len(f), 8192):
                g, keys, prints = f[step : step + 8192], [], []
                for k, (shift, width) in enumerate(parts):
                    value = (g >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    base = np.uint64(k << 33)
                    keys.append(value | base)
                    prints.append(g)
                    for bit in range(width):
                        one = np.uint64(1 << bit)
                        some = (value & one) == 0 if upward else slice(None)
                        keys.append((value[some] ^ one) | base)
                        prints.append(g[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(prints).view(np.int64))], names=["key", "print"])

    return run


def _linked_runs(distance: int) -> Callable:
    """Edges within the runs of equal keys of sorted partitions."""

    def edges_of(key: np.ndarray, f: np.ndarray) -> np.ndarray:
        if len(f) < 2:
            return np.empty((0, 2), np.uint64)
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        length = np.diff(bounds)
        found = []
        short = np.repeat(length <= LONG_RUN, length)
        for d in range(1, int(min(LONG_RUN, length.max(initial=0)))):
            i = np.flatnonzero((key[:-d] == key[d:]) & short[d:])
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= distance]
            found.append(np.stack([f[i], f[i + d]], axis=1))
        for k in np.flatnonzero(length > LONG_RUN).tolist():
            run = np.unique(f[bounds[k] : bounds[k + 1]])
            pairs = spanning_edges(len(run), lambda i, j, run=run: np.bitwise_count(run[i][:, None] ^ run[j][None, :]) <= distance)
            if pairs:
                found.append(run[np.array(pairs)])
        return np.concatenate(found) if found else np.empty((0, 2), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(key, f):
            e = np.unique(np.sort(edges_of(key, f).view(np.int64), axis=1), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            yield out(key[:cut], f[:cut])
            held_k, held_f = key[cut:], f[cut:]
        yield out(held_k, held_f)

    return run


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints that connect all those within the distance."""
    if not 0 <= distance <= 5:
        raise ValueError("distance must be 0 to 5")
    buckets = prints.mapInArrow(_probes(segments(prints.count())), "key long, print long")
    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(_linked_runs(distance), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, scratch: Scratch | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal ids keep a row
    each. Null ids stay rows and take part in links, but never name a component. Empty tables give none.
    ``distance`` at most 5, the most that both divisions into segments find.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    prints = scratch.save(fingerprints(docs, id_col, text_col), "prints")
    nodes = scratch.save(prints.groupBy("print").agg(F.min("id").alias("least")), "nodes")
    member = components(links(nodes.select("print"), distance), scratch)
    named = nodes.join(member, nodes["print"] == member["node"], "left").select("print", "least", F.coalesce("component", "print").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(roots, "root").select("print", "component_id"), "classes")
    return prints.join(named, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = jaccard.SHINGLE, similarity: float = jaccard.SIMILARITY, distance: int = DISTANCE, scratch: Scratch | None = None) -> DataFrame:
    """One row of each component of documents linked by the similarity of shingle sets, all columns of the input.

    The row with the smallest id is kept, nulls first, and of rows with equal ids the one with the
    smallest hash. Null and empty texts are one component. Rows are told apart by all of their columns,
    so ids may be null or repeat.
    """
    ratio, names = jaccard.fraction(similarity), docs.columns
    scratch = scratch or Scratch(docs.sparkSession)
    h1, h2 = row_hashes(names)
    texts = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).cast("string").alias("text"))
    nodes = jaccard.classes(texts, shingle, ratio, scratch)
    prints = scratch.save(nodes.groupBy("print").agg(F.min("node").alias("rep")), "prints")
    same = nodes.select("node", "print").join(prints, "print").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    one, two = (prints.select(F.col("print").alias(x), F.col("rep").alias(f"r{x}")) for x in "ab")
    near = links(prints.select("print"), distance).join(one, "a").join(two, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    member = jaccard.completed(nodes, texts.drop("id"), same.unionByName(near), shingle, ratio, scratch)
    named = nodes.select("node", "least").join(member, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("least").alias("kept"))
    kept = named.select(F.col("kept.h1").alias("_h1"), F.col("kept.h2").alias("_h2"))
    keyed = docs.select(h1.alias("_h1"), h2.alias("_h2"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"))
    return keyed.join(kept, ["_h1", "_h2"], "left_semi").dropDuplicates(["_h1", "_h2"]).select("_row.*")
