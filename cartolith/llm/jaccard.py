"""What SimHash near-duplicates leave to be found: exact Jaccard similarity of the sets of word shingles.

Prefix filter: with the shingles of all sets in one order, two sets of similarity t share a shingle among
the first n - ceil(t n) + 1 of each. The order is by hash, with the most common shingles last, so most
buckets are small. Pairs of a bucket are first held against what the prefixes leave possible, then
compared by whole sets. Equal sets are one node. Large buckets are first compared with leaders, in one pass, so that
groups of copies become one component, then all pairs of different components. There a pair becomes a row only
if the parities of both sets' shingles in ``SKETCH`` places differ in no more places than similar sets may in
shingles. No pair is lost.
Shingles are told apart by 64-bit hashes, sets and rows by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_words, components, simhash_bits

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: One document of so many is counted for the order; shingles of so many of these go last, and at most
#: so many shingles. They decide the size of buckets, not what is found.
SAMPLE, COMMON_DOCS, COMMON = 8, 3, 1 << 19
#: Buckets up to this size give all their pairs at once; larger ones after a pass of leaders.
SHORT_RUN = 32
#: Places of a set's sketch, a multiple of 64: sets of up to about 2.3 times as many shingles are told apart by it.
SKETCH = 1024
#: Pairs of an output batch, about.
PAIRS = 1 << 16


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words none."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype=np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each place: sets differ in at least as many shingles as sketches in places."""
    odd = np.bincount((s % np.uint64(SKETCH)).astype(np.intp), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)))


def _hashes(shingle: int) -> Callable:
    """One row a shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle).view(np.int64))], names=["h"])

    return run


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], names=["h"])


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the most common shingles of a sample of the texts."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(_hashes(shingle), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON_DOCS)
    most = counts.orderBy(F.desc("c"), "h").limit(COMMON).select("h").mapInArrow(_blobs, "h binary")
    return np.sort(np.frombuffer(b"".join(r.h for r in most.collect()), np.uint64))


def _prefixes(shingle: int, ratio: Fraction, common) -> Callable:
    """Adds to each row the digest, size and fingerprint of its set, and the shingles of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            d1, d2, sizes, prints, prefixes, sketches = [], [], [], [], [], []
            for text in batch.column(3):
                s = shingles(text.as_py(), shingle)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                d1.append(whole >> 64)
                d2.append(whole & (1 << 64) - 1)
                sizes.append(len(s))
                prints.append(simhash_bits(s))
                sketches.append(sketch(s))
                late = np.zeros(len(s), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                n = len(s) - -(-ratio.numerator * len(s) // ratio.denominator) + 1 if len(s) else 0
                prefixes.append(np.concatenate([s[~late], s[late]])[:n])
            arrays = [*batch.columns[:3], *(pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2, prints)), pa.array(sizes, pa.int64()), _lists(prefixes), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "h1", "h2", "d1", "d2", "print", "size", "prefix", "sketch"])

    return run


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], names=["node", "shingles"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted partitions, cut where the first one changes."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _close_sizes(a: np.ndarray, b: np.ndarray, ratio: Fraction) -> np.ndarray:
    return np.minimum(a, b) * ratio.denominator >= np.maximum(a, b) * ratio.numerator


def _close_sketches(a: np.ndarray, b: np.ndarray, total: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Whether sets of so many shingles together may be similar: such sets differ in (1 - t) / (1 + t) of them at most."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) * (ratio.denominator + ratio.numerator) <= total * (ratio.denominator - ratio.numerator)


def _short_runs(ratio: Fraction) -> Callable:
    """(a, b) of the pairs of short runs; the rows of long ones as (key, a, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, size in _runs(batches):
            length = np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]))
            short = np.repeat(length <= SHORT_RUN, length)
            found = []
            for d in range(1, min(SHORT_RUN, int(length.max()))):
                i = np.flatnonzero((key[:-d] == key[d:]) & short[d:])
                i = i[_close_sizes(size[i], size[i + d], ratio)]
                found.append(np.sort(np.stack([node[i], node[i + d]], axis=1), axis=1))
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], names=["key", "a", "b", "size"])
            rest = ~short
            yield pa.RecordBatch.from_arrays([pa.array(key[rest]), pa.array(node[rest]), pa.nulls(int(rest.sum()), pa.int64()), pa.array(size[rest])], names=["key", "a", "b", "size"])

    return run


def _across(ratio: Fraction, leaders: bool) -> Callable:
    """(a, b, ca, cb) of the pairs of different components ca and cb of a run: all, or those with leaders.

    Components that no leader took give leaders, the largest first; each takes the components that hold rows
    close to it. So a row is in one pair with a leader at most.
    """

    def of_run(node: np.ndarray, size: np.ndarray, part: np.ndarray, sketches: np.ndarray) -> Iterator[np.ndarray]:
        names, first, at, count = np.unique(part, return_index=True, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        bits, taken = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(node), -1), np.zeros(len(names), bool)
        for i in first[np.argsort(-count, kind="stable")].tolist() if leaders else range(len(node)):
            if taken[at[i]]:
                continue
            other = (at != at[i]) & _close_sizes(size, size[i], ratio)
            if leaders:
                taken[at[i]] = True
                other &= ~taken[at]
            else:
                other[:i] = False
            other = np.flatnonzero(other)
            x = other[_close_sketches(bits[other], bits[i], size[other] + size[i], ratio)]
            if leaders:
                taken[at[x]] = True
            up = node[x] > node[i]
            ends = [(np.full(len(x), y[i]), y[x]) for y in (node, part)]
            yield np.stack([z for a, b in ends for z in (np.where(up, a, b), np.where(up, b, a))], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([np.empty((0, 4), np.int64), *found]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T.copy()], names=["a", "b", "ca", "cb"])

        found, held = [], 0
        for key, node, size, part, sketches in _runs(batches):
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
            for s, e in zip(bounds, bounds[1:], strict=False):
                for pairs in of_run(node[s:e], size[s:e], part[s:e], sketches[s:e]):
                    found.append(pairs)
                    held += len(pairs)
                    if held >= PAIRS:
                        yield out(found)
                        found, held = [], 0
        yield out(found)

    return run


def completed(nodes: DataFrame, texts: DataFrame, also: DataFrame, shingle: int, ratio: Fraction, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes that have a link, and maybe of others. ``texts``: h1, h2, text. ``also``:
    (a, b), a < b, of more pairs to verify; those that connect large groups save pairs."""
    keys = nodes.select(F.explode("prefix").alias("key"), "node", "size").repartition("key").sortWithinPartitions("key")
    found = scratch.save(keys.mapInArrow(_short_runs(ratio), "key long, a long, b long, size long"), "buckets")
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "size")
    num, den = ratio.numerator, ratio.denominator

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose prefixes share enough: all else they share comes after one of the prefixes."""
        one, two = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
        both = pairs.distinct().join(one, "a").join(two, "b")
        need = F.expr(f"({num} * (na + nb) + {num + den - 1}) div {num + den}")
        rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
        return scratch.save(both.where(F.size(F.array_intersect("pa", "pb")) + rest >= need).select(*pairs.columns), name)

    first = possible(found.where("key IS NULL").select("a", "b").unionByName(also), "pairs")
    wanted = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    wanted = nodes.select("node", F.col("least.h1").alias("h1"), F.col("least.h2").alias("h2")).join(wanted, "node")
    chosen = texts.join(wanted, ["h1", "h2"]).select("node", "text").dropDuplicates(["node"])
    sets = scratch.save(chosen.mapInArrow(_sets(shingle), "node long, shingles array<long>"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").withColumn("k", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.expr(f"{den} * k >= {num} * (size(sa) + size(sb) - k)")).select(*pairs.columns)

    edges = scratch.save(linked(first), "edges")
    member = components(edges, scratch)
    if not large.limit(1).count():
        return member
    parts = nodes.select("node", "sketch").join(member, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "sketch")
    parts = scratch.save(parts, "parts")
    for leaders in (True, False):
        named = large.join(parts, "node").select("key", "node", "size", "part", "sketch")
        pairs = named.repartition("key").sortWithinPartitions("key").mapInArrow(_across(ratio, leaders), "a long, b long, ca long, cb long")
        edges = scratch.save(linked(possible(pairs, "pairs")), "edges")
        if edges.limit(1).count():  # components are linked; their rows follow
            moved = components(edges.select("ca", "cb"), scratch).toDF("part", "to")
            parts = scratch.save(parts.join(moved, "part", "left").select("node", F.coalesce("to", "part").alias("part"), "sketch"), "parts")
    return parts.select("node", F.col("part").alias("component"))


def fraction(similarity: float) -> Fraction:
    ratio = Fraction(str(similarity))
    if not 0 < ratio <= 1:
        raise ValueError("similarity must be above 0 and 1 at most")
    return ratio


def classes(texts: DataFrame, shingle: int, ratio: Fraction, scratch: Scratch) -> DataFrame:
    """(node, least, size, print, prefix, sketch) of each distinct set of shingles. ``texts``: id, h1, h2, text.
    least: the first of its rows by id and hashes."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts.select("text"), shingle))
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(_prefixes(shingle, ratio, common), f"id {kind}, h1 long, h2 long, d1 long, d2 long, print long, size long, prefix array<long>, sketch binary")
    firsts = [F.first(c).alias(c) for c in ("size", "print", "prefix", "sketch")]
    nodes = rows.groupBy("d1", "d2").agg(F.min(F.struct("id", "h1", "h2")).alias("least"), *firsts)
    return scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "least", "size", "print", "prefix", "sketch"), "nodes")
