"""Removal of words that lie in a window of 35 words found elsewhere too, by anchors at difference-cover places.

Places of a text are covered if their number modulo 21 is one of five residues, chosen so that any two places have a
common distance below 21 at which both are covered. So two equal windows share an *anchor*, 15 words that begin
at a covered place at the same distance in both. Only anchors are hashed, about one in four words.

1. Anchors are counted by hash; one that only one place has is done.
2. Those of the others are extended by the 20 words to both sides that windows around them can hold. If all
   extensions in a group are the same, all their windows are repeated.
3. Else a representative stands for equal extensions, and their windows are compared: small groups within tasks,
   by the words themselves, large ones as rows of 128-bit hashes, by aggregates.

A large group is never gathered whole, places of a common passage are combined before they are counted, and joins
are of two sides that adaptive execution can split. Runs of one extension within a text, as one word repeated for
pages makes them, are one row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

WORDS = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Words of an anchor, and beside it in a window.
ANCHOR, REST = WORDS - PERIOD + 1, PERIOD - 1
#: Groups of more places than this aren't compared in a task.
HOT = 2000
_COVERED = np.isin(np.arange(PERIOD), COVER)


def words_and_bounds(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by spaces, and where they begin and end."""
    words = text.split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.r_[0, ends[:-1] + 1][: len(words)], ends


def anchors(text: bytes) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Of a text: hashes of anchors and of their extensions, the word each begins at, and the words to its right."""
    data, starts, ends = words_and_bounds(text)
    n = len(starts)
    if n < WORDS:
        return [], [], starts, starts
    at = np.flatnonzero(np.resize(_COVERED, n - ANCHOR + 1))
    low, high = np.maximum(at - REST, 0), np.minimum(at + ANCHOR + REST, n)
    digest = xxhash.xxh3_64_intdigest
    k = [digest(data[a:b]) for a, b in zip(starts[at].tolist(), ends[at + ANCHOR - 1].tolist(), strict=True)]
    s = [digest(data[a:b], left) for a, b, left in zip(starts[low].tolist(), ends[high - 1].tolist(), (at - low).tolist(), strict=True)]
    return k, s, at, high - at - ANCHOR


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


#: Rows that a task makes before it hands them on.
_MADE = 50_000


def _anchor_rows(full: bool):
    """Anchors of (i, h, text): k, s and how many, or how many and where as well. Runs of one s are one row."""

    def record(rows: list[tuple]) -> pa.RecordBatch:
        i, h, k, s, at, right = (np.concatenate(x) for x in zip(*rows, strict=True))
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (at[1:] < at[:-1])])
        count = np.diff(np.r_[new, len(k)])
        arrays = {"k": k[new], "s": s[new], "n": count}
        if full:
            arrays |= {"i": i[new], "h": h[new], "at": at[new].astype(np.int32), "more": (at[new + count - 1] - at[new]).astype(np.int32), "right": right[new].astype(np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in arrays.values()], names=list(arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], 0
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                k, s, at, right = anchors(text)
                if k:
                    rows.append((np.full(len(k), i, np.int64), np.full(len(k), h, np.int64), _signed(k), _signed(s), at, right))
                    made += len(k)
                if made >= _MADE:
                    yield record(rows)
                    rows, made = [], 0
            if rows:
                yield record(rows)

    return run


_CONTEXT = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("hot", pa.bool_())])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extensions that are asked for, of (text, asked), and the words in them to the left of the anchor."""
    for batch in batches:
        rows = []
        for text, asked in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, starts, ends = words_and_bounds(text)
            for q in asked:
                low, high = max(0, q["at"] - REST), min(len(starts), q["at"] + ANCHOR + REST)
                rows.append((q["k"], q["s"], q["n"], q["at"] - low, data[starts[low] : ends[high - 1]], q["hot"]))
        for i in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5000], strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)


def windows(context: bytes) -> list[bytes]:
    """The windows of an extension, by the word they begin at."""
    starts = [0, *(np.flatnonzero(np.frombuffer(context, np.uint8) == 32) + 1).tolist()]
    ends = [s - 1 for s in starts[1:]] + [len(context)]
    return [context[a:b] for a, b in zip(starts[: len(starts) - WORDS + 1], ends[WORDS - 1 :], strict=True)]


def spans(hit: list[int]) -> list[int]:
    """Words covered by windows that begin at ``hit``, ascending: from, to, from, to ..."""
    out: list[int] = []
    for x in hit:
        if out and x <= out[-1]:
            out[-1] = x + WORDS
        else:
            out += [x, x + WORDS]
    return out


_ANSWER = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 3, _ANSWER, strict=True)], schema=_ANSWER)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, s, spans) from the anchor's first word, of (k, s, n, left, context), sorted by k; groups are whole."""

    def of(group: dict[int, tuple]) -> list[tuple[int, list[int]]]:
        # the same words at another distance from the anchor are another anchor's affair
        seen: Counter = Counter()
        found = {s: [(x - left, w) for x, w in enumerate(windows(context))] for s, (_, left, context) in group.items()}
        for s, all_ in found.items():
            for w in all_:
                seen[w] += group[s][0]
        hits = ((s, spans([x for x, w in all_ if seen[x, w] > 1])) for s, all_ in found.items())
        return [(s, hit) for s, hit in hits if hit]

    held, last, out = {}, None, []
    for batch in batches:
        for k, s, n, left, context in zip(*(batch.column(c).to_pylist() for c in ("k", "s", "n", "left", "context")), strict=True):
            if held and k != last:
                out += [(last, *x) for x in of(held)]
                held = {}
                if len(out) >= 5000:
                    yield _answer(out)
                    out = []
            last = k
            held[s] = n, left, context  # a text that is there twice answers twice
    yield _answer(out + [(last, *x) for x in of(held)])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, s, n, x, u, v) of (k, s, n, left, context): windows by 128 bits and their distance from the anchor."""
    for batch in batches:
        take, x, u, v = [], [], [], []
        for j, (left, context) in enumerate(zip(batch.column("left").to_pylist(), batch.column("context").to_pylist(), strict=True)):
            for begin, w in enumerate(windows(context)):
                h = xxhash.xxh3_128_intdigest(w)
                take.append(j)
                x.append(begin - left)
                u.append(h >> 64)
                v.append(h & (1 << 64) - 1)
        same = [batch.column(c).take(pa.array(take, pa.int64())) for c in ("k", "s", "n")]
        yield pa.RecordBatch.from_arrays([*same, pa.array(x, pa.int32()), pa.array(_signed(u)), pa.array(_signed(v))], names=["k", "s", "n", "x", "u", "v"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _answer([(k, s, spans(sorted(set(xs)))) for k, s, xs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)])


def _dealt(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, s, spans) of large groups: their windows are rows, at most 21 of an extension."""
    rows = scratch.save(contexts.mapInArrow(_window_rows, "k long, s long, n long, x int, u long, v long"), "windows")
    key = ["k", "x", "u", "v"]
    seen = rows.groupBy(*key).agg(F.sum("n").alias("t")).where("t > 1").drop("t")
    hits = rows.join(seen, key).groupBy("k", "s").agg(F.collect_set("x").alias("xs"))
    return hits.mapInArrow(_runs, "k long, s long, spans array<int>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n_words, n_removed, kept_sha256, kept) of (id, text, spans)."""
    for batch in batches:
        out = []
        for text, found in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, removed = text.split(), 0
            kept = b" ".join(words)
            if found:
                change = np.zeros(len(words) + 2, np.int64)
                for x in found:
                    last = x["at"] + x["more"]
                    for a, b in zip(x["spans"][::2], x["spans"][1::2], strict=True):
                        change[x["at"] + a] += 1
                        change[last + b] -= 1
                gone = np.r_[True, np.cumsum(change)[: len(words)] > 0, True]
                edge = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                left = [x for a, b in zip(edge[::2], edge[1::2], strict=True) for x in words[a:b]]
                removed, kept = len(words) - len(left), b" ".join(left)
            out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])


@contextmanager
def _freed_shuffles(spark: SparkSession):
    """Within, shuffle files of a query go when it ends; its result is a saved table by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def repeated_spans(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, h, at, more, spans): spans of words from ``at`` to ``at + more``, which may overlap, that repeated
    windows cover in the texts of (i, h, text)."""
    seen = keyed.mapInArrow(_anchor_rows(False), "k long, s long, n long")
    kinds = seen.groupBy("k").agg(F.sum("n").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("c > 1")
    kinds = scratch.save(kinds.select("k", (F.col("lo") != F.col("hi")).alias("mixed"), (F.col("c") > HOT).alias("hot")), "anchors")
    rows = keyed.mapInArrow(_anchor_rows(True), "k long, s long, n long, i long, h long, at int, more int, right int")
    rows = scratch.save(rows.join(kinds, "k"), "places")
    mixed = rows.where("mixed")
    classes = mixed.groupBy("k", "s").agg(F.sum("n").alias("n"), F.first("hot").alias("hot"), F.min(F.struct("i", "h", "at")).alias("r"))
    asked = classes.select("r.i", "r.h", F.struct("k", "s", "n", "hot", "r.at").alias("q")).groupBy("i", "h").agg(F.collect_list("q").alias("asked"))
    contexts = keyed.join(asked, ["i", "h"]).select("text", "asked")
    contexts = scratch.save(contexts.mapInArrow(_contexts, "k long, s long, n long, left int, context binary, hot boolean"), "extensions")
    cold = contexts.where("NOT hot").select("k", "s", "n", "left", "context").repartition("k").sortWithinPartitions("k")
    answers = cold.mapInArrow(_compared, "k long, s long, spans array<int>")
    hot = contexts.where("hot").drop("hot")
    if hot.limit(1).count():
        answers = answers.unionByName(_dealt(hot.dropDuplicates(["k", "s"]), scratch))
    part = mixed.select("k", "s", "i", "h", "at", "more").join(scratch.save(answers, "answers"), ["k", "s"])
    # an extension holds the words from REST before the anchor on, as far as the text goes
    alone = rows.where("NOT mixed").select("i", "h", "at", "more", F.array(-F.least("at", F.lit(REST)), F.lit(ANCHOR) + F.col("right")).alias("spans"))
    return alone.unionByName(part.select("i", "h", "at", "more", "spans"))


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of every document.

    Words are what ASCII white space parts, unchanged. Null texts have none; those of fewer than 35 lose none. Rows are told
    apart by hashes of id and text, so repeated rows are copies of one another and both go. Ids can be of any type,
    null too. ``kept``: the words left, joined by single spaces. Other columns are dropped.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`")).alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    with _freed_shuffles(spark):
        found = repeated_spans(texts.select("i", "h", "text"), scratch)
        found = scratch.save(found.groupBy("i", "h").agg(F.collect_set(F.struct("at", "more", "spans")).alias("spans")), "spans")
    rows = texts.join(found, ["i", "h"], "left").select("id", "text", "spans")
    out = rows.mapInArrow(_cut, f"id {texts.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("id", id_col)
