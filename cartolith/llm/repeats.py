"""Removal of bytes that lie in a 200-byte string found elsewhere too.

A radix sort of all windows to the depth of 200 bytes, by most-significant-digit passes that go on with groups
of two or more only; equal groups are exactly the repeated windows. Any order of digits will do as long as it's
the same for all, so digits are taken from an *anchor* outwards:

1. The first digit of a window is its minimizer, the leftmost smallest hash of its ``GRAM``-byte grams. Windows
   with one minimizer are one row, an anchor, for about eighty windows. Equal windows have equal minimizers at
   equal places, so no repeat is lost by taking anchors for windows, and a digit that only one anchor has is done.
   A group whose anchors all stand in the same stretch of text is done as well: all its windows are repeated.
2. Groups of many anchors are dealt again by wider digits: their windows are halved by place, and each half takes
   the bytes that all of its windows hold as its next digit, until groups are small, uniform or single windows.
3. Small groups are sorted within tasks, byte by byte from the anchor to the right and to the left. Bytes are
   compared themselves, and what a byte singles out is dropped before the next one.

Groups are never gathered whole: a representative stands for equal stretches, and group sizes come from
aggregates with a map-side part. Digits of the first two passes are told apart by 64-bit hashes within a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH, GRAM = 200, 24
#: Bytes of a window beside its anchor.
REST = LENGTH - GRAM
#: Groups of more anchors than this are dealt again before they are sorted in a task.
HOT = 2000
#: Stretches sorted together in a task, at least, if there are so many, and parts of a group's join.
TOGETHER, PARTS = 8192, 8
#: Bytes of text worked on at once.
BLOCK = 1 << 19
_POS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(2 * BLOCK - 1, b, np.uint64)]) for b in (_BASE, inverse))


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, mixed polynomials modulo 2**64."""
    up, down = _powers()
    n = len(b)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(b * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie in a block one after another: text, hash, place, first and last window.

    Places are within the block. Windows that cross the end of a text aren't windows.
    """
    none = np.empty(0, np.int64)
    if len(block) < LENGTH:
        return none, none, none, none, none
    h = _gram_hashes(block, GRAM)
    place = np.arange(len(h), dtype=np.uint64)
    low = _sliding_min((h >> np.uint64(_POS) << np.uint64(_POS)) | place, LENGTH - GRAM + 1)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(low)]
    at = (low & np.uint64((1 << _POS) - 1)).astype(np.int64)
    valid = np.arange(len(low)) + LENGTH <= ends[text]
    window = np.flatnonzero(valid)
    if not len(window):
        return none, none, none, none, none
    at, text = at[window], text[window]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(window)] - 1
    return text[new], h[at[new]].view(np.int64), at[new], window[new], window[last]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts by blocks: number, offset in the text, bytes. Long texts are cut with an overlap of a window."""
    number, offset, piece, total = [], [], [], 0
    step = BLOCK - LENGTH + 1
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), step):
            part = t[at : at + BLOCK] if len(t) > BLOCK else t
            if len(part) < LENGTH:
                continue
            if total + len(part) > BLOCK and piece:
                yield number, offset, piece
                number, offset, piece, total = [], [], [], 0
            number.append(i)
            offset.append(at)
            piece.append(part)
            total += len(part)
    if piece:
        yield number, offset, piece


def _anchor_rows(full: bool):
    """Anchors of a batch of (i, h, text): k and s alone, or with the text's key and the windows."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for number, offset, piece in _pieces(texts):
                data = b"".join(piece)
                ends = np.cumsum([len(p) for p in piece])
                starts = ends - [len(p) for p in piece]
                text, k, at, first, last = anchors(np.frombuffer(data, np.uint8), starts, ends)
                if not len(text):
                    continue
                s = np.array([digest(data[a : b + LENGTH], c - a) for a, b, c in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)], np.uint64).view(np.int64)
                arrays = {"k": k, "s": s}
                if full:
                    row = np.array(number)[text]
                    base = np.array(offset)[text] - starts[text]
                    arrays |= {"i": i[row], "h": h[row], "first": (first + base).astype(np.int32), "more": (last - first).astype(np.int32), "rel": (at - first).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays.values()], names=list(arrays))

    return run


_CONTEXT = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("rel", pa.int32()), ("context", pa.binary()), ("hot", pa.bool_())])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of text that are asked for of (text, asked)."""
    for batch in batches:
        rows = []
        for text, asked in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(q["k"], q["s"], q["n"], q["rel"], text[q["first"] : q["first"] + q["more"] + LENGTH], q["hot"]) for q in asked]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch twice, with halves of its windows lo .. hi, counted by bytes before the anchor.

    g: digest of the bytes that all windows of the half hold. u: of all bytes that its windows hold here.
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        take, out = [], []
        for j, (rel, context, lo, hi) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rel", "context", "lo", "hi")), strict=True)):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                x, y = max(a, rel - len(context) + LENGTH), min(b, rel)
                if x <= y:
                    take.append(j)
                    out.append((digest(context[rel - a : rel + LENGTH - b], a << 8 | b), digest(context[rel - y : rel + LENGTH - x], x << 8 | y), a, b))
        if out:
            g, u, lo, hi = zip(*out, strict=True)
            same = [batch.column(c).take(pa.array(take)) for c in ("k", "s", "n", "rel", "context")]
            made = [pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(np.array(u, np.uint64).view(np.int64)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
            yield pa.RecordBatch.from_arrays([*same, *made], names=["k", "s", "n", "rel", "context", "g", "u", "lo", "hi"])


def _names(data: np.ndarray, places: np.ndarray, step: int, room: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Passes from one byte to the next: for each stretch and number of bytes, a number that all stretches
    with the same bytes share, or -1 if these stand for fewer than two places."""
    out, alive, label = np.full((len(places), REST + 1), -1, np.int32), np.arange(len(places)), label.copy()
    for depth in range(REST + 1):
        if depth:
            alive = alive[room[alive] >= depth]
            label[alive] = label[alive] * 256 + data[places[alive] + step * (depth - 1)]
        _, name = np.unique(label[alive], return_inverse=True)
        more = np.bincount(name, weights=n[alive])[name] >= 2 if len(name) else np.empty(0, bool)
        alive, name = alive[more], name[more]
        if not len(alive):
            break
        label[alive], out[alive, depth] = name, name
    return out


def repeated_windows(contexts: list[bytes], rel: np.ndarray, group: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """For each stretch, the spans that windows cover which occur twice or more: from, to, from, to ..., counted
    from the anchor.

    rel: place of the anchor. group: only stretches of one group are compared. n: how many places a stretch
    stands for. lo, hi: bytes before the anchor of the windows looked at.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64)
    at = np.cumsum(size) - size + rel
    _, label = np.unique(group, return_inverse=True)
    right = _names(data, at + GRAM, 1, size - rel - GRAM, label, n)
    left = _names(data, at - 1, -1, rel, label, n)
    low, high = np.maximum(lo, rel - size + LENGTH), np.minimum(hi, rel)
    flags = np.zeros((len(contexts), REST + 3), np.int8)
    for before in range(REST + 1):
        x, y = left[:, before], right[:, REST - before]
        some = np.flatnonzero((x >= 0) & (y >= 0) & (low <= before) & (before <= high))
        if len(some):
            _, name = np.unique(x[some].astype(np.int64) << 32 | y[some], return_inverse=True)
            flags[some, before + 1] = np.bincount(name, weights=n[some])[name] >= 2
    # a run of windows with a to b bytes before the anchor covers the bytes from -b to LENGTH - a
    change = np.diff(flags, axis=1)
    row, begin = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1] - 1
    spans = np.stack([-end, LENGTH - begin], axis=1)
    bounds = np.searchsorted(row, np.arange(len(contexts) + 1))
    return [spans[a:b].ravel() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, s, spans) of the stretches (k, s, n, rel, context, g, lo, hi) of whole groups, sorted by group."""

    def of(rows: dict) -> pa.RecordBatch:
        spans = []
        if rows:
            n, rel, context, lo, hi = zip(*rows.values(), strict=True)
            spans = repeated_windows(list(context), *map(np.array, (rel, [g for g, _, _ in rows], n, lo, hi)))
        some = [(k, s, x) for (_, k, s), x in zip(rows, spans, strict=True) if len(x)]
        columns = list(zip(*some, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["k", "s", "spans"])

    held, last = {}, None
    for batch in batches:
        for g, k, s, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "k", "s", "n", "rel", "context", "lo", "hi")), strict=True):
            if g != last and len(held) >= TOGETHER:
                yield of(held)
                held = {}
            last = g
            held[g, k, s] = row  # repeated rows of the input ask twice
    yield of(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the spans of (id, text, spans) and describes what is left."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            end, kept, runs, removed = 0, [], 0, 0
            merged: list[list[int]] = []
            for a, b in sorted({(x["at"] + a, x["at"] + b) for x in spans or () for a, b in zip(x["spans"][::2], x["spans"][1::2], strict=True)}):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                kept.append(text[end:a])
                removed, runs, end = removed + b - a, runs + 1, b
            kept.append(text[end:])
            left = b"".join(kept)
            out.append((len(text), removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _settled(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, s, spans) of the stretches of large groups: k, s, n, rel, context, lo, hi."""
    answers = []
    wide = "k long, s long, n long, rel int, context binary, g long, u long, lo int, hi int"
    while members is not None:
        level = scratch.save(members.mapInArrow(_halves, wide), "halves")
        groups = level.groupBy("g").agg(F.sum("n").alias("t"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.count(F.lit(1)).alias("c")).where("t > 1")
        groups = groups.select("g", "u0", "u1", "c", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        level = scratch.save(level.withColumn("part", F.pmod("u", F.lit(PARTS)).cast("int")).join(groups, ["g", "part"]), "groups")
        spans = F.array(-F.least("hi", "rel"), LENGTH - F.greatest("lo", F.col("rel") - F.octet_length("context") + LENGTH))
        answers.append(level.where("u0 = u1").select("k", "s", spans.cast("array<int>").alias("spans")))
        mixed = level.where("u0 <> u1").select(*[x.split()[0] for x in wide.split(", ")], "c")
        few = mixed.where(F.col("c") <= HOT).repartition("g").sortWithinPartitions("g")
        answers.append(few.select("k", "s", "n", "rel", "context", "g", "lo", "hi").mapInArrow(_answers, "k long, s long, spans array<int>"))
        rest = mixed.where(F.col("c") > HOT)
        members = rest if rest.limit(1).count() else None
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, h, at, spans): spans of bytes from ``at``, which may overlap, that repeated windows cover in the
    texts of (i, h, text)."""
    seen = keyed.mapInArrow(_anchor_rows(False), "k long, s long")
    kinds = seen.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("c > 1")
    kinds = scratch.save(kinds.select("k", (F.col("lo") != F.col("hi")).alias("mixed"), (F.col("c") > HOT).alias("hot")), "digits")
    rows = keyed.mapInArrow(_anchor_rows(True), "k long, s long, i long, h long, first int, more int, rel int")
    rows = scratch.save(rows.join(kinds, "k"), "anchors")
    whole = rows.where("NOT mixed").select("i", "h", F.col("first").alias("at"), F.array(F.lit(0), F.col("more") + LENGTH).alias("spans"))
    mixed = rows.where("mixed")
    classes = mixed.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.first("hot").alias("hot"), F.min(F.struct("i", "h", "first", "more", "rel")).alias("r"))
    asked = classes.select("r.i", "r.h", F.struct("k", "s", "n", "hot", "r.first", "r.more", "r.rel").alias("q")).groupBy("i", "h").agg(F.collect_list("q").alias("asked"))
    contexts = keyed.join(asked, ["i", "h"]).select("text", "asked").mapInArrow(_contexts, "k long, s long, n long, rel int, context binary, hot boolean")
    contexts = scratch.save(contexts.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(REST)), "contexts")
    cold = contexts.where("NOT hot").select("k", "s", "n", "rel", "context", F.col("k").alias("g"), "lo", "hi").repartition("g").sortWithinPartitions("g")
    answers = cold.mapInArrow(_answers, "k long, s long, spans array<int>")
    hot = contexts.where("hot").drop("hot")
    if hot.limit(1).count():
        answers = answers.unionByName(_settled(hot.dropDuplicates(["k", "s"]), scratch))
    part = mixed.select("k", "s", "i", "h", (F.col("first") + F.col("rel")).alias("at")).join(answers, ["k", "s"])
    return whole.unionByName(part.select("i", "h", "at", "spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    Null texts count as empty, texts below 200 bytes lose nothing. Rows are told apart by id and text, so
    repeated rows are copies of one another and both go. Null ids are ids like others. ``kept`` holds the
    remaining bytes as text; where a span cuts a character, what is left of it becomes U+FFFD there, but
    not in ``kept_sha256``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    spans = repeated_spans(keyed, scratch).groupBy("i", "h").agg(F.collect_list(F.struct("at", "spans")).alias("spans"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("i"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = texts.join(spans, ["i", "h"], "left").select("id", "text", "spans")
    out = rows.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col)
