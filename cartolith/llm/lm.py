"""Language-model scores by logistic mixing of hashed-context bit predictors.

The most frequent tokens of the training documents are the leaves of a Huffman tree, which turns a text
into bits; all other tokens leave the tree by one escape leaf and are then coded by their smoothed count
among these. Each bit is predicted at its node of the tree: by the node alone, by the node and the last
very frequent word, and by the node and the previous word, the latter two from hashed tables of counts.
A gate, the confidence of both tables there, selects the weights by which the predictions are mixed in
the logistic domain. Weights start from a fit and are refined online within a document: after its first 32
tokens, at each doubling from there, and block by block in long ones.

Counts of tokens and bits and the fit of the starting weights cover all training documents. The fit needs only
how many bits there are of each combination of gate and rounded predictions, each bit without its own count.
Texts are turned into ranks of tokens once; what follows reads these. Only tables of fixed size are broadcast:
counts of tokens beyond the most frequent ones are joined.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: Tokens in the tree, tokens whose counts are broadcast, slots of a hashed table as a power of two.
TREE, KNOWN, SLOT_BITS = 1 << 16, 300_000, 21
#: Words that count as very frequent and as previous words, tokens before the first step of online refinement
#: and of a block at most.
FREQUENT, PREVIOUS, FIRST, BLOCK = 64, 4096, 32, 1024
#: Rate of refinement.
RATE = 0.002
#: Levels of a prediction in the fit, a power of two, and levels to one unit; Newton's steps at most.
LEVEL_BITS, LEVELS_A_UNIT, NEWTON = 5, 2, 30
#: Training tasks at most: each sends tables of fixed size.
TRAINERS = 512
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 400_000
#: Tokens that are counted, and tokens that are scored, at once, about.
HELD_TOKENS, HELD_SCORED = 1 << 18, 1 << 15
PART = 1 << 15
GATES, INPUTS = 16, 3
#: Weights before the fit, to which those of a gate without bits stay.
START = (0.4, 0.5, 0.3)
#: Factors of the contexts of both tables.
SALTS = (0x9E3779B1, 0x85EBCA6B)
#: Steps of a stored prediction to one unit in the logistic domain.
STEPS = 256


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def tokens_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words and the end, which is the empty word."""
    return [*(text or b"").lower().split(), b""]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["w", "c"])

    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()):
            counts.update(tokens_of(text.as_py()))
            if len(counts) > HELD_WORDS:
                yield out()
                counts.clear()
    yield out()


class Model:
    """All that is broadcast: ranks and counts of known tokens, the tree, tables and weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int):
        """words: the most frequent tokens, most frequent first. total, distinct: of all training tokens."""
        self.total, self.distinct, self.known = total, distinct, len(words)
        self.counts = np.append(counts, 0)
        self.rank = {w: i for i, w in enumerate(words)}
        self.leaves = min(len(words), TREE)
        self.rest = total - int(counts[: self.leaves].sum())
        self.rest_distinct = distinct - self.leaves
        self._grow([*counts[: self.leaves].tolist(), max(1, self.rest)])
        self.weights = np.tile(np.array(START), (GATES, 1))
        self.tables = self.codes = None

    def _grow(self, weights: list[int]) -> None:
        """The Huffman tree: for each leaf, its nodes and bits from the root."""
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, mass = [0] * (2 * n), [0] * (2 * n), [*weights, *[0] * n]
        new = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], side[y], mass[new] = new, new, 1, a + b
            heapq.heappush(heap, (a + b, new))
            new += 1
        root, nodes, bits, length = heap[0][1], [], [], []
        ones = np.zeros(max(1, n), float)
        for i in range(n):
            path = []
            x = i
            while x != root:
                path.append((parent[x] - n, side[x]))
                x = parent[x]
            nodes += [p for p, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            length.append(len(path))
        for x in range(new):
            if x != root and side[x]:
                ones[parent[x] - n] = (mass[x] + 0.5) / (mass[parent[x]] + 1)
        #: Node and bit of every step of every path.
        self.steps = np.array(nodes, np.uint32) << np.uint32(1) | np.array(bits, np.uint32)
        self.length = np.array(length, np.int64)
        self.first = np.cumsum(self.length) - self.length
        ones = np.clip(ones, 1e-9, 1 - 1e-9)
        self.prior = np.log(ones / (1 - ones)).astype(np.float32)

    def ranks(self, tokens: list[bytes]) -> np.ndarray:
        """Rank of each token; one past the last for tokens that aren't known."""
        return np.fromiter(map(self.rank.get, tokens, repeat(self.known)), np.int32, len(tokens))

    def contexts(self, rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last very frequent word and previous word before each token. starts: where each token's text begins."""
        last = np.full(len(rank), FREQUENT, np.uint32)
        previous = np.full(len(rank), PREVIOUS + 1, np.uint32)
        if len(rank) > 1:
            here = np.arange(len(rank))
            before = np.maximum.accumulate(np.where(rank < FREQUENT, here, -1))[:-1]
            last[1:] = np.where(before >= starts[1:], rank[np.maximum(before, 0)], FREQUENT)
            previous[1:] = np.where(starts[1:] < here[1:], np.minimum(rank[:-1], PREVIOUS), PREVIOUS + 1)
        return last, previous

    def bits(self, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        """Node and bit of every step to each leaf, and the number of steps of each."""
        length = self.length[leaf]
        at = np.repeat(self.first[leaf] - (np.cumsum(length) - length), length)
        at += np.arange(len(at))
        packed = self.steps.take(at, mode="clip")
        return packed >> np.uint32(1), packed & np.uint32(1), length

    @staticmethod
    def mixed(node: np.ndarray) -> np.ndarray:
        return (node + np.uint32(1)) * np.uint32(0xC2B2AE35)

    @staticmethod
    def slots(mixed: np.ndarray, context: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        """Slots of nodes after a context in table k."""
        h = np.repeat((context + np.uint32(1)) * np.uint32(SALTS[k]), length)
        h ^= mixed
        h *= np.uint32(0x27D4EB2F)
        h >>= np.uint32(32 - SLOT_BITS)
        return h

    def count(self, rank: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Adds the bits of texts to counts of (table, slot, bit). Equal tokens after equal contexts are taken together."""
        leaf = np.minimum(rank, self.leaves)
        for k, context in enumerate(self.contexts(rank, starts)):
            pairs, n = np.unique(context.astype(np.int64) << 32 | leaf, return_counts=True)
            node, bit, length = self.bits(pairs & 0xFFFFFFFF)
            slot = self.slots(self.mixed(node), (pairs >> 32).astype(np.uint32), length, k)
            counts[k] += np.bincount(slot << np.uint32(1) | bit, weights=np.repeat(n, length), minlength=2 << SLOT_BITS).astype(np.int64)

    def learn(self, counts: np.ndarray) -> None:
        """Takes counts of (table, bit, slot): predictions and confidences, and for the fit both rounded, for
        either bit at the slot without the count of this bit itself."""
        self.tables, self.codes = [], []
        for n0, n1 in counts.astype(np.float32):
            codes = np.empty((len(n0), 2), np.uint8)
            for bit in (0, 1):
                m0, m1 = np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0)
                codes[:, bit] = self._confidence(m0 + m1) << LEVEL_BITS | self._level(np.log((m1 + 0.4) / (m0 + 0.4)))
            self.codes.append(codes.reshape(-1))
            stretch = np.rint(np.log((n1 + 0.4) / (n0 + 0.4)) * STEPS).astype(np.int16)
            # one look-up gives both, in two bytes: tables that fit in caches are read faster
            self.tables.append(stretch << np.int16(2) | self._confidence(n0 + n1).astype(np.int16))

    @staticmethod
    def _confidence(n: np.ndarray) -> np.ndarray:
        return np.digitize(n, [1, 12, 160]).astype(np.int32)

    @staticmethod
    def _level(stretch: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(stretch * LEVELS_A_UNIT) + (1 << LEVEL_BITS - 1), 0, (1 << LEVEL_BITS) - 1).astype(np.int32)

    def cells(self, rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the bits of texts by the codes of both tables, the level of the node alone and the bit."""
        last, previous = self.contexts(rank, starts)
        node, bit, length = self.bits(np.minimum(rank, self.leaves))
        mixed = self.mixed(node)
        cell = self.codes[0].take(self.slots(mixed, last, length, 0) << np.uint32(1) | bit, mode="clip").astype(np.uint32)
        cell <<= np.uint32(LEVEL_BITS + 2)
        cell |= self.codes[1].take(self.slots(mixed, previous, length, 1) << np.uint32(1) | bit, mode="clip")
        cell <<= np.uint32(LEVEL_BITS)
        cell |= self._level(self.prior).astype(np.uint32).take(node, mode="clip")
        cell <<= np.uint32(1)
        cell |= bit
        return np.bincount(cell, minlength=1 << 3 * LEVEL_BITS + 5)

    def fit(self, cell: np.ndarray, n: np.ndarray) -> None:
        """Starting weights: those under which the bits, n of each cell, are likeliest. A slight pull towards
        ``START`` settles what they leave open."""
        levels, n = (1 << LEVEL_BITS) - 1, n.astype(float)
        y, own, b, a = cell & 1, cell >> 1 & levels, cell >> LEVEL_BITS + 1, cell >> 2 * LEVEL_BITS + 3
        x = (np.stack([own, a & levels, b & levels], axis=1) - (1 << LEVEL_BITS - 1)) / LEVELS_A_UNIT
        gates = (a >> LEVEL_BITS & 3) << 2 | b >> LEVEL_BITS & 3
        start = np.array(START)

        def loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
            z = x @ w
            return float((n * (np.logaddexp(0, z) - y * z)).sum() + ((w - start) ** 2).sum() / 2)

        for gate in range(GATES):
            of = gates == gate
            w, some = start.copy(), (x[of], y[of], n[of])
            for _ in range(NEWTON):
                p = 1 / (1 + np.exp(-(some[0] @ w)))
                slope = some[0].T @ (some[2] * (some[1] - p)) - (w - start)
                curve = (some[0] * (some[2] * p * (1 - p))[:, None]).T @ some[0] + np.eye(INPUTS)
                step, least = np.linalg.solve(curve, slope), loss(w, *some)
                while loss(w + step, *some) > least and np.abs(step).max() > 1e-9:
                    step /= 2
                w += step
                if np.abs(step).max() <= 1e-9:
                    break
            self.weights[gate] = w

    def score(self, rank: np.ndarray) -> float:
        """log10 of the probability of a text's leaves."""
        return float(self.scores([rank])[0])

    def scores(self, ranks: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of the leaves of each text. Blocks of equal number of all texts are scored at once."""
        rank, starts = _joined(ranks)
        if not len(rank):
            return np.zeros(len(ranks))
        size = np.array([len(x) for x in ranks])
        last, previous = self.contexts(rank, starts)
        text = np.repeat(np.arange(len(ranks)), size)

        def block(t: np.ndarray) -> np.ndarray:
            return np.where(t < BLOCK, np.searchsorted([FIRST << i for i in range((BLOCK // FIRST).bit_length() - 1)], t, side="right"), t // BLOCK + (BLOCK // FIRST).bit_length() - 1)

        # within a block, texts that go on come first: their weights are refined
        key = block(np.arange(len(rank)) - starts) * 2
        key += key == np.repeat(block(np.maximum(size - 1, 0)) * 2, size)
        order = np.argsort(key, kind="stable")
        key, text = key[order], text[order]
        node, bit, length = self.bits(np.minimum(rank[order], self.leaves))
        ends = np.cumsum(length)
        mixed = self.mixed(node)
        a = self.tables[0].take(self.slots(mixed, last[order], length, 0), mode="clip")
        b = self.tables[1].take(self.slots(mixed, previous[order], length, 1), mode="clip")
        gate = np.repeat(text * GATES, length)
        gate += (a & np.int16(3)) << np.int16(2) | b & np.int16(3)
        x = self.prior.take(node, mode="clip"), (a >> np.int16(2)) * np.float32(1 / STEPS), (b >> np.int16(2)) * np.float32(1 / STEPS)
        sign = np.float32(1) - bit.astype(np.float32) * np.float32(2)
        weights = [np.tile(w.astype(np.float32), len(ranks)) for w in self.weights.T]
        loss = np.empty(len(node), np.float32)
        bounds = np.searchsorted(key, np.arange(0, int(key[-1]) + 3))
        bounds = np.concatenate([[0], ends])[bounds].tolist()
        for start, going, end in zip(bounds[::2], bounds[1::2], bounds[2::2], strict=False):
            part = slice(start, end)
            g = gate[part]
            z = x[0][part] * weights[0].take(g, mode="clip")
            z += x[1][part] * weights[1].take(g, mode="clip")
            z += x[2][part] * weights[2].take(g, mode="clip")
            z *= sign[part]
            miss = np.abs(z)
            np.negative(miss, out=miss)
            np.exp(miss, out=miss)
            # -log p = log(1 + exp(-|z|)) + max(z, 0), z against the bit
            loss[part] = np.log1p(miss) + np.maximum(z, 0)
            if start < going:  # online refinement for the next block
                go, n = slice(start, going), going - start
                error = np.where(z[:n] > 0, 1, miss[:n]) / (1 + miss[:n]) * -sign[go]
                seen = np.bincount(g[:n], minlength=len(weights[0])) + 200.0
                for i in range(INPUTS):
                    weights[i] += (RATE * 100 * np.bincount(g[:n], weights=error * x[i][go], minlength=len(weights[0])) / seen).astype(np.float32)
        first = ends - length
        some = length > 0
        of_token = np.add.reduceat(loss, first[some], dtype=np.float64) if some.any() else np.empty(0)
        return np.bincount(text[some], weights=of_token, minlength=len(ranks)) / -math.log(10)


def _joined(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all tokens, and where each token's text begins."""
    size = np.array([len(x) for x in ranks], np.int64)
    return np.concatenate([np.empty(0, np.int32), *ranks]), np.repeat(np.cumsum(size) - size, size)


def _held(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[np.ndarray]]:
    """Ranks of texts, of about so many tokens at once."""
    some, held = [], 0
    for batch in batches:
        for x in batch.column(0).cast(pa.large_binary()):
            some.append(np.frombuffer(x.as_py(), np.int32))
            held += len(some[-1])
            if held >= tokens:
                yield some
                some, held = [], 0
    if some:
        yield some


def _bit_counts(shared):
    """Counts of bits by (table, bit, slot) over a partition, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        counts = np.zeros((2, 2 << SLOT_BITS), np.int64)
        for ranks in _held(batches, HELD_TOKENS):
            model.count(*_joined(ranks), counts)
        counts = counts.reshape(2, 1 << SLOT_BITS, 2).transpose(0, 2, 1)
        for k in range(2):
            for part in range((1 << SLOT_BITS) // PART):
                some = counts[k, :, part * PART : (part + 1) * PART]
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part]), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["k", "part", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros((2, PART), np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.int64).reshape(2, PART)
    packed = zlib.compress(total.tobytes(), 1)
    return pa.table({"k": table.column("k").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([packed], pa.binary())})


def _cells(shared):
    """Bits of a partition by cell of the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n = np.zeros(1 << 3 * LEVEL_BITS + 5, np.int64)
        for ranks in _held(batches, HELD_SCORED * 4):
            n += model.cells(*_joined(ranks))
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])

    return run


_RANKED = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_near", pa.int64()), ("near", pa.float64()), ("ranks", pa.binary()), ("far", pa.list_(pa.struct([("w", pa.binary()), ("tf", pa.int64())])))]


def _rank(shared):
    """Ranks of the tokens of each text, what is known of the base score, and the tokens beyond the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n = model.known
        logs = np.log10(model.counts + 1.0)
        for batch in batches:
            rows = []
            for value in batch.column(2).cast(pa.large_binary()):
                text = value.as_py() or b""
                tokens = tokens_of(text)
                rank = model.ranks(tokens)
                far = Counter([tokens[i] for i in np.flatnonzero(rank == n).tolist()])
                rows.append((len(text), len(tokens), int((rank < n).sum()), float(logs[rank].sum()), rank.tobytes(), [{"w": w, "tf": f} for w, f in far.items()]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_RANKED)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, (_, t) in zip(columns, _RANKED, strict=True))], names=["id", "held_out", *[x for x, _ in _RANKED]])

    return run


def _score(shared):
    """The last column, ranks, replaced by the score of the known tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        logs = np.log10(model.counts + 1.0)
        rest = math.log10(model.rest + model.rest_distinct + 1)
        for batch in batches:
            score = [np.empty(0)]
            for ranks in _held(iter([batch.select(["ranks"])]), HELD_SCORED):
                outside = [x[x >= model.leaves] for x in ranks]
                score.append(model.scores(ranks) + [float(logs[x].sum()) - rest * len(x) for x in outside])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(score))], names=[*batch.schema.names[:-1], "score"])

    return run


def train(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training documents, the counts of all their tokens, and all documents as ranks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counted = rows.where("NOT held_out").select("text").mapInArrow(_count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    vocabulary = scratch.save(counted, "vocabulary")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the frequent ones, down to a count from which there are few enough of them
    level = F.floor(F.log2("c") * 64).cast("int")
    levels = sorted(((r["level"], r["count"]) for r in vocabulary.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, some = None, 0
    for at, n in levels:
        if some + n > KNOWN:
            break
        least, some = at, some + n
    top = vocabulary.where(level >= least if least is not None else F.lit(False)).toArrow()
    words, counts = top.column("w").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    model = Model([words[i] for i in order], counts[np.array(order, int)].astype(np.int64), total, distinct)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    ranked = rows.mapInArrow(_rank(shared), f"id {kind}, held_out boolean, n_bytes long, n_tokens long, n_near long, near double, ranks binary, far array<struct<w binary, tf long>>")
    ranked = scratch.save(ranked.withColumn("row", F.monotonically_increasing_id()), "ranks")
    training = ranked.where("NOT held_out").select("ranks")
    model.rank = {}  # ranks are all that is read from here on
    shared = spark.sparkContext.broadcast(model)
    parts = training.coalesce(TRAINERS).mapInArrow(_bit_counts(shared), "k long, part long, counts binary")
    summed = parts.groupBy("k", "part").applyInArrow(_add, "k long, part long, counts binary").toArrow()
    counts = np.zeros((2, 2, 1 << SLOT_BITS), np.int64)
    for k, part, packed in zip(*(summed.column(c).to_pylist() for c in ("k", "part", "counts")), strict=True):
        counts[k, :, part * PART : (part + 1) * PART] = np.frombuffer(zlib.decompress(packed), np.int64).reshape(2, PART)
    del summed
    model.learn(counts)
    shared = spark.sparkContext.broadcast(model)
    cells = training.mapInArrow(_cells(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    model.fit(cells.column("cell").to_numpy(), cells.column("n").to_numpy())
    model.codes = None
    return model, vocabulary, ranked


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    Null and empty texts are one token, the end, and have no bits per byte. Null ids hash as an empty text. Repeated rows are scored
    alike. Without training documents all tokens are one unknown class, of probability one.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    model, vocabulary, ranked = train(docs, scratch, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "held_out", "n_bytes", "n_tokens", "n_near", "near"]
    scored = ranked.select(*names, "ranks").mapInArrow(_score(shared), f"row long, id {kind}, held_out boolean, n_bytes long, n_tokens long, n_near long, near double, score double")
    far = ranked.select("row", F.explode("far").alias("f")).select("row", "f.w", "f.tf")
    far = far.join(vocabulary, "w", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_more"),
    )
    both = scored.join(far, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    every = math.log10(model.total + model.distinct + 1)
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_near") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("near") + more - F.col("n_tokens") * every).alias("base_score"), (F.col("score") + more).alias("score"),
        F.when(F.col("n_bytes") > 0, (F.col("score") + more) / (-math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def bits_per_byte(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Total bits per byte of the held-out documents and of the others."""
    bytes_ = docs.groupBy(held_out(id_col).alias("held_out")).agg(F.sum(F.octet_length(text_of(text_col))).alias("n_bytes"))
    bits = scored.groupBy("held_out").agg((-F.sum("score") / math.log10(2)).alias("bits"), (-F.sum("base_score") / math.log10(2)).alias("base_bits"))
    return bits.join(bytes_, "held_out").select("held_out", "n_bytes", F.try_divide("bits", "n_bytes").alias("bits_per_byte"), F.try_divide("base_bits", "n_bytes").alias("base_bits_per_byte"))
