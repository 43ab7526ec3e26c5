"""Repair of the structure of conversations: the cheapest edits after which roles go ``(s?(ua)+)?``.

A shortest path through the lattice of (turn, state of the grammar), whose edges are the edits: keep a turn, give
it another role, delete it, insert an empty one. Dijkstra's search pops nodes by (cost, audit) and stops at the
first end that the grammar accepts. The lattice isn't built; a node's edges follow from its turn and its state. The order
is sound: of two paths to a node with equal costs, neither audit is a prefix of the other, since turns used up
are equal and further insertions cost more, so the smaller audit stays smaller whatever follows.

Conversations of at most ``LONG`` turns and ``LONG_BYTES`` bytes, or what is given instead, are whole in a task, a stream of one after
another. Longer ones are dealt over tasks by ranges of turns and cut in parts: each part gets its cheapest path
from each state to each state, and paths of parts are put together in their order. First places of a text are
found by aggregates, so neither a long conversation nor a turn that it repeats is gathered anywhere. Only the
hash of a conversation is a stream through one task, part by part: SHA-256 can't be had otherwise.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, bounded_batches

#: Turns and bytes of a conversation that a task takes whole, and of a part of a longer one.
LONG, LONG_BYTES = 1024, 1 << 23
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
USER, ASSISTANT = b"user", b"assistant"
SPACES = SPACE_CHARS.encode()
#: States: nothing yet, after the system, after the user, after the assistant. By state: the initials that may
#: follow with the states they lead to, and the role that a turn gets.
STATES, ACCEPTING = range(4), (0, 3)
FOLLOWS = ({b"s": 1, b"u": 2}, {b"u": 2}, {b"a": 3}, {b"u": 2})
GIVEN = (USER, USER, ASSISTANT, USER)
NEXT = (2, 2, 3, 2)

#: A turn as the lattice sees it: initial of its role, whether it must go, whether it is truncated.
Turn = tuple[bytes, bool, bool]


def _popped(turns: list[Turn], state: int) -> Iterator[tuple[int, str, int, int]]:
    """The nodes (cost, audit, turn, state) by (cost, audit), each once."""
    heap, done, n = [(0, "", 0, state)], set(), len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        yield cost, audit, i, state
        edges = [(cost + INSERT, audit + "I", i, NEXT[state])]
        if i < n:
            initial, must_go, truncated = turns[i]
            edges.append((cost + DELETE, audit + "D", i + 1, state))
            if not must_go:
                edges.append((cost + REROLE + TRUNCATED * truncated, audit + "R", i + 1, NEXT[state]))
                if initial in FOLLOWS[state]:
                    edges.append((cost + KEEP + TRUNCATED * truncated, audit + "K", i + 1, FOLLOWS[state][initial]))
        for edge in edges:
            if edge[2:] not in done:
                heapq.heappush(heap, edge)


def cheapest(turns: list[Turn]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a whole conversation."""
    return next((cost, audit) for cost, audit, i, state in _popped(turns, 0) if i == len(turns) and state in ACCEPTING)


def cheapest_between(turns: list[Turn]) -> list[list[tuple[int, str] | None]]:
    """Cost and audit from each state before the turns to each state after them, if there is a way."""
    out = []
    for first in STATES:
        ends: list[tuple[int, str] | None] = [None] * len(STATES)
        for cost, audit, i, state in _popped(turns, first):
            if i == len(turns):
                ends[state] = cost, audit
        out.append(ends)
    return out


class Chain:
    """An audit as a list from its end, of one piece a part."""

    def __init__(self, before: Chain | None, piece: str, state: int):
        self.before, self.piece, self.state = before, piece, state

    def pieces(self) -> list[tuple[str, int]]:
        out, at = [], self
        while at is not None:
            out.append((at.piece, at.state))
            at = at.before
        return out[::-1]

    def less(self, other: Chain) -> bool:
        """Whether the audit is the smaller one, of two of as many parts. Only what differs is compared."""
        mine, its, a, b = [], [], self, other
        while a is not b:
            mine.append(a.piece)
            its.append(b.piece)
            a, b = a.before, b.before
        return "".join(mine[::-1]) < "".join(its[::-1])


def joined(parts: Iterable[list[list[tuple[int, str] | None]]]) -> tuple[int, list[tuple[str, int]]]:
    """Cost of the cheapest path through all parts, and for each its audit and the state before it."""
    best: dict[int, tuple[int, Chain | None]] = {0: (0, None)}
    for part in parts:
        after: dict[int, tuple[int, Chain]] = {}
        for first, (cost, chain) in best.items():
            for last, end in enumerate(part[first]):
                if end is not None:
                    found = cost + end[0], Chain(chain, end[1], first)
                    old = after.get(last)
                    if old is None or found[0] < old[0] or found[0] == old[0] and found[1].less(old[1]):
                        after[last] = found
        best = after
    cost, chain = None, None
    for state in ACCEPTING:
        if state in best and (cost is None or best[state][0] < cost or best[state][0] == cost and best[state][1].less(chain)):
            cost, chain = best[state]
    return cost, chain.pieces()


def edited(turns: list[tuple[bytes, bytes]], audit: str, state: int = 0) -> list[dict]:
    """The turns (role, text) that an audit leaves, from a state on."""
    out, rows = [], iter(turns)
    for edit in audit:
        role, text = (b"", b"") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = FOLLOWS[state][role[:1]]
        else:
            role, state = GIVEN[state], NEXT[state]
        out.append({"role": role, "text": text})
    return out


def fault(text: bytes, seen: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated, or none."""
    text = text.rstrip(SPACES)
    return "blank" if not text else "duplicate" if seen else "" if text[-1:] in b".!?" else "truncated"


_FAULTS = ("blank", "duplicate", "truncated")
_COUNTS = ("gaps", *_FAULTS, "illegal", "cost")


def _illegal(initials: list[bytes]) -> int:
    return sum(a + b not in (b"su", b"ua", b"au") for a, b in zip(initials, initials[1:], strict=False))


def _record(key, kind: pa.DataType, rows: list[dict]) -> pa.RecordBatch:
    """Rows with what a conversation has in its part."""
    turn = pa.struct([("role", pa.binary()), ("text", pa.binary())])
    kinds = {"part": pa.int64(), **{c: pa.int64() for c in _COUNTS}, "audit": pa.string(), "repaired": pa.list_(turn)}
    return pa.RecordBatch.from_arrays([pa.array([key(r) for r in rows], kind), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], names=["_c", *kinds])


_TURN = "array<struct<role:binary,text:binary>>"
_RECORD = "part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired " + _TURN
_NO_TURNS = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired": []}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples, strings as bytes; a new conversation's rows follow the last one's."""
    for batch in batches:
        columns = [c.cast(pa.large_binary()).to_pylist() if (pa.types.is_string(c.type) or pa.types.is_large_string(c.type)) and name != "_c" else c.to_pylist() for name, c in zip(batch.schema.names, batch.columns, strict=True)]
        yield from zip(*columns, strict=True)


def repaired_turns(rows: list[tuple]) -> dict:
    """What comes of the rows (turn, role, text, copies) of a conversation, in order."""
    rows = [(turn, role, text) for turn, role, text, copies in rows for _ in range(copies)]
    if not rows:
        return _NO_TURNS
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
    known = {turn for turn, _, _ in rows} - {None}
    gaps = min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0
    counts = {f: faults.count(f) for f in _FAULTS}
    return {"gaps": gaps, **counts, "illegal": _illegal(initials), "cost": cost, "audit": audit, "repaired": edited([(r, t) for _, r, t in rows], audit)}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, of those in (c, turn, role, text, copies), sorted."""
    kind, held, out, size = None, [], [], 0

    def first():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    last = None
    for c, *row in _stream(first()):
        if held and c != last:
            out.append((last, repaired_turns(held)))
            held = []
            if len(out) >= 1000 or size > LONG_BYTES:
                yield _record(lambda r: r["_c"], kind, [{"_c": k, "part": 0, **r} for k, r in out])
                out, size = [], 0
        last = c
        held.append(row)
        size += len(row[1]) + len(row[2])
    if held:
        out.append((last, repaired_turns(held)))
        yield _record(lambda r: r["_c"], kind, [{"_c": k, "part": 0, **r} for k, r in out])


_MOVE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_ROW = pa.struct([("role", pa.binary()), ("text", pa.binary())])
_PART = "part long, blank long, duplicate long, truncated long, illegal long, head binary, tail binary, moves array<struct<first:int,last:int,cost:bigint,audit:string>>, turns " + _TURN


def _parts(turns_at_most: int, bytes_at_most: int):
    """The parts of the conversations in (c, turn, role, text, copies, seen, p), sorted within a partition p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, number = None, 0

        def first():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def record(c, p: int, turns: list[tuple[bytes, bytes]], faults: list[str]) -> pa.RecordBatch:
            nonlocal number
            initials = [role[:1] for role, _ in turns]
            between = cheapest_between([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
            moves = [{"first": a, "last": b, "cost": end[0], "audit": end[1]} for a, ends in enumerate(between) for b, end in enumerate(ends) if end]
            number += 1
            made = [(p << 33 | number, pa.int64()), *((faults.count(f), pa.int64()) for f in _FAULTS), (_illegal(initials), pa.int64()), (initials[0], pa.binary()), (initials[-1], pa.binary())]
            made += [(moves, pa.list_(_MOVE)), ([{"role": r, "text": t} for r, t in turns], pa.list_(_ROW))]
            return pa.RecordBatch.from_arrays([pa.array([c], kind), *(pa.array([v], t) for v, t in made)], names=["_c", "part", *_FAULTS, "illegal", "head", "tail", "moves", "turns"])

        turns, faults, last, size = [], [], None, 0
        for c, _, role, text, copies, seen, p in _stream(first()):
            for again in range(copies):
                if turns and (last != (c, p) or len(turns) >= turns_at_most or size > bytes_at_most):
                    yield record(*last, turns, faults)
                    turns, faults, size = [], [], 0
                last = c, p
                turns.append((role, text))
                faults.append(fault(text, bool(seen or again)))
                size += len(role) + len(text)
        if turns:
            yield record(*last, turns, faults)

    return run


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, part, state, cost, audit) along the cheapest path, of the parts (c, part, moves), sorted."""
    kind = None

    def rows():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    def found(c, parts: list[int], tables: list) -> Iterator[pa.RecordBatch]:
        cost, pieces = joined(tables)
        for i in range(0, len(parts), 1000):
            some = pieces[i : i + 1000]
            n = len(some)
            columns = ([c] * n, kind), (parts[i : i + n], pa.int64()), ([s for _, s in some], pa.int32()), ([cost * (i + j == 0) for j in range(n)], pa.int64()), ([a for a, _ in some], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["_c", "part", "state", "cost", "audit"])

    parts, tables, last = [], [], None
    for c, part, moves in rows():
        if parts and c != last:
            yield from found(last, parts, tables)
            parts, tables = [], []
        last = c
        ends: list[list] = [[None] * len(STATES) for _ in STATES]
        for m in moves:
            ends[m["first"]][m["last"]] = m["cost"], m["audit"]
        parts.append(part)
        tables.append(ends)
    if parts:
        yield from found(last, parts, tables)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of a record, of (c, part, counts, state, audit, turns)."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["repaired"] = edited([(t["role"], t["text"]) for t in r["turns"]], r["audit"], r["state"])
        yield _record(lambda r: r["_c"], batch.schema.field(0).type, rows)


def _of_parts(rows: DataFrame, long: int, long_bytes: int, scratch: Scratch) -> DataFrame:
    """Records of the parts of long conversations, of (c, turn, role, text, copies)."""
    kind = rows.schema["_c"].dataType.simpleString()
    key = ["_c", "_t", "_r", "_x"]
    once = scratch.save(rows.where("_n > 0").groupBy(*key).agg(F.sum("_n").alias("_n")), "turns")
    first = once.groupBy(*(F.col(c).alias(f"{c}1") for c in ("_c", "_r", "_x"))).agg(F.min(F.struct(F.col("_t").isNotNull(), "_t")).alias("_f"))
    same = F.col("_c").eqNullSafe(F.col("_c1")) & (F.col("_r") == F.col("_r1")) & (F.col("_x") == F.col("_x1"))
    flagged = once.join(first, same).select(*key, "_n", (~F.col("_t").eqNullSafe(F.col("_f._t"))).alias("_seen"))
    dealt = flagged.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_p", F.spark_partition_id())
    parts = scratch.save(dealt.mapInArrow(_parts(long, long_bytes), f"_c {kind}, {_PART}"), "parts")
    moves = parts.select("_c", "part", "moves").repartition("_c").sortWithinPartitions("_c", "part")
    ways = scratch.save(moves.mapInArrow(_ways, f"_c {kind}, part long, state int, cost long, audit string"), "ways")
    spread = once.groupBy(F.col("_c").alias("_c2")).agg(F.max("_t").alias("b"), F.min("_t").alias("a"), F.count_distinct("_t").alias("n"))
    wide = F.least(F.col("b").cast("decimal(20,0)") - F.col("a") + 1 - F.col("n"), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    spread = spread.select("_c2", F.coalesce(wide, F.lit(0)).alias("gaps"))
    along = Window.partitionBy("_c").orderBy("part")  # of rows that are a few bytes a part
    before = F.lag("tail").over(along)
    pair = F.concat(before, "head").cast("string")
    seams = parts.select("_c", "part", (before.isNotNull() & ~pair.isin("su", "ua", "au")).cast("long").alias("seam"), before.isNull().alias("front"))
    seams = seams.join(spread, F.col("_c").eqNullSafe(F.col("_c2"))).select("part", "seam", F.when(F.col("front"), F.col("gaps")).otherwise(0).alias("gaps"))
    out = parts.join(seams, "part").join(ways.drop("_c"), "part")
    out = out.select("_c", "part", "gaps", *_FAULTS, (F.col("illegal") + F.col("seam")).alias("illegal"), "cost", "state", "audit", "turns")
    return out.mapInArrow(_edits, f"_c {kind}, {_RECORD}")


def _records(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None, longest: int, longest_bytes: int, scratch: Scratch | None) -> tuple[DataFrame, DataFrame | None]:
    """Records of conversations that are whole, and of the parts of others, if there are any."""
    spark = rows.sparkSession
    bounded_batches(spark)
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    copies = F.coalesce(F.col(f"`{copies_col}`").cast("int"), F.lit(1)) if copies_col else F.lit(1)
    rows = rows.select(F.col(f"`{conv_col}`").alias("_c"), F.col(f"`{turn_col}`").try_cast("long").alias("_t"), cell(role_col).alias("_r"), cell(text_col).alias("_x"), copies.alias("_n"))
    n = F.greatest("_n", F.lit(0)).cast("long")
    sizes = rows.groupBy("_c").agg(F.sum(n).alias("n"), F.sum(n * (F.octet_length("_r") + F.octet_length("_x"))).alias("b"), F.count(F.lit(1)).alias("rows"))
    scratch = scratch or Scratch(spark)
    long = scratch.save(sizes.where((F.greatest("n", "rows") > longest) | (F.col("b") > longest_bytes)).select(F.col("_c").alias("_l")), "long")
    some = long.limit(1).count() > 0
    same = F.col("_c").eqNullSafe(F.col("_l"))
    short = rows.join(long, same, "left_anti") if some else rows
    short = short.repartition("_c").sortWithinPartitions("_c", "_t", "_r", "_x")
    short = short.mapInArrow(_whole, f"_c {rows.schema['_c'].dataType.simpleString()}, {_RECORD}")
    if not some:
        return short, None
    rest = rows.join(long, same, "left_semi")
    gone = rest.groupBy("_c").agg(F.max("_n").alias("m")).where("m <= 0").select("_c", *[(F.lit(v) if v != [] else F.array()).cast(t).alias(c) for (c, v), t in zip({"part": 0, **_NO_TURNS}.items(), [x.split()[1] for x in _RECORD.split(", ")], strict=True)])
    return short.unionByName(gone), _of_parts(rest, longest, longest_bytes, scratch)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, longest: int = LONG, longest_bytes: int = LONG_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(conversation, part, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation.

    repaired: the turns, role and text, after the edits that the audit's letters name: Keep, Rerole to user or
    assistant, Delete, Insert. A conversation up to ``longest`` turns and ``longest_bytes`` bytes is one part, a longer one several, whose counts
    add up and whose audits and turns follow one another.

    Null roles and texts are one space, null conversations are one conversation, turns that are null or no whole
    numbers come first. Turns are ordered by number, role and text, so ties have one order. A role that begins with
    neither s, u nor a can't be kept, an empty one among them. copies: how often a row stands there, for instance
    0 for a row that was lost but whose conversation is known; null: once. Gaps beyond 64 bits are the largest long.
    Other columns are dropped.
    """
    whole, parts = _records(rows, conv_col, turn_col, role_col, text_col, copies_col, longest, longest_bytes, scratch)
    both = whole if parts is None else whole.unionByName(parts)
    return both.withColumn("repaired", F.col("repaired").cast("array<struct<role:string,text:string>>")).withColumnRenamed("_c", conv_col)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, of the sorted parts of records, a part in memory at a time."""
    kind, last, sums, audit, digest, any_turn = None, None, None, [], None, False

    def record() -> pa.RecordBatch:
        values = [*sums, "".join(audit), digest.hexdigest()]
        kinds = [pa.int64()] * len(_COUNTS) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([last], kind), *(pa.array([v], t) for v, t in zip(values, kinds, strict=True))], names=["_c", *_COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if sums is None or row["_c"] != last:
                if sums is not None:
                    yield record()
                last, sums, audit, digest, any_turn = row["_c"], [0] * len(_COUNTS), [], hashlib.sha256(), False
            sums = [a + row[c] for a, c in zip(sums, _COUNTS, strict=True)]
            audit.append(row["audit"])
            for t in row["repaired"]:
                digest.update((b"\n" if any_turn else b"") + t["role"] + b":" + t["text"])
                any_turn = True
    if sums is not None:
        yield record()


def report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, longest: int = LONG, longest_bytes: int = LONG_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row each.

    The hash is of the repaired turns as ``role:text``, joined by newlines; of nothing, if none are left.
    """
    whole, parts = _records(rows, conv_col, turn_col, role_col, text_col, copies_col, longest, longest_bytes, scratch)
    lines = F.transform("repaired", lambda t: F.concat(t["role"].cast("string"), F.lit(":"), t["text"].cast("string")))
    out = whole.select("_c", *_COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    if parts is not None:
        kinds = f"_c {rows.schema[conv_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
        out = out.unionByName(parts.repartition("_c").sortWithinPartitions("_c", "part").mapInArrow(_hashes, kinds))
    return out.withColumnRenamed("_c", conv_col)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, turn, role, text, copies): faults put in by the CRC-32 of ``conversation:turn``, modulo 20.

    0 loses the row (no copies), 1 empties its text, 2 takes ``.!?`` out of it, 3 doubles it, 4 makes it the user's.
    Nulls are one space, in the hashed string too.
    """
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(cell(conv_col), F.lit(":"), cell(turn_col))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(cell(text_col), ".!?", "")).otherwise(cell(text_col))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return rows.select(F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`"), F.when(code == 4, "user").otherwise(cell(role_col)).alias(role_col), text.alias(text_col), copies.alias("copies"))
