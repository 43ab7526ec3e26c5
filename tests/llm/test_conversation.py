import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from cartolith.llm import conversation, queries

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile("(s?(ua)+)?")
NAMES = ("conv_id", *conversation._COUNTS, "audit", "repaired_sha256")


def every_edit(turns):
    """Cost, audit and initials of all ways to edit turns (initial, must go, truncated)."""
    inserts = ["", *"ua", *map("".join, itertools.product("ua", repeat=2))]
    gaps = [[(2 * len(x), "I" * len(x), x) for x in inserts]] * (len(turns) + 1)
    edits = []
    for c, must, cut in turns:
        edits.append([(3, "D", "")] + ([] if must else [(cut, "K", c or "?"), (2 + cut, "R", "u"), (2 + cut, "R", "a")]))
    for path in itertools.product(*(x for pair in zip(gaps, [*edits, [(0, "", "")]], strict=True) for x in pair)):
        costs, audit, initials = zip(*path, strict=True)
        if GRAMMAR.fullmatch("".join(initials)):
            yield sum(costs), "".join(audit)


def random_turns(rng, n):
    return [(str(rng.choice(list("suax") + [""])), bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(n)]


def test_cheapest_of_all_edits():
    rng = np.random.default_rng(11)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3):
        turns = random_turns(rng, n)
        assert conversation.cheapest([(c.encode(), must, cut) for c, must, cut in turns]) == min(every_edit(turns))


def test_parts_give_the_whole():
    rng = np.random.default_rng(13)
    for _ in range(300):
        turns = [(c.encode(), must, cut) for c, must, cut in random_turns(rng, int(rng.integers(1, 14)))]
        at = sorted(rng.integers(0, len(turns) + 1, int(rng.integers(0, 4))).tolist())
        parts = [turns[a:b] for a, b in zip([0, *at], [*at, len(turns)], strict=True)]
        cost, pieces = conversation.joined(map(conversation.cheapest_between, parts))
        assert (cost, "".join(p for p, _ in pieces)) == conversation.cheapest(turns)


def plain(rows):
    """The report, by a table of the cheapest (cost, audit) by state; rows: conv_id, turn, role, text, copies."""
    out = []
    for key in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == key for _ in range(n)]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        if not mine:
            out.append((key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        faults, seen = [], set()
        for _, r, x in mine:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", x)
            faults.append("b" if not body else "d" if (r, x) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((r, x))
        best = {"": (0, "", ())}
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}
        names = {"u": "user", "a": "assistant"}

        def offer(table, state, found):
            if state not in table or found < table[state]:
                table[state] = found

        def insertions(table):
            for _ in range(2):
                for s, (cost, audit, rows) in list(table.items()):
                    offer(table, follow[s], (cost + 2, audit + "I", (*rows, names[follow[s]] + ":")))

        insertions(best)
        for (_, r, x), f in zip(mine, faults, strict=True):
            after = {}
            for s, (cost, audit, kept) in best.items():
                offer(after, s, (cost + 3, audit + "D", kept))
                if f not in ("b", "d"):
                    offer(after, follow[s], (cost + 2 + (f == "t"), audit + "R", (*kept, f"{names[follow[s]]}:{x}")))
                    if r[:1] == follow[s] or s == "" and r[:1] == "s":
                        offer(after, r[:1], (cost + (f == "t"), audit + "K", (*kept, f"{r}:{x}")))
            insertions(after)
            best = after
        cost, audit, kept = min(best[s] for s in ("", "a") if s in best)
        turns = {t for t, _, _ in mine} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(mine)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((key, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, sizes):
    rng, out = np.random.default_rng(seed), []
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    for c, n in enumerate(sizes):
        for i in range(n):
            role = pick("user", "assistant", ("user", "assistant")[i % 2], ("user", "assistant")[i % 2], "system", "", "unit", None)
            text = pick("Yes.", "Well é", "no", "  \n", "", None, f"Number {i}.", f"Number {i}!  ", f"你{i}?")
            turn = pick(i, i, i, i + 3, i // 2, None)
            out.append((c if c else None, turn, role, text, pick(1, 1, 1, 1, 2, 0)))
    out += out[:3] + [(900, 1, "user", "gone", 0), (901, -(1 << 63), "user", "a.", 1), (901, (1 << 63) - 1, "assistant", "b.", 1)]
    return out


def limited(rows):
    return sorted(((*r[:1], min(r[1], (1 << 63) - 1), *r[2:]) for r in rows), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, copies int"


def test_random_conversations(spark):
    rows = random_rows(1, [6, 1, 2, 3, 9, 0, 14, 30])
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", part string, cost int")
    got = conversation.report(df, copies_col="copies")
    assert got.columns == list(NAMES)
    assert sorted(map(tuple, got.collect()), key=str) == limited(plain(rows))


@pytest.mark.parametrize(("turns", "size"), [(5, 1 << 23), (1 << 20, 60), (2, 9)])
def test_long_conversations_are_dealt_in_parts(spark, turns, size):
    rows = random_rows(2, [40, 3, 4, 5, 6, 120, 7])
    rows += [(950, 1, "user", "gone", 0)] * 200 + [(951, None, "user", "the same.", 1)] * 50 + [(951, 4, "assistant", "the same.", 2)] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    limits = {"copies_col": "copies", "longest": turns, "longest_bytes": size}
    assert sorted(map(tuple, conversation.report(df, **limits).collect()), key=str) == limited(plain(rows))
    parts = conversation.repaired(df, **limits).collect()
    assert max(len(r.audit.replace("I", "")) for r in parts) <= turns
    many = sorted((r for r in parts if r.conv_id == 5), key=lambda r: r.part)
    assert len(many) > 1 and sum(r.cost for r in many) == next(r[6] for r in plain(rows) if r[0] == 5)
    text = "\n".join(f"{t.role}:{t.text}" for r in many for t in r.repaired)
    assert hashlib.sha256(text.encode()).hexdigest() == next(r[8] for r in plain(rows) if r[0] == 5)


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, None, 77) for t in [*range(60), None] for r, x in (("assistant", "So. It! Is?"), (None, None))]
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if x is None else x
        want.append((c, t, "user" if code == 4 else r or " ", "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text, {0: 0, 3: 2}.get(code, 1)))
    got = conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {w[-1] for w in want} == {0, 1, 2}


def test_empty_tables_and_other_ids(spark):
    assert conversation.report(spark.createDataFrame([], SCHEMA), copies_col="copies").count() == 0
    named = spark.createDataFrame([("k", "2", "user", "Hi."), ("k", "three", "assistant", "Yes.")], "chat string, no string, who string, says string")
    got = conversation.report(named, "chat", "no", "who", "says").first()
    assert (got.chat, got.gaps, got.illegal, got.audit) == ("k", 0, 0, "IKKI")


def test_query_gives_what_its_sql_gives(spark):
    df = queries.op11_conversation(spark, SF)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE['op11_conversation']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and want
