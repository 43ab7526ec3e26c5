import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from cartolith.llm import mixing, quality, simhash
from cartolith.llm.common import Scratch, components, spanning_edges

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality ------------------------------------------------------------------------------------------


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark, odd_docs, make_docs):
    more = make_docs([(1, "a b c a b c a b c", "s"), (2, "x x x x", "s"), (3, "l 1\nl 1\n\n \n \nl 1", "s"), (4, "a b c d b c d b c", "s"), (5, "# ** \U0001f600* <|>", "s"), (6, "one\x0btwo\x0cthree\xa0four", "s")])
    for docs in (odd_docs, more, spark.read.parquet(f"{SF}/documents.parquet")):
        want = sorted(((r.doc_id, *measured(r.text)) for r in docs.collect()), key=str)
        assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in quality.ledger(docs).collect()), key=str) == want
    assert quality.ledger(odd_docs.where("false")).count() == 0


def test_policies_and_ablations(spark):
    rows = quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    for policy in quality.POLICIES:
        kept = {(r.doc_id): r.kept for r in quality.apply_policy(rows, policy).collect()}
        bits = {r.doc_id: r.fail_bits & quality.mask_of(policy) for r in rows.collect()}
        assert all(kept[i] == (b == 0) for i, b in bits.items())
        for r in quality.ablations(rows, policy).collect():
            bit = 1 << list(quality.RULES).index(r.rule)
            assert r.n_failed == sum(bool(b & bit) for b in bits.values()) and r.n_only_this == sum(b == bit for b in bits.values())
    assert {r.rule for r in quality.ablations(rows).collect()} == set(quality.RULES)


def test_ablations_as_their_sql_says(spark):
    import duckdb

    from cartolith.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet{'/*.parquet' if os.path.isdir(SF + '/documents.parquet') else ''}'")
    want = con.execute(f"SELECT rule, n_failed, n_only_this FROM ({queries.ORACLE['quality_ablations']})").fetchall()
    got = queries.quality_ablations(spark, SF).select("rule", "n_failed", "n_only_this").collect()
    assert sorted(want) == sorted(map(tuple, got)) and len(want) == 6 and any(n for _, n, _ in want)


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.apply_policy(quality.ledger(docs)).join(labels, "doc_id")
    clean = rows.where("quality = 1 AND n_words >= 50")
    assert clean.where("NOT kept").count() <= 0.002 * clean.count()
    assert rows.where("quality = 0 AND kept").count() <= 0.02 * rows.where("quality = 0").count()


# --- mixing -------------------------------------------------------------------------------------------


def mixed_by_hand(docs):
    sized = [(i, s, len(WORD.findall(t or "")), int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)) for i, t, s in docs]
    source = defaultdict(int)
    for _, s, n, _ in sized:
        source[s] += n
    order = sorted(source, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(source.values()), set()
    while True:  # excess is shared again until none is above
        left, w = total - sum(3 * source[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * source[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * source[s]}
        if not over:
            return sized, source, target
        full |= over


def check_mix(docs, rows):
    sized, source, target = mixed_by_hand(docs)
    assert sorted((r.doc_id, r.size, r.source_size) for r in rows if r.doc_id is not None) == sorted((i, n, source[s]) for i, s, n, _ in sized if i is not None)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.target == pytest.approx(target[r.source], rel=1e-12)
        taken[r.source] += r.taken
    for s in source:
        assert abs(taken[s] - target[s]) <= 2 + sum(n == 0 for *_, n, _ in sized)
    by_source = defaultdict(list)
    h = {i: x for i, _, _, x in sized}
    for r in rows:
        by_source[r.source].append((h[r.doc_id], r.extra_words, r.size))
    for found in by_source.values():  # nested: a document is taken whole before a later one is at all
        found = [x for x in sorted(found) if x[2]]
        partial = [k for k, (_, e, n) in enumerate(found) if 0 < e < n]
        zero = [k for k, (_, e, _) in enumerate(found) if e == 0]
        assert not zero or all(found[k][1] == 0 for k in range(zero[0], len(found))) or partial


def test_mix(spark, odd_docs, make_docs):
    tiny = make_docs([(k, "w " * (k % 5), None if k % 4 == 0 else f"s{k % 7}") for k in range(60)])
    skewed = make_docs([(k, "w " * 100, "big") for k in range(50)] + [(1000 + k, "w w", f"s{k}") for k in range(9)])
    for docs in (odd_docs, tiny, skewed, spark.read.parquet(f"{SF}/documents.parquet")):
        check_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.plan(docs).collect())
    assert mixing.plan(odd_docs.where("false")).count() == 0
    nothing = make_docs([(1, None, "a"), (2, "", None)])
    assert [(r.taken, r.target) for r in mixing.plan(nothing).collect()] == [(0, 0.0)] * 2 and mixing.mixed(nothing).count() == 0


def test_mix_of_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert text[r.doc_id].startswith(r.text)
    assert {i: n for i, n in want.items() if n} == dict(words)


def test_mix_with_joins_instead_of_broadcasts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.plan(docs).collect())) == want


# --- simhash ------------------------------------------------------------------------------------------


def print_of(text):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, distance=4):
    nodes = sorted(set(prints))
    label = {x: x for x in nodes}
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= distance and label[a] != label[b]:
                old, new = label[b], label[a]
                label = {x: new if c == old else c for x, c in label.items()}
    return label


def check_simhash(docs):
    rows = docs.collect()
    prints = [print_of(r.text) for r in rows]
    label = classes(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", least.get(label[p])) for r, p in zip(rows, prints, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str) == want


def test_simhash(spark, odd_docs, make_docs):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old grey house on the hill " * 6
    near = [(k, base + " tail" * (k % 3) + f" w{k}", "s") for k in range(40)]
    for docs in (odd_docs, make_docs(near), spark.read.parquet(f"{SF}/documents.parquet")):
        check_simhash(docs)
    assert simhash.simhash_components(odd_docs.where("false")).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_buckets_find_all_links(spark, wide, monkeypatch):
    import random

    if wide:
        monkeypatch.setattr(simhash, "THREE_SEGMENTS", 0)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for x in base:
        for _ in range(12):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    buckets = df.mapInArrow(simhash._probes(simhash.segments(len(prints))), "key long, print long").repartition("key").sortWithinPartitions("key")
    edges = buckets.mapInArrow(simhash._linked_runs(4), "a long, b long")
    found = {row.node: row.component for row in components(edges, Scratch(spark)).collect()}
    label = classes(prints)
    groups = defaultdict(set)
    for x in prints:
        groups[label[x]].add(x - (1 << 64) if x >> 63 else x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k, c in found.items() if c == root) for root in set(found.values())}


def test_long_runs_are_joined_without_all_pairs():
    import numpy as np

    rng = np.random.default_rng(2)
    points = np.concatenate([np.arange(0, 300) * 3.0, rng.uniform(2000, 4000, 100)])  # a chain and scattered ones
    edges = spanning_edges(len(points), lambda i, j: np.abs(points[i][:, None] - points[j][None, :]) <= 4)
    assert len(edges) <= len(points) - 1
    label = list(range(len(points)))
    for a, b in edges:
        assert abs(points[a] - points[b]) <= 4
        label = [label[a] if x == label[b] else x for x in label]
    assert len({label[i] for i in range(300)}) == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(8), Scratch(spark)).collect()
    assert {r.node: r.component for r in rows} == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_one_of_each(odd_docs, make_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # the null text, the empty one and the blank one are one group
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, 6, None], key=str)
    assert simhash.one_of_each(make_docs([])).count() == 0
