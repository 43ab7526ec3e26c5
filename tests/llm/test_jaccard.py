import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from cartolith.llm import jaccard, simhash

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_hand(rows):
    """(id, text) of one row of each component, by all pairs of sets."""
    sets = sorted({grams(t) for _, t in rows}, key=len)
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if 5 * len(a) < 4 * len(sets[j]):
                break
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                up[find(j)] = find(i)
    at, least = {s: find(i) for i, s in enumerate(sets)}, {}
    for i, t in rows:
        least.setdefault(at[grams(t)], []).append((i is not None, i or 0))
    return sorted(min(x) for x in least.values())


def ids_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.collect())


def near_copies(n, words=60):
    base = [f"base{i}" for i in range(words)]
    return [(k, " ".join(w if (i * 7 + k * 13) % 191 else f"new{k}" for i, w in enumerate(base)) + f" end{k}", "s") for k in range(n)]


@pytest.mark.parametrize("run", [2, 32])
def test_against_all_pairs(spark, odd_docs, make_docs, run, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_RUN", run)
    near = near_copies(120) + [(500 + k, f"only{k} " * 3 + "one very common line of words in all of these", "s") for k in range(80)]
    for docs in (odd_docs, make_docs(near), spark.read.parquet(f"{SF}/documents.parquet")):
        assert ids_of(simhash.one_of_each(docs)) == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.one_of_each(make_docs([])).count() == 0


def test_the_stage_joins_five_word_shingles_at_four_fifths(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IN (255, 1, 582, 875, 643, 770)")
    assert ids_of(corpus_pipeline.near_duplicates(spark, docs, SF)) == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == 3


def test_rows_without_or_with_equal_ids_stay(make_docs):
    words = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(None, words(f"n{k}"), "s") for k in range(5)] + [(7, words("x"), "s"), (7, words("y"), "s"), (3, words("y"), "s"), (7, words("x"), "s")]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(make_docs(rows)).collect()]
    assert sorted(kept, key=str) == sorted([*((None, words(f"n{k}")) for k in range(5)), (7, words("x")), (3, words("y"))], key=str)


def test_common_buckets_give_rows_for_similar_sets_only():
    """Unrelated sets that share one shingle are no pairs; those that are similar all are."""
    import numpy as np
    import pyarrow as pa

    ratio, rng = jaccard.fraction(0.8), np.random.default_rng(5)
    sets = [np.unique(rng.integers(1, 1 << 62, 200).astype(np.uint64)) for _ in range(300)]
    for i in range(0, 40, 2):
        sets[i + 1] = np.unique(np.concatenate([sets[i][: len(sets[i]) - 20], rng.integers(1, 1 << 62, 20).astype(np.uint64)]))
    n = len(sets)
    columns = [pa.array([7] * n), pa.array(range(n)), pa.array([len(x) for x in sets]), pa.array(range(n)), pa.array([jaccard.sketch(x) for x in sets], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "node", "size", "part", "sketch"])
    found = {(a, b) for out in jaccard._across(ratio, None)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert found >= {(i, i + 1) for i in range(0, 40, 2)}
    assert len(found) < 40
    for a in range(0, n, 7):  # sketches never differ in more places than sets in shingles
        for b in range(n):
            x, y = (np.frombuffer(jaccard.sketch(sets[k]), np.uint64) for k in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(sets[a], sets[b]))


def test_large_buckets_take_one_pass_of_leaders(spark, make_docs, monkeypatch):
    """Each pass over large buckets is many jobs; plans, tasks and broadcasts of all add up in the driver."""
    from cartolith.llm.common import Scratch

    monkeypatch.setattr(jaccard, "SHORT_RUN", 2)
    docs, scratch = make_docs(near_copies(120)), Scratch(spark)
    assert ids_of(simhash.one_of_each(docs, scratch=scratch)) == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert scratch.made < 16
