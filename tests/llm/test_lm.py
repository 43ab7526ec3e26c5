import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cartolith.llm import lm

SF = "/root/testdata/sf0.01"


def brute(docs):
    rows = [(i, (t or "").encode().lower().split() + [None]) for i, t in docs]
    out_of = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    c = Counter(w for i, ws in rows if not out_of(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out_of(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in rows]


def same(docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs).collect()), key=str)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    return got


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lm, "SLOT_BITS", 16)


def test_table_and_held_out_gain(spark):
    got = same(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])
    again = sorted(((r.doc_id, r.score) for r in lm.score(spark.read.parquet(f"{SF}/documents.parquet")).collect()), key=str)
    assert [a[1] for a in again] == pytest.approx([g[6] for g in got], rel=1e-6)


def test_odd_documents_with_few_known_tokens(odd_docs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 300)
    monkeypatch.setattr(lm, "TREE", 50)
    got = same(odd_docs)
    assert all(np.isfinite(g[6]) and g[6] <= 0 for g in got)


def test_no_training_documents(make_docs):
    docs = make_docs([(i, "a b", "s") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    assert {(r.base_score, r.score) for r in lm.score(docs).collect()} == {(0.0, 0.0)}
    assert lm.score(make_docs([])).count() == 0


def test_bits_per_byte_are_those_of_the_score(odd_docs):
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    for r in lm.score(odd_docs).collect():
        if not texts[r.doc_id]:
            assert r.bits_per_byte is None
        else:
            assert -r.bits_per_byte * math.log10(2) * len(texts[r.doc_id]) == pytest.approx(r.score, rel=1e-9)


@pytest.mark.parametrize("n", [4, 31, 32, 33, 64, 1024, 1500])
def test_probabilities_of_the_next_token_sum_to_one(small, n):
    rng = np.random.default_rng(0)
    words = [b"", *(f"w{i}".encode() for i in range(300))]
    counts = np.sort(rng.integers(1, 1000, len(words)))[::-1]
    model = lm.Model(words, counts, int(counts.sum()) + 500, len(words) + 40)
    tables = rng.integers(0, 50, (2, 2, 1 << lm.SLOT_BITS)).astype(np.int64)
    model.learn(tables)
    context = rng.integers(0, 301, n).tolist()
    before = model.score(np.array(context))
    total = sum(10 ** (model.score(np.array([*context, leaf])) - before) for leaf in range(model.leaves + 1))
    assert total == pytest.approx(1, rel=1e-4)


def test_starting_weights_are_those_of_all_training_documents(spark, make_docs, monkeypatch):
    """Texts of one kind are longer than any limit on a fit's sample, yet they alone tell what weights a gate has."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 300) % 500) for _ in range(40)] + ["x y " * 60_000]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)]).repartition(5)
    seen = {}
    fit = lm.Model.fit
    monkeypatch.setattr(lm.Model, "fit", lambda self, cell, n: (seen.update(zip(cell.tolist(), n.tolist(), strict=True)), fit(self, cell, n))[1])
    model, _, ranked = lm.train(docs, lm.Scratch(spark), "doc_id", "text")
    training = [np.frombuffer(r.ranks, np.int32) for r in ranked.where("NOT held_out").collect()]
    assert sum(seen.values()) == sum(int(model.length[np.minimum(x, model.leaves)].sum()) for x in training)
    assert ranked.where("NOT held_out").count() == sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts)))


def test_scores_of_texts_together_are_those_of_each(small):
    rng = np.random.default_rng(2)
    words = [b"", *(f"w{i}".encode() for i in range(300))]
    counts = np.sort(rng.integers(1, 1000, len(words)))[::-1]
    model = lm.Model(words, counts, int(counts.sum()) + 500, len(words) + 40)
    model.learn(rng.integers(0, 50, (2, 2, 1 << lm.SLOT_BITS)).astype(np.int64))
    ranks = [rng.integers(0, 302, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 64, 65, 1023, 1024, 1025, 2048, 3000)]
    assert model.scores(ranks) == pytest.approx([model.score(x) for x in ranks], rel=1e-6)
    cells = sum(model.cells(*lm._joined([x])) for x in ranks)
    assert np.array_equal(model.cells(*lm._joined(ranks)), cells)
    one, many = (np.zeros((2, 2 << lm.SLOT_BITS), np.int64) for _ in range(2))
    model.count(*lm._joined(ranks), many)
    for x in ranks:
        model.count(*lm._joined([x]), one)
    assert np.array_equal(one, many)
