import hashlib
from collections import Counter

import numpy as np

from cartolith.llm import repeats

SF = "/root/testdata/sf0.01"


def brute(docs, length=repeats.LENGTH):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=str)


def planted(make_docs, seed=3):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared, long = word(230), word(900)
    texts = [word(300) + shared + word(100), shared[:210] + word(50), word(10) + shared[5:215] + word(400), long, word(40) + long[100:700] + word(40)]
    texts += [long[:199], long[300:500], "ab" * 400, word(150) + word(1) + "ab" * 130, "x" * 199, "y" * 200, "z" * 201, "", None, shared, shared]
    texts += [word(30) + shared + str(j) * 3 + word(200) for j in range(20)]
    return make_docs([(i, t, "s") for i, t in enumerate(texts)] + [(None, word(250), "s"), (3, long, "s")])


def test_planted_repeats(make_docs):
    docs = planted(make_docs)
    assert result(repeats.without_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_groups_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    docs = planted(make_docs, 4)
    assert result(repeats.without_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_common_passage_in_many_places(make_docs):
    """Groups beyond the limit as it is: near copies with changes all over, periods, one line everywhere."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line, text = word(190), word(700)
    docs = [word(20) + line + word(20) for _ in range(1500)] + [word(60) + line + "same end of it " + word(9) for _ in range(700)]
    for _ in range(1200):
        at = int(rng.integers(0, 700))
        docs.append(text[:at] + word(1) + text[at + 1 :])
    docs += ["abc" * 400, "abc" * 2600]
    df = make_docs([(i, t, "s") for i, t in enumerate(docs)])
    assert result(repeats.without_repeats(df)) == brute(list(enumerate(docs)))


def test_windows_of_a_group():
    """The sort of a task against counting windows."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        base = bytes(rng.integers(97, 100, 500, dtype=np.uint8))
        contexts, rel, n = [], [], []
        for _ in range(int(rng.integers(1, 12))):
            a, b = int(rng.integers(0, 170)), int(rng.integers(0, 170))
            c = bytearray(base[200 - a : 240 + max(b, repeats.LENGTH - 40 - a)])
            for _ in range(int(rng.integers(0, 3))):
                x = int(rng.integers(0, len(c)))
                if not a <= x < a + repeats.GRAM:
                    c[x] = 33
            contexts.append(bytes(c[: repeats.LENGTH + a]))
            rel.append(a)
            n.append(int(rng.integers(1, 3)))
        seen = Counter()
        for c, r, m in zip(contexts, rel, n, strict=True):
            for p in range(max(0, r - repeats.REST), min(r, len(c) - repeats.LENGTH) + 1):
                seen[r - p, c[p : p + repeats.LENGTH]] += m
        zero = np.zeros(len(n), int)
        got = repeats.repeated_windows(contexts, np.array(rel), zero, np.array(n), zero, zero + repeats.REST)
        for c, r, spans in zip(contexts, rel, got, strict=True):
            covered = {q for a, b in zip(spans[::2].tolist(), spans[1::2].tolist(), strict=True) for q in range(r + a, r + b)}
            true = set()
            for p in range(max(0, r - repeats.REST), min(r, len(c) - repeats.LENGTH) + 1):
                if seen[r - p, c[p : p + repeats.LENGTH]] > 1:
                    true.update(range(p, p + repeats.LENGTH))
            assert covered == true


def test_long_texts_are_cut_with_an_overlap(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 10)
    repeats._powers.cache_clear()
    docs = planted(make_docs, 5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = [repeats._anchor_rows(True)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([t or "" for _, t in rows])], names=["i", "h", "text"])
    small = {(r["k"], r["i"], r["first"] + d) for b in pieces[0](iter([batch])) for r in b.to_pylist() for d in range(r["more"] + 1)}
    monkeypatch.undo()
    repeats._powers.cache_clear()
    large = {(r["k"], r["i"], r["first"] + d) for b in repeats._anchor_rows(True)(iter([batch])) for r in b.to_pylist() for d in range(r["more"] + 1)}
    assert small == large


def test_documents_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    assert result(repeats.without_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_documents(odd_docs):
    assert result(repeats.without_repeats(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert repeats.without_repeats(odd_docs.where("false")).count() == 0
