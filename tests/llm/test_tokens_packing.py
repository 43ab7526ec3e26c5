import zlib
from collections import defaultdict

import numpy as np

from cartolith.llm import packing, tokens

SF = "/root/testdata/sf0.01"


def check_packing(docs, rows, window=2048):
    tokenizer = tokens.load_tokenizer(tokens.vocabulary_path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        if len(want[i]) > 1:
            assert sum(p.length for p in pieces) == sum(map(len, want[i]))
            continue
        ids, at = want[i][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing_matches_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())


def test_packing_of_odd_documents(odd_docs):
    check_packing([(r.doc_id, r.text) for r in odd_docs.collect()], packing.pack(odd_docs).collect())
    with_ids = packing.pack(odd_docs, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_packing_of_no_documents(odd_docs):
    assert packing.pack(odd_docs.where("false")).count() == 0


def test_index_finds_the_document_that_shares_words():
    rng = np.random.default_rng(1)
    docs = [rng.integers(100, 5000, 60).astype("<u4") for _ in range(40)]
    docs[31] = np.concatenate([docs[4][:40], docs[31][:20]])
    index = packing.Index(docs)
    used = np.zeros(40, bool)
    used[4] = True
    assert index.neighbours(index.terms[4], used)[0] == 31
    used[31] = True
    assert 31 not in index.neighbours(index.terms[4], used)


def test_neighbours_against_plain_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, int(rng.integers(1, 90))).astype("<u4") for _ in range(150)]
    index, used, mean = packing.Index(docs), rng.random(150) < 0.3, np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(300)}
    for seed in range(0, 150, 7):
        score = {}
        for j, d in enumerate(docs):
            for t in set(docs[seed].tolist()) & set(d.tolist()):
                n = (d == t).sum()
                idf = np.log1p((150 - df[t] + 0.5) / (df[t] + 0.5))
                score[j] = score.get(j, 0) + idf * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        best = sorted((j for j in score if not used[j]), key=lambda j: -score[j])[: packing.NEIGHBOURS]
        got = index.neighbours(index.terms[seed], used)
        np.testing.assert_allclose([score[j] for j in got], [score[j] for j in best], rtol=1e-5)


def test_windows_go_on_with_neighbours():
    """More small neighbours than are ranked at once, across two shards, before anything else."""
    rng = np.random.default_rng(3)
    like = [np.concatenate([[7, 8, 9], rng.integers(1000, 2000, 9)]).astype("<u4") for _ in range(160)]
    other = [rng.integers(5000, 9000, 12).astype("<u4") for _ in range(160)]
    docs = [x for pair in zip(like, other, strict=True) for x in pair]
    packer = packing.Packer(0)
    packer.shard(list(range(240)), docs[:240])
    packer.shard(list(range(240, 320)), docs[240:])
    packer.finish()
    first = [r[0] for r in packer.rows if r[5] == 0]
    assert sum(i % 2 == 0 for i in first[:120]) == 120
    assert sorted(r[0] for r in packer.rows if r[1] == 0) == list(range(320))


def counts(docs):
    tokenizer = tokens.load_tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    want = [(r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()]
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs).collect()]
    return sorted(got, key=str), sorted(want, key=str)


def test_counts_match_the_tokenizer(spark, odd_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs, odd_docs.where("false")):
        got, want = counts(docs)
        assert got == want


def test_caches_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 4)
    encoder = tokens.ByteEncoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    text = " ".join(f"word{i % 9}" for i in range(60)) + "\nnext line"
    assert encoder(text.encode()) == tokens.encode(encoder.tokenizer, text)
    counter = tokens.WordCounts(tokens.load_tokenizer(tokens.vocabulary_path("word_bpe_49k.json")), {b"word1": 2})
    assert sum(map(counter.__getitem__, text.encode().split())) == len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_ranks_give_the_ids_of_the_tokenizer(spark):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    fast, special = tokens.rank_encoder(path)
    assert special == [b"<|endoftext|>"]
    tokenizer = tokens.load_tokenizer(path)
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect() for w in r.text.split()}
    words |= {"it's", "we'LL", "12a3", " x　", "é", "'s's", "\U0001f600\U0001f600", "a​b", "ſ's"}
    for w in sorted(words):
        assert fast.encode_ordinary(" " + w) == tokenizer.encode(" " + w, add_special_tokens=False).ids
    assert tokens.rank_encoder(tokens.vocabulary_path("word_bpe_49k.json")) is None


def test_ids_of_many_strings():
    """White space of all kinds beside words, blanks and line ends: no string differs from the tokenizer."""
    rng = np.random.default_rng(4)
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    encoder = tokens.ByteEncoder(path)
    pieces = ["a", "é", "9", "'s", "!", "你", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", "<|endoftext|>"]
    texts = ["".join(pieces[k] for k in rng.integers(0, len(pieces), int(rng.integers(1, 8)))) for _ in range(150_000)]
    texts += [a + b + c for a in pieces for b in pieces for c in pieces]
    want = tokens.load_tokenizer(path).encode_batch(texts, add_special_tokens=False)
    assert not [t for t, w in zip(texts, want, strict=True) if encoder(t.encode()) != np.array(w.ids, "<u4").tobytes()]


def test_new_words_of_a_text_are_encoded_together(monkeypatch):
    """One call for a text, not one for a word; words at ends of lines, long and odd ones keep their ids."""
    encoder = tokens.ByteEncoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    calls = []
    plain = encoder.words.fast

    class Counted:
        def __getattr__(self, name):
            def call(text):
                calls.append(text)
                return getattr(plain, name)(text)

            return call

    encoder.words.fast = Counted()
    monkeypatch.setattr(tokens, "CACHE_WORDS", 150)
    for k in range(8):
        text = "\n".join(" ".join(f"w{k * j}x{i}é's" for i in range(9)) + f" {'long' * 40}{j} a　wide　x{j}" for j in range(12))
        assert encoder(text.encode()) == tokens.encode(encoder.tokenizer, text)
        assert not [w for w in encoder.words.known if len(w) > tokens.CACHED_BYTES]
    assert len(calls) <= 8
