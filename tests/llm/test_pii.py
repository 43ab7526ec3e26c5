import re
from collections import defaultdict

from pyspark.sql import functions as F

from cartolith.llm import pii
from cartolith.llm.common import Scratch

SF = "/root/testdata/sf0.01"
TEXTS = [
    "Call +1 (017) 555-7713 or mail anna.34@mail7.example.com now.",
    "mail ANNA.34@mail7.example.com*** from 248.40.198.62, card 2531585014589253 (2531 5850 1458 9253)",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 9233A8ECF7C5B09FE5949719B6B82BC439E9329B, 04dbebab91ab85687d33eeaaf9ac699e1188f962',
    "Mr. John Smith met Mrs. Smith and Frau Müller; Dr. Mary Jones too. Mr. John Smith left. Г-н. My name is Иван Петров.",
    "ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, call 415-555-0134.",
    "Version 2.0. In 1999 there were 12345678 things, 3.14159 of them at 10:30 on 2024-01-02; The License, CC BY-NC 4.0.",
    "The Mr and the name of a key: token of secret love.",
    "",
    None,
]


def run(make_docs, texts, **kw):
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    return [r.asDict() for r in pii.replaced(docs, **kw).orderBy("doc_id").collect()]


def test_kinds_and_formats(make_docs):
    rows = run(make_docs, TEXTS)
    assert [r["_entities"] for r in rows] == [["phone", "email"], ["email", "ip", "card", "card"], ["assigned", "secret", "secret"], ["person"] * 6, ["ssn", "iban", "phone"], [], [], [], []]
    t = [r["text"] for r in rows]
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or mail [a-z]{4}\.\d\d@[a-z]{4}\d\.example\.net now\.", t[0])
    mail = re.search(r"\S+@\S+\.net", t[0])[0]
    assert re.search(r"mail (\S+)\*\*\*", t[1])[1].lower() == mail and mail.split("@")[0].upper() in t[1]
    card = re.search(r"card (\d{16}) \((\d{4} \d{4} \d{4} \d{4})\)", t[1])
    assert card[1] == card[2].replace(" ", "") and re.search(r"from (?:\d{1,3}\.){3}\d{1,3},", t[1])
    secret = re.fullmatch(r'token = "([0-9a-f]{40})" and ([0-9A-F]{40}), ([0-9a-f]{40})', t[2])
    assert secret[1] == secret[3] != secret[2].lower()
    people = re.fullmatch(r"Mr\. (\w+ \w+) met Mrs\. (\w+) and Frau (\w+); Dr\. (\w+ \w+) too\. Mr\. (\w+ \w+) left\. Г-н\. My name is (\w+ \w+)\.", t[3])
    assert people[1] == people[5] and people[1].split()[0] in pii.FIRST_NAMES["latin", "m"] and people[4].split()[0] in pii.FIRST_NAMES["latin", "f"]
    assert re.fullmatch(r"[Ѐ-ӿ ]+", people[6])
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}, iban DE\d\d(?: \d{4}){4} \d\d, call \d{3}-\d{3}-\d{4}\.", t[4])
    assert t[5:] == TEXTS[5:]
    assert set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars", "x", "_row", "size", "id", "component_id", "_entities"}
    for r, old in zip(t[:5], TEXTS[:5], strict=True):
        for whole in re.findall(r"\d{4,}|[0-9a-f]{40}|anna\.34|Smith|Müller|Jones", old):
            assert whole not in r


def test_keys_give_different_surrogates(make_docs):
    a, b = run(make_docs, TEXTS[:2]), run(make_docs, TEXTS[:2], key="other")
    assert a[0]["text"] != b[0]["text"] and run(make_docs, TEXTS[:2]) == a


def test_collisions_are_drawn_again(make_docs, monkeypatch, spark):
    """With few surrogates to draw from, entities stay distinct and mentions of one stay the same."""
    monkeypatch.setattr(pii, "_octets", lambda d: F.concat(F.lit("10.0.0."), F.conv(F.substring(d, 1, 1), 16, 10)))
    ips = [f"9.8.7.{i}" for i in range(9)] + ["10.0.0.3"]
    rows = run(make_docs, [f"{ip} and {ip}" for ip in ips] + [" ".join(ips)])
    new = [r["text"].split(" and ") for r in rows[:-1]]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(ips)
    assert rows[-1]["text"].split(" ") == [a for a, _ in new] and not {a for a, _ in new} & set(ips)


def test_no_documents(make_docs):
    assert pii.replaced(make_docs([])).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in pii.replaced(docs).collect()}
    shown = defaultdict(set)
    entity = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\d)|(?<!\w)\d{16}(?!\w)|(?<!\w)[0-9a-f]{40}(?!\w)")
    for r in docs.collect():
        old = entity.findall(r.text)
        for e in old:
            assert e not in rows[r.doc_id].text
        if not rows[r.doc_id]._entities:
            assert rows[r.doc_id].text == r.text
        assert len(rows[r.doc_id]._entities) >= len(old)
    assert sum(len(r._entities) for r in rows.values()) > 20


def test_draws_end(make_docs):
    scratch = Scratch(make_docs([]).sparkSession)
    settled, lasts = pii.settled_entities(make_docs([(1, TEXTS[0], "s")]), "text", pii.KEY, scratch)
    assert settled.count() == 0 and lasts.count() == 0


def test_coreference_of_people(make_docs):
    """One replacement a name, whatever its title and case; last names agree; gender over all mentions."""
    texts = ["Mr. Kim Lee met My name is Kim Lee or Mrs. Kim Lee; Mr. Lee, Mr. LEE.", "Dr. Ada Smith; Mrs. Ada Smith; Mr John Fitzgerald Kennedy, Mr. Kennedy."]
    one, two = (r["text"] for r in run(make_docs, texts))
    m = re.fullmatch(r"Mr\. (\w+ \w+) met My name is (\w+ \w+) or Mrs\. (\w+ \w+); Mr\. (\w+), Mr\. (\w+)\.", one)
    assert m[1] == m[2] == m[3] and m[1].split()[1] == m[4] and m[5] == m[4].upper()
    assert m[1].split()[0] in pii.FIRST_NAMES["latin", "n"]
    m = re.fullmatch(r"Dr\. (\w+ \w+); Mrs\. (\w+ \w+); Mr (\w+) (\w+) (\w+), Mr\. (\w+)\.", two)
    assert m[1] == m[2] and m[1].split()[0] in pii.FIRST_NAMES["latin", "f"] and m[5] == m[6] and m[3] in pii.FIRST_NAMES["latin", "m"]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def test_check_digits(make_docs):
    texts = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    new = [r["text"] for r in run(make_docs, texts)]
    assert luhn(re.sub(r"\D", "", new[0])) and luhn(re.sub(r"\D", "", new[1])) and iban(new[3]) and iban(new[4])
    assert [x[0] for x in new[:3]] == ["4", "5", "4"] and new[3][:2] == "DE" and new[4][:2] == "GB"
    assert all(a != b and re.sub(r"\w", "x", a) == re.sub(r"\w", "x", b) for a, b in zip(texts, new, strict=True))


def test_long_secrets_go_whole(make_docs):
    jwt = "eyJ" + "aB3-_." * 60 + "zz"
    texts = [f"a {jwt} b", "c " + "0f" * 150 + " d", "sk-" + "Q1w" * 110, 'password = "' + "p4 " * 90 + '"']
    for old, r in zip(texts, run(make_docs, texts), strict=True):
        for k in range(0, len(old) - 12):
            assert len(set(old[k : k + 12])) < 5 or old[k : k + 12] not in r["text"] or old[k : k + 8] in ('password', 'assword ')


def test_against_brute_force(make_docs, spark):
    """Entities found and replaced by plain Python from the table's own replacements: texts are equal, replacements
    are functions of the entity, no two entities share one, and none is an entity."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = defaultdict(dict)
    found = docs.select("doc_id", "text", pii.matches(pii.text_of("text")).alias("found")).collect()
    new = {r.doc_id: r for r in pii.replaced(docs).collect()}
    for r in found:
        at, rest, text = 0, new[r.doc_id].text, r.text
        assert len(r.found) == len(new[r.doc_id]._entities)
        for n, (e, kind) in enumerate(zip(r.found, new[r.doc_id]._entities, strict=True)):
            where = text.index(e, at)
            assert rest.startswith(text[at:where])
            rest, at = rest[where - at :], where + len(e)
            after = text[at : text.index(r.found[n + 1], at)] if n + 1 < len(r.found) else text[at:]
            end = rest.index(after) if after and n + 1 < len(r.found) else len(rest) - len(after)
            kinds[kind].setdefault(e, set()).add(rest[:end])
            rest = rest[end:]
        assert rest == text[at:]
    bare = lambda kind, e: re.sub(r"[^0-9]", "", e) if kind in ("phone", "card", "ssn") else e.lower()
    for kind, pairs in kinds.items():
        assert all(len(x) == 1 for x in pairs.values())
        by = defaultdict(set)
        for e, x in pairs.items():
            by[bare(kind, min(x))].add(bare(kind, e))
        assert all(len(x) == 1 for x in by.values()) and not set(by) & {bare(kind, e) for e in pairs}
