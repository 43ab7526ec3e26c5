"""One query an operator over its whole table, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, hnsw, htmltext, infill, lm, mixing, packing, passages, pii, quality, repeats, simhash, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"))


def op6_mixing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = quality.apply_policy(rows, "base").withColumnRenamed("kept", "base_kept")
    judged = quality.apply_policy(base, "v1")
    return judged.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT base_kept AS base_failed", "kept"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and what it alone rejects."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.damaged(table(spark, sf_dir, "conversations"))
    return conversation.report(rows, copies_col="copies")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.infill(table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_passages(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Query] = {
    "op1_hnsw": op1_hnsw,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_surrogates": op5_surrogates,
    "op6_mixing_model": op6_mixing_model,
    "op7_quality": op7_quality,
    "quality_ablations": quality_ablations,
    "op8_tokens": op8_tokens,
    "op9_repeats": op9_repeats,
    "op10_html": op10_html,
    "op11_conversation": op11_conversation,
    "op12_infill": op12_infill,
    "op13_passages": op13_passages,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op9_repeats": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d)),
m AS (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
i AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM i),
s AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, g),
t AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS b FROM s GROUP BY r),
pieces AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT r, b, NULL FROM t),
kept AS (SELECT r, string_agg(substr(h, 2 * x + 1, CASE WHEN y IS NULL THEN length(h) ELSE 2 * (y - x) END), '' ORDER BY x) AS left_ FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_, h))) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN kept USING (r)""",
    "op1_hnsw": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op4_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM totals)::DOUBLE
      - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
final AS (SELECT arg_min(level, (3 * source_size / weight, level)) AS level FROM leveled WHERE NOT 3 * source_size < level * weight),
goals AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < l.level * weight THEN (3 * source_size)::DOUBLE
              ELSE least((3 * source_size)::DOUBLE, final.level * weight) END AS target
  FROM leveled l, final),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goals),
extras AS (SELECT *, floor(target)::BIGINT - epochs * source_size AS extra FROM budgets),
running AS (
  SELECT s.*, e.source_size, e.target, e.epochs, e.extra,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         sum(size) OVER (PARTITION BY s.source, h) AS tied
  FROM sized s JOIN extras e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN size = 0 OR extra = 0 THEN 0 WHEN run <= extra THEN size
         WHEN run - tied < extra THEN (size * (extra - (run - tied))) // tied ELSE 0 END)::BIGINT AS taken
FROM running""",
    "op7_quality": rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS} AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
g AS (SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM w),
c AS (SELECT *, list_aggregate(grams, 'histogram') AS hist FROM g),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(range(1, len(words) + 1), lambda i:
      (i <= len(grams) AND hist[grams[i]] > 1) OR (i > 1 AND i - 1 <= len(grams) AND hist[grams[i - 1]] > 1)
      OR (i > 2 AND i - 2 <= len(grams) AND hist[grams[i - 2]] > 1)))::BIGINT AS n_repeat_words
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 5 * word_chars
    OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) OR 100 * n_exclamations > 60 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m""",
    "op11_conversation": r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda ch: ord(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS code FROM given),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, E' \t\n\x0b\x0c\r') AS body FROM hurt),
faulty AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
  CASE WHEN body = '' THEN 'b' WHEN seen THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
inserted(state, next, edits, price, rows_) AS (VALUES ('', '', '', 0, []), ('', 'u', 'I', 2, ['user:']), ('', 'a', 'II', 4, ['user:', 'assistant:']), ('s', 's', '', 0, []), ('s', 'u', 'I', 2, ['user:']),
  ('s', 'a', 'II', 4, ['user:', 'assistant:']), ('u', 'u', '', 0, []), ('u', 'a', 'I', 2, ['assistant:']), ('a', 'a', '', 0, []), ('a', 'u', 'I', 2, ['user:'])),
way(conv_id, i, state, cost, audit, rows_) AS (
  SELECT conv_id, 0::BIGINT, next, price::BIGINT, edits, rows_ FROM counts, inserted WHERE state = ''
  UNION ALL
  SELECT conv_id, i, next, min(x.cost), arg_min(x.audit, (x.cost, x.audit)), arg_min(x.rows_, (x.cost, x.audit)) FROM (
    SELECT e.conv_id, e.i, e.cost + price AS cost, e.audit || edits AS audit, e.rows_ || t.rows_ AS rows_, t.next FROM (
      SELECT w.conv_id, f.i, w.cost + o.price AS cost, w.audit || o.edit AS audit, CASE WHEN o.edit = 'D' THEN w.rows_ ELSE w.rows_ || [CASE WHEN o.edit = 'K' THEN f.role WHEN w.state = 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text] END AS rows_,
        CASE o.edit WHEN 'D' THEN w.state WHEN 'K' THEN f.c ELSE CASE WHEN w.state = 'u' THEN 'a' ELSE 'u' END END AS state
      FROM way w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1,
        LATERAL (SELECT unnest(['D', 'K', 'R']) AS edit, unnest([3, (f.fault = 't')::INTEGER, 2 + (f.fault = 't')::INTEGER]) AS price) o
      WHERE o.edit = 'D' OR f.fault NOT IN ('b', 'd') AND (o.edit = 'R' OR w.state || f.c IN ('s', 'u', 'su', 'ua', 'au'))) e
    JOIN inserted t USING (state)) x
  GROUP BY conv_id, i, next),
best AS (SELECT w.conv_id, arg_min(w.cost, (w.cost, w.audit)) AS cost, arg_min(w.audit, (w.cost, w.audit)) AS audit, arg_min(w.rows_, (w.cost, w.audit)) AS rows_
  FROM way w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE w.state IN ('', 'a') GROUP BY w.conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows_, E'\n'), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON g.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op12_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (length(t) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (length(t) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM k),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
    "op13_passages": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
h AS (SELECT *, list_transform(range(1, greatest(len(w) - 33, 1)), lambda p: md5(array_to_string(w[p:p + 34], ' '))) AS k FROM d),
u AS (SELECT r, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word, unnest(k) AS k FROM h),
c AS (SELECT k FROM u WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
g AS (SELECT r, q, word, max((u.k IS NOT NULL AND c.k IS NOT NULL)::INTEGER) OVER (PARTITION BY r ORDER BY q ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM u LEFT JOIN c ON u.k = c.k),
t AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (gone = 0) AS kept FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)""",
}

#: The measurements of op7_quality, then each rule's failures.
ORACLE["quality_ablations"] = (
    ORACLE["op7_quality"].rpartition("SELECT doc_id, n_words")[0].rstrip()
    + """,
f AS (SELECT [n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 5 * word_chars, n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines,
  100 * n_exclamations > 60 * n_words, word_chars < 2 * n_words OR word_chars > 20 * n_words] AS failed FROM m),
e AS (SELECT unnest(['short', 'repeated_windows', 'symbols', 'repeated_lines', 'exclamations', 'word_length']) AS rule, unnest(range(1, 7)) AS k)
SELECT rule, (count(*) FILTER (failed[k]))::BIGINT AS n_failed,
  (count(*) FILTER (failed[k] AND len(list_filter(failed, lambda x: x)) = 1))::BIGINT AS n_only_this
FROM f, e GROUP BY rule"""
)
