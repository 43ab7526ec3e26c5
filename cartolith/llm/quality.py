"""Quality rules kept as a ledger of failure bits, to which versioned policies are applied.

Every rule is evaluated once a document; the ledger stores one bit a failed rule and all measurements.
A policy is a mask of rules. Ablations are bitwise aggregates over the counts of distinct bit masks,
never over texts again. All of it is built-in functions: one scan and no shuffle but that of the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, text_of, words_of

SYMBOLS = "#*$%&|<>"

#: name -> SQL condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 5 * word_chars",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "exclamations": "100 * n_exclamations > 60 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}

#: version -> rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _occurrences(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` (ASCII) a text holds."""
    counts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total.cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, by 64-bit hashes of the windows."""

    def grams(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(g: Column) -> Column:
        def spread(p: Column) -> Column:
            gaps = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), v + 3) - v))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        def starts(s: Column) -> Column:
            hit = F.filter(
                s,
                lambda x, k: (F.get(s, k + 1)["g"] == x["g"]) | (F.when(k > 0, F.get(s, k - 1)["g"]) == x["g"]),
            )
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        s = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("g"), i.alias("i"))))
        repeated = let(s, lambda s: let(starts(s), spread))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeated)

    return let(let(words, grams), covered).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and all measurements. A null text counts as an empty one."""
    text = text_of(text_col)

    def measures(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
            return let(
                lines,
                lambda rows: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    _occurrences(t, SYMBOLS).alias("n_symbols"),
                    _occurrences(t, "!").alias("n_exclamations"),
                    F.size(rows).cast("long").alias("n_lines"),
                    (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                    repeat_words(w).alias("n_repeat_words"),
                ),
            )

        return let(words_of(t), of_words)

    return docs.select(F.col(id_col), let(text, measures).alias("_m")).select(id_col, "_m.*")


def with_bits(measured: DataFrame) -> DataFrame:
    """The ledger: measurements and ``fail_bits``, bit k set where rule k fails."""
    bits = " | ".join(f"IF({rule}, {1 << k}L, 0L)" for k, rule in enumerate(RULES.values()))
    return measured.withColumn("fail_bits", F.expr(bits))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule ledger of all documents.

    Null or empty texts have zero words and fail "short"; repeated rows give repeated rows; an empty
    table gives an empty ledger; other columns of the input, whatever their names, aren't read.
    """
    return with_bits(measure(docs, id_col, text_col))


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``kept``: whether no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """One row a rule of the policy: documents it fails, and documents that it alone rejects."""
    mask = mask_of(policy)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    names = [n for n in RULES if n in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << list(RULES).index(n)).cast("long").alias("bit")) for n in names]))
    rows = counts.select("bits", "count", each.alias("r")).select("bits", "count", "r.*")
    return rows.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count"))), F.lit(0)).alias("n_only_this"),
    )
