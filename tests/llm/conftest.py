import pytest

EXTRA = "x string, _row long, size long, id long, component_id long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those that operators use inside."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, len(t or ""), "x", 1, 2, 3, 4) for i, t, s in rows],
            "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA,
        )

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    return make_docs(
        [(1, "a b c d e f g h", "s1"), (2, None, "s1"), (3, "", None), (None, "null id text here now", "s2"), (4, long, "s2"), (5, "same same same\tsame\n\nsame", "s1"), (5, "same same same\tsame\n\nsame", "s1"), (6, "İstanbul ΣΑΣ   <|endoftext|> naïve 你好 \U0001f600  two  blanks x", None), (7, " \n\t ", "s3")]
    )
