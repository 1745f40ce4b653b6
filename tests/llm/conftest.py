import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text[, lang[, source]]) tuples, with columns whose
    names clash with the operators' own ones."""

    def make(rows, clash=True):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *(None, "en", "src1")[len(r) - 1 :])[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if clash:
            for c in ("score", "spans", "ids", "fp", "digest", "node", "h", "tokens", "epochs", "content", "root", "whole", "K", "of"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


HARD = [
    (None, "null id"),
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c"),
    (4, "one"),
    (5, "same text twice in the table, as two rows"),
    (5, "same text twice in the table, as two rows"),
    (6, "word " * 60_000),
    (7, "x" * 70_000),
    (8, "Größe ñandú 漢字 😀   naïve\x85text", None, None),
    (9, "tie one two three four five", "xx", "odd source"),
    (10, "tie one two three four five", "", ""),
]


@pytest.fixture(scope="session")
def hard_docs(make_docs):
    return make_docs(HARD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
