import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from ``(doc_id, text, lang, source)`` rows, with extra columns whose names
    the operators use inside."""

    def make(rows, extra=False):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s0")), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            names = ["rid", "key", "fp", "digest", "spans", "base", "score", "__rid", "row", "ids"]
            df = df.selectExpr("*", *[f"'x' as `{n}`" for n in names])
        return df

    return make


ODD_ROWS = [
    (1, "One text with some words in it and more words after that."),
    (2, None),
    (3, ""),
    (None, "A row without an id has words as well, five or more."),
    (5, "One text with some words in it and more words after that."),
    (5, "One text with some words in it and more words after that."),
    (7, "\t \n "),
    (8, "Größe ßtraße 漢字 😀 ünï " * 40),
    (9, "long " * 60_000),
    (10, "x" * 50_000),
]


@pytest.fixture
def odd_rows():
    return ODD_ROWS
