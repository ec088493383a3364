import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, key long, row long, n long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) rows, with more columns whose names clash with the operators' own."""

    def run(rows, parts=3):
        full = [(i, t, "en" if k % 2 else None, "s", len(t or ""), "w", k, k, k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return run


WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in both columns, empty and wordless texts, repeated rows, ties, and a very long text."""
    long = " ".join(f"long{i % 4001}" for i in range(60_000))
    return [
        (1, " ".join(WORDS)), (2, " ".join(WORDS)), (2, " ".join(WORDS)), (3, None), (4, ""), (5, " \n\t "), (None, " ".join(WORDS)),
        (None, None), (6, "one two"), (7, "One TWO"), (8, "one two three"), (9, long), (10, long + " end"), (11, "é漢\x1c  x\n\n y "),
    ]
