import pytest

INNER = ("_row", "_of", "_map", "_gone", "_id", "_d", "_r", "row", "doc", "near", "first", "_n", "_salt", "_hot", "item_id", "f0", "node", "label")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def build(rows, lang="en"):
        rows = [(d, t, lang, "s", len(t or ""), 1, 2, 3, "x", 5, *INNER) for d, t in rows]
        return spark.createDataFrame(rows, COLUMNS + ", a int, b int, pos int, component_id string, n int, " + ", ".join(f"{x} string" for x in INNER))

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties, repeated rows, texts of white space, a single very long word."""
    long = " ".join(f"word{i % 977} and{i % 13}." + ("\n" if i % 40 == 0 else "") for i in range(30_000))
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "one two three four five six seven"), (None, None)]
    rows += [(4, long), (5, long), (6, " \n\t "), (7, "x" * 50_000), (8, "é" * 300 + " 日本語 \U0001f642 ́"), (-9, "one two three four five six seven"), (2**62, "Z"), (2**53 + 1, "one two three four five six seven")]
    return make(rows)


@pytest.fixture(scope="session")
def none(make):
    return make([])
