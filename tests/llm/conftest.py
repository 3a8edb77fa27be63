"""Hard rows that every operator has to take."""

from __future__ import annotations

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, keep boolean, n int, length string, rank int, node string, "
    "hi string, lo string, plain string, piece string, copies int, kept string, group_id string, shard string, fold string, quality string, toxic string"
)
PROSE = "The river bends east below the old mill, and every spring the lower meadow floods for a week or two before the farmers can plough it again."


def row(doc_id, text) -> tuple:
    return (doc_id, text, None, None, None, *[None] * 17)


@pytest.fixture(scope="session")
def hard_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and copies."""
    long = " ".join(f"word{k % 977} of the long text number {k}" for k in range(30_000))
    return [
        row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "!!! ... ???"), row(5, PROSE), row(5, PROSE), row(6, PROSE), row(7, PROSE + " Truly."),
        row(8, "x"), row(None, PROSE), row(None, None), row(9, long), row(10, "naïve café — 日本語 текст 𝒳 don't we'll"), row(11, "a\x00b ퟿")]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    """With nulls in each column, repeated labels and labels of no document."""
    rows = [(5, 1, 0), (5, 1, 0), (4, 0, 0), (8, 0, 1), (9, 1, None), (10, None, 0), (None, 1, 0), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
