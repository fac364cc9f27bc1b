import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row_no long, kept boolean, words string, rule string"


def table(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names operators also use."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1.5, 7, 3, True, "w", "r") for r in rows], SCHEMA).repartition(3)


LONG = " ".join(f"word{i % 997} und{i % 13}" for i in range(150_000))
AWKWARD = [
    (0, None, "en", "a"),
    (1, "", None, "a"),
    (2, " \n\t ", "en", None),
    (None, "a text without an id but with some words of its own in it", "en", "b"),
    (4, LONG, "de", "b"),
    (5, "one two three", "en", "a"),
    (6, "one two three", "en", "a"),
    (6, "one two three", "en", "a"),
    (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich, \u4e2d\u6587 \U0001f600 <|endoftext|> x", None, None),
    (8, "same line here\nsame line here\n\nsame line here", "fr", "c"),
    (9, "released under the MIT License. " * 3, "en", "c"),
    (10, "one two three four five six seven eight nine ten eleven twelve", "en", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, rows)
