import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind string, key double, names string, size string, words string, named int, taken string, title string, ghost int, own string"


def words(n, seed):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(1, 9))) for _ in range(n))


LONG = words(60_000, 1) + " " + "x" * 50_000
PASSAGE = words(70, 2)
#: Null, empty, blank, short, equal, repeated, near, very long and odd texts; ids that tie or are missing; clashing columns.
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n ", None, "a"),
    (4, "one", "xx", ""),
    (5, "One", "en", "a"),
    (6, "two words", "en", "b"),
    (7, words(300, 3), "en", "a"),
    (8, words(300, 3), "de", "a"),
    (8, words(300, 3), "de", "a"),
    (9, words(299, 3) + " end", "en", "b"),
    (10, LONG, "fr", "a"),
    (11, words(40, 4) + " " + PASSAGE + " " + words(30, 5), "en", "b"),
    (12, words(10, 6) + "\n" + PASSAGE + "\nü€😀 " + words(10, 7), "en", None),
    (13, "é　è a b #$% line\nline\nline", "es", "a"),
    (14, "a b c d e " * 40, "en", "b"),
    (15, words(300, 3).upper(), "en", "a"),
    (None, words(50, 8), "en", "a"),
    (None, None, None, None),
    (-3, PASSAGE, "en", "a"),
    (2**62, PASSAGE + " tail", "en", "b"),
]


def table(spark, rows):
    return spark.createDataFrame([(d, t, g, s, len(t or ""), "x", "y", 1.0, None, "s", "w", 3, "t", "u", 7, "o") for d, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="session")
def known():
    """The rows that have an id of their own, as (id, text)."""
    return [(d, t) for d, t, _, _ in EDGES if d is not None and d != 8] + [(8, words(300, 3))]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
