import random

import pytest

from pyspark.sql import DataFrame


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


#: A text of every awkward kind: null, empty, blank, short, long, repeated words, copies, markup, several scripts.
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "two words",
    prose(1, 60),
    prose(1, 60),
    prose(1, 59) + " changed",
    prose(2, 30) + " " + prose(1, 60) + " " + prose(3, 30),
    "na " * 40 + "end",
    "na " * 25,
    "a b " * 30,
    prose(4, 25_000, 5_000),
    "x" * 30_000,
    "Ünïcödé ſtraße 漢字 кириллица   nbsp   sep, é ok. Don't <|endoftext|> stop...",
    "mail a.b@c.de now +1 (555) 123-4567 4111 1111 1111 1111 at 10.0.0.1.",
    "line one.\nline two,\r\nline three\x0bfour\x0cfive",
]

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, block int, rank double, label string"


@pytest.fixture(scope="session")
def awkward(spark) -> DataFrame:
    """Documents of every awkward kind, with null ids, a repeated row, null sources and columns that operators might use."""
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "a", "b", "ä"][i % 4], None if t is None else len(t), "clash", "clash", 7, 0.5, "clash") for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", "a", len(TEXTS[5]), None, None, None, None, None), (None, TEXTS[5], None, None, None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)
