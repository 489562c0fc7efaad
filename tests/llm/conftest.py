import random

import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("id", "key", "keep_id", "text_sha256", "start", "length", "spans", "bucket", "owners", "component", "component_id", "line", "line_id", "class_id", "score", "salt", "tier", "n", "rows", "same", "shared", "passed", "random")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with extra columns whose names clash."""

    def documents(texts, ids=None):
        rows = [(i, t, None, "s", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        df = spark.createDataFrame(rows, DOCUMENT)
        return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3, "doc_id")

    return documents


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    made = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return lambda seed, n: [random.Random(seed * 1000 + i).choice(made) for i in range(n)]


@pytest.fixture(scope="session")
def odd_texts(words):
    """Nulls, empty texts, ties, repeats, odd white space and a very long text."""
    a = " ".join(words(1, 60))
    return [None, "", " \n\t ", a, a, a.replace(" ", "\n", 3), a.upper(), a + " more", "one two", "one two", "One\x0b two", " ".join(words(2, 30_000)), "É é ß 漢字 😀", "x"]
