import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows and ids, and further columns with clashing names."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ta", "ro", "ni", "sel", "mu"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", "a", 6), (None, base, "en", "b", 5),
            (None, base, "en", "b", 5), (5, base, "en", "b", 5), (5, base, "en", "b", 5), (6, "one two", None, "b", 7),
            (7, "one two", "fr", "c", 7), (8, prose(60_000), "en", "c", 9), (9, base + " tail", "en", None, 1),
            (10, prose(40) + "\n" + "x" * 50 + "\n\n" + "é" * 45, "en", "a", 3), (11, "ßü é 漢字 \U0001f600", "de", "a", 4)]
    rows += [(100 + i, prose(rnd.randint(25, 90)), rnd.choice(["en", "fr", None]), rnd.choice("abc"), i) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "key", "node", "line", "item", "block", "words", "score", "_hash", "held_out", "y", "weight", "n_lines"):
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
