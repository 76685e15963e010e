import random

import pytest

SF = "/root/testdata/sf0.001"
# names that the operators use inside themselves
CLASHING = "key string, words string, text_hash int, fp string, bucket string, score string, n long, label string, target int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def row(key, text, source="s"):
    return (key, text, "en", source, len(text or ""), "k", "w", 1, "f", "b", "s", 2, "l", 3)


@pytest.fixture(scope="session")
def sample(spark):
    """The 200 documents of the smallest table and odd rows, with clashing columns."""
    rows = [row(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(1)
    odd = [
        row(1000, None),
        row(1001, ""),
        row(1002, " \t\n--- "),
        row(1003, "same text twice", None),
        row(1003, "same text twice", None),
        row(1004, "same text twice"),
        row(None, "a document without a key"),
        row(None, None, None),
        row(1005, "É École\x00nul Straße 東京 \U0001f600 end"),
        row(1006, " ".join(rng.choice(["the", "of", "mit", "cc", "by", "nc", "license", "under"]) for _ in range(60000))),
        row(1007, "Under THE MIT-license. under the mit license cc by nc cc by nc sa"),
        row(-5, "word"),
    ]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(sample):
    return [(r["doc_id"], r["text"], r["source"]) for r in sample.collect()]
