import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # Columns whose names the operators use themselves.
    *(T.StructField(n, T.StringType()) for n in ("key", "row", "n", "score", "fp", "node", "count", "share", "size", "kept", "before", "label")),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text[, lang[, source]])."""
        return spark.createDataFrame([tuple(r) + (None,) * (len(SCHEMA) - len(r)) for r in rows], SCHEMA)

    return make


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(["an", "er", "th", "on", "in", "re", "éa", "ß"], k=r.randint(1, 4))) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """NULL, empty, blank, short and very long texts, repeated rows and copies."""
    long = prose(1, 6000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "word", "en", "b"), (5, "Two words", "fr", "b"), (6, long, "fr", "a"), (7, long, "fr", "b"), (8, long + " x", "fr", None)]
    rows += [(9, prose(2, 120), "en", "a")] * 2 + [(10 + i, prose(3, 150), "de", "c") for i in range(4)] + [(None, prose(4, 90), "en", "a"), (20, "x\x01y ퟿ 漢字 🎉 é", "en", "c")]
    return rows + [(30 + i, prose(100 + i, 60 + i), ("en", "fr", "de")[i % 3], ("a", "b", "c")[i % 3]) for i in range(12)]
