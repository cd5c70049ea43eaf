import random

import pytest
from pyspark.sql import types as T

#: documents, with columns whose names clash with those that operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("h", "sha", "kept", "row", "word", "score", "spans", "a b")),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), *["x"] * 8) for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "on", "er", "re", "an", "ti", "sh", "é", "ou"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def rows():
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    base = prose(1, 120)
    out = [(i, prose(100 + i, 10 + 7 * i)) for i in range(20)]
    out += [(30, None), (31, ""), (32, None), (33, " \t\n"), (34, base), (35, base), (36, base + " more"), (37, base), (37, base), (None, base), (None, None)]
    out += [(40, prose(7, 20000)), (41, "a" * 60000), (42, "1 2 3 " * 3000), (43, "x\n\nx\ny\nx\n"), (44, "0123456789" * 2000)]
    out += [(50, "<|endoftext|> Ünï côde \U0001f600 ſK İ\x85\xa0z"), (-7, "neg ative id " * 9)]
    return out


@pytest.fixture(scope="session")
def corpus(spark):
    return frame(spark, rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
