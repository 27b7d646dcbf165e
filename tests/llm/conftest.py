import random

import pytest
from pyspark.sql import types as T

# extra columns carry names that the operators use inside
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("node", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("score", T.StringType()),
        T.StructField("edges", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs, with further columns of clashing names."""

    def build(rows):
        full = [(i, t, None if t is None else len(t), "x", "y", "z", "w") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, ties, words of many kinds."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["the", "a", "Über", "été", "naïve", "x.y", "don't", "A-B", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = text(80), text(30)
    near = base.split()
    near[40] = "changed"
    rows = [(i, text(rng.randrange(1, 60))) for i in range(10, 60)]
    rows += [(1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (6, " ".join(near)), (7, base + "\n"), (8, "one two three"), (9, "one two three")]
    rows += [(60, passage + " " + text(20)), (61, text(15) + "\n" + passage), (62, passage), (63, (passage + " ") * 3), (64, text(5000))]
    rows += [(65, "same same " * 40), (66, "same same " * 30), (67, base), (67, base), (68, "\x0b\x0c b\x0bc"), (None, base), (None, None), (100, text(40)), (200, base), (300, "")]
    rows += [(70, "The-END. " + base.upper()), (71, "<|endoftext|> x<|ENDOFTEXT|>y ### 's"), (72, base), (72, text(12))]
    return rows
