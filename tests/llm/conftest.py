import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
PLAIN = "The quick brown fox jumps over the lazy dog near the old river bank today."
LONG = " ".join(f"word{i % 977} and,more" for i in range(60_000)) + "."


def rows():
    texts = [(1, PLAIN), (2, PLAIN), (2, PLAIN), (3, None), (4, ""), (5, " \n\t "), (None, PLAIN), (None, None),
             (6, LONG), (7, PLAIN.upper()), (8, "one two"), (9, "Ünïcödé 漢字 \x1c x 😀 don't <|endoftext|>"), (3, "other")]
    return [(i, t, "en", [None, "b", "a", "é"][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated ids."""
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    import os

    import oracle
    return f"{oracle.BASE}/{os.environ.get('SF', 'sf0.001')}"
