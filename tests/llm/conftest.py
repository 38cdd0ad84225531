import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, extra=("digest", "node", "token", "words", "size")):
        schema = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in extra)])
        return spark.createDataFrame([(i, t, None, "s", None, *("x" for _ in extra)) for i, t in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and long texts, repeated rows, a null identifier, ties."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "one two"), (7, long), (8, long + " end"), (9, "one"), (9, "one"),
            (None, "one two"), (10, "é ñ ß É 你好 🙂"), (11, "a" * 5000), (12, "\x00 \x7f ."), (13, "ha " * 400), (14, None)]
