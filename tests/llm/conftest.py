import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

PLAIN = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near a river "
    "and every child in the small village hears how the wind carries songs across the fields until evening comes "
    "with a cool breeze that lets the farmers rest after long days of work on their land"
)


@pytest.fixture
def documents(spark):
    """Rows with every awkward case: nulls in each column, empty and long texts, repeated rows, missing ids."""

    def make(rows=None, extra=False):
        if rows is None:
            rows = [
                (1, PLAIN, "en", "a", len(PLAIN)),
                (2, PLAIN, "en", "a", len(PLAIN)),
                (2, PLAIN, "en", "a", len(PLAIN)),
                (3, "", "en", "b", 0),
                (4, None, None, None, None),
                (5, "1234 5678 !!!", None, "b", 13),
                (None, PLAIN + " more words", "en", None, None),
                (6, "x " * 60_000, "en", "b", 120_000),
                (7, "  two  blanks <|endoftext|> and\ttabs\n\n \n", "en", "b", 40),
                (8, "日本語のテキスト 😀 é", "ja", "c", 12),
            ]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "node", "n_tokens", "kept", "class_id", "length", "fingerprint", "_text", "part"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
