import pytest

# Rows that every operator has to take: null id, null, empty and blank texts,
# a text of one long word, a long text, repeated rows, an id with two texts.
LONG = " ".join(f"word{k % 997} of line{k}" for k in range(9000))
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (None, "no id at all here", "en", "a"),
       (4, "x" * 5000, "de", "b"), (5, LONG, "en", "b"), (6, "twice the same row", "en", "a"),
       (6, "twice the same row", "en", "a"), (7, "one id", "en", "a"), (7, "two texts", "fr", "a"),
       (8, "tabs\tand\x0bfeeds\x0cand\x1cseparators  é́ <|endoftext|>x", "fr", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names operators use inside or return."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    for name in ("key", "kept", "n_tokens", "blob_id", "rep", "component", "score", "row"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
