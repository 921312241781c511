import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns whose names an operator may use itself."""
    long = " ".join(f"word{i % 997} the of" for i in range(40_000))
    values = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 6),
        (4, "the same words stand here once more and then again today", "en", "a", None),
        (4, "the same words stand here once more and then again today", "en", "a", None),
        (4, "another text of this id with quite other words in every place of it", "en", "a", None),
        (None, "a text without an id has words too and keeps its row whole", "en", "a", 1),
        (5, long, "en", "a", len(long)),
        (6, "x" * 200_000, "de", "a", 200_000),
        (7, "naïve 漢字 🙂 ﬁn ▁ <|endoftext|> it's  two", "fr", "a", 1),
        (8, "1234 --- 5678", "fr", "a", 1),
        (9, "short", "es", "a", 1),
    ]
    frame = spark.createDataFrame(values, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("n_tokens", "text_key", "text_hash", "spans", "component_id", "row", "key", "place", "score", "rules", "cid"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]
