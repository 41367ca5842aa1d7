import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, fp long, level int"


def make_docs(spark, rows):
    """rows: (doc_id, text); with the other columns of documents, and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 0.5, 3, 2) for i, t in rows], SCHEMA)


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "One"),
    (5, "one"),
    (6, "two words"),
    (7, "ÀÉ Grüße ßtraße — naïve “quotes”   nbsp"),
    (8, "long " * 30_000 + "end"),
    (9, "LONG " * 30_000 + "END"),
    (9, "same id, another text"),
    (10, "same row"),
    (10, "same row"),
    (None, "no id"),
    (12, "x" * 5_000),
    (13, "a, b; c! 1 2 3 <|endoftext|> z"),
    (14, "12 345 ٣ Ⅷ ² ½"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return make_docs(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return make_docs(spark, []).limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
