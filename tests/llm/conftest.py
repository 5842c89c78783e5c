import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven clever cats watch from the old stone wall near our house and think of dinner"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and clashing columns."""
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1),
        (3, PROSE + " tonight", "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0),
        (6, "  \n\t ", "fr", "b", 5), (None, "one lonely row without any id at all here", None, "b", 3),
        (7, "word", "de", "a", 4), (8, "WORD", "de", "a", 4), (9, " ".join(f"w{i}" for i in range(60_000)), "en", "c", 9),
        (10, "é" * 5000, "fr", "c", 9), (11, "a b c d e " * 50, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("n", "id", "kept", "spans", "size", "target", "token", "label", "x"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
