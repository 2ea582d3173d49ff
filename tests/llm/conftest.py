import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ["score", "node", "tile", "shard", "slot", "start", "hashes", "_node", "group", "media", "_raw", "_parts", "anchors", "gaps", "key", "spread", "rank", "weight", "n_words", "n_features", "ids", "x", "value", "cell"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 5),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 5),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 5),
        (3, None, None, None, None),
        (4, "", "de", "a", 0),
        (5, " \t\n ", "de", "a", 4),
        (None, "une phrase sans numéro, écrite à la main", "fr", "a", 40),
        (None, "une phrase sans numéro, écrite à la main", "fr", "a", 40),
        (6, "word " * 30_000, "en", "hot", 150_000),
        (7, "x" * 70_000, "en", "hot", 70_000),
        (8, "naïve 漢字 🙂 <|endoftext|> it's 12.5%\r\n  two  spaces\x1c!", "fr", "a", 50),
        (9, "one two", "en", "a", 7),
        (9, "another text under the same id", "en", "a", 30),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """Real documents: the smallest tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df, *columns):
    """All rows, sorted; nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
