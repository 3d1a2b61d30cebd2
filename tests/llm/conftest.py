import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that helpers of some operator might use.
EXTRA = ("__id", "__key", "fp", "u", "v", "a", "b", "size", "hash", "key", "id", "t", "s", "copies", "root", "slice")

EDGES = [
    (None, None, None, None, None),
    (None, "", None, None, 0),
    (1, "", "en", "s1", 0),
    (2, None, None, "s1", None),
    (3, " \t\n ", "en", None, 4),
    (4, "one", "en", "s2", 3),
    (5, "one two", "de", "s2", 7),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "s2", 66),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "s2", 66),
    (7, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "s3", 66),
    (7, "another text under the same id", "en", "s3", 30),
    (8, LONG, "en", "s3", len(LONG)),
    (9, "ÄÖÜ ñandú 12 !!!   x", None, "s4", 20),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edges):
    """`edges` with columns whose names operators might use themselves."""
    return edges.selectExpr("*", *[f"'x' as `{c}`" for c in EXTRA])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
