import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Rows of documents with nulls, an empty and a very long text, repeats, and columns named as the operators' own."""
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema).withColumns(
            {c: F.lit(7) for c in ("score", "kept", "row", "digest", "key", "node", "component_id", "ids", "n", "host", "label_")})
    return make


@pytest.fixture
def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", "a", len(long)),
            (4, long, "en", "a", len(long)), (5, "one two", "de", None, 7), (None, "one two", "de", "b", 7), (None, None, None, None, None),
            (6, "one two", None, "b", 7), (7, "12345 67890", "fr", "b", 11)]
