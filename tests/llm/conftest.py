import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text[, lang[, source]]) rows, with columns that clash with the operators' own names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).selectExpr("*", "1 as bucket", "'x' as score", "2 as k1", "3 as node", "4 as band", "5 as a", "6 as path")

    return make
