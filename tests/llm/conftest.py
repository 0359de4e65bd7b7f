import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from `(doc_id, text)` or `(doc_id, text, lang, source)` rows, with columns of clashing names beside them."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        extra = {c: F.lit(1) for c in ("size", "key", "spans", "word", "node", "row", "n", "u", "v", "score", "part", "range")}
        return df.withColumns(extra)

    return make


@pytest.fixture(scope="session")
def texts(spark, folder):
    """Texts of the smallest documents by id."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}
