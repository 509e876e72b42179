import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table, with a clashing extra column, from (doc_id, text[, lang[, source]])."""

    def build(*rows):
        full = [(*r, *[None] * (5 - len(r)), 7) for r in rows]
        return spark.createDataFrame(full, T.StructType([*DOCUMENTS.fields, T.StructField("score", T.LongType())]))

    return build


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
