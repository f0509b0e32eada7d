"""Fixtures of these tests."""

import pytest
from pyspark.sql.types import LongType, StringType, StructType

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like rows from (doc_id, text) with extra columns whose names clash with outputs."""

    def make(rows):
        schema = StructType().add("doc_id", LongType()).add("text", StringType()).add("lang", StringType()).add("source", StringType()).add("n_chars", LongType())
        for extra in ("score", "row", "id", "n_words", "found", "kept", "k", "l", "t", "y"):
            schema = schema.add(extra, StringType())
        full = [(i, t, "en", None, None if t is None else len(t), *["x"] * 10) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
