import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text[, source]) rows."""

    def make(*rows):
        full = [(i, r, "en", "src0", len(r or "")) if r is None or isinstance(r, str) else (r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clashing(docs):
    """Documents with every column of which an operator might think as its own."""

    def make(*rows):
        df = docs(*rows)
        for name in ("_id", "keep_id", "digest", "batch", "shard", "block", "quota", "weight", "hi", "lo", "key", "id", "root", "gone", "rows", "toxic", "_score", "tokens", "hash", "position", "evidence", "_n", "_s", "_o"):
            df = df.withColumn(name, df.doc_id)
        return df

    return make


EMPTY = T.StructType([])
