import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table; `extra` columns have names that operators use inside."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)
        return df.withColumns({c: F.lit("x") for c in ("key", "sig", "shard", "k", "u", "v", "size", "g", "n_words")}) if extra else df

    return make
