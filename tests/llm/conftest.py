import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Extra columns whose names the operators use inside or add.
CLASH = ["key", "d", "s", "n", "m", "p", "score", "runs", "block", "cls", "label", "lang_pred", "h", "line", "pos", "__text"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None, sources=None, clash=False):
        n = len(texts)
        rows = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in zip(ids or range(n), texts, langs or ["en"] * n, sources or ["a"] * n)]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            from pyspark.sql import functions as F
            for c in CLASH:
                df = df.withColumn(c, F.lit(f"extra {c}"))
        return df
    return make
