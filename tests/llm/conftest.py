import random

import pytest
from pyspark.sql import types as T


@pytest.fixture
def make(spark):
    """documents of (doc_id, text) pairs, with a source and columns whose names clash with the operators' own."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("score", T.StringType()),
                           T.StructField("hash", T.StringType()), T.StructField("label", T.StringType())])

    def build(rows, source="s"):
        rows = [(*r, source) if len(r) == 2 else tuple(r) for r in rows]
        return spark.createDataFrame([(*r, "x", "y", None) for r in rows], schema).repartition(3)

    return build


@pytest.fixture
def rng():
    return random.Random(7)


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    return {r["doc_id"]: r for r in rows}
