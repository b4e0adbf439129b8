"""The vector index as a table: datapoints, full overwrite and delta merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path

INDEX_SCHEMA = "id string, embedding array<float>, category_id string, brand string, price double, rating double"


def embedding_index(metadata: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Index rows: product metadata joined to embeddings by id, restrict values as plain columns."""
    return metadata.select("id", "category_id", "brand", F.col("price").cast("double").alias("price"),
                           F.col("rating").cast("double").alias("rating")).join(
        embeddings.select("id", "embedding"), "id").select("id", "embedding", "category_id", "brand", "price", "rating")


def datapoints(index: DataFrame) -> DataFrame:
    """(id, datapoint): JSON lines {id, embedding, restricts, numeric_restricts}; absent restricts left out."""
    def restrict(space: str, value: str):
        return F.when(F.col(value).isNotNull(), F.struct(
            F.lit(space).alias("namespace"), F.array(F.col(value)).alias("allow")))

    def numeric(space: str):
        return F.when(F.col(space).isNotNull(), F.struct(
            F.lit(space).alias("namespace"), F.col(space).cast("double").alias("value_double")))

    def some(*items):
        kept = F.array_compact(F.array(*items))
        return F.when(F.size(kept) > 0, kept)

    return index.select("id", F.to_json(F.struct(
        F.col("id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"),
        some(restrict("category_id", "category_id"), restrict("brand", "brand")).alias("restricts"),
        some(numeric("price"), numeric("rating")).alias("numeric_restricts"))).alias("datapoint"))


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Datapoints of `new` replace those with the same id; the others stay."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def write_index(spark: SparkSession, new: DataFrame, current: str | None, complete_overwrite: bool = False) -> str:
    """Write a new version of the index and return its path; the current one is never changed in place."""
    path = fresh_path(spark, "vector-index")
    if complete_overwrite or current is None:
        rows = new
    else:
        rows = merge_index(spark.read.schema(new.schema).parquet(current), new)
    rows.write.parquet(path)
    return path
