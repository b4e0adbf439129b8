"""Product files (one JSON object per line) and the embedding exchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.arrays import not_blank
from ..functions.text import embedding_text
from ..operators.catalog import active_products
from ..schemas import PRODUCT_FILE


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines numbered from 0 over all files in name order, without a global sort.

    Lines of a file split are read by one task in order. Splits are counted (one small row each), and starts are
    added up, of splits within their file and of files in the order of names; only the latter is one window, of a
    row per file. Every line takes its place within its split.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    of_file = W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    of_all = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_lines")).withColumn(
        "_before", F.coalesce(F.sum("_lines").over(of_all), F.lit(0)))
    splits = splits.withColumn("_within", F.coalesce(F.sum("_n").over(of_file), F.lit(0))).join(files, "_file")
    starts = splits.select("_file", "_at", "_low", (F.col("_before") + F.col("_within")).alias("_start"))
    return lines.join(starts, ["_file", "_at"]).select(
        (F.col("_start") + F.col("_id") - F.col("_low")).alias("line_no"), "value")


def read_product_file(spark: SparkSession, path: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """Parsed product lines with line_no, is_error and the raw line of errors.

    `offset` lines are skipped and then `limit` lines read (0 = all); blank lines count
    against the limit but give no row. Unknown fields are ignored; unreadable lines come
    back with is_error, so they can be counted and kept.
    """
    lines = numbered_lines(spark, path)
    if offset:
        lines = lines.filter(F.col("line_no") >= offset)
    if limit:
        lines = lines.filter(F.col("line_no") < offset + limit)
    schema = T.StructType([*PRODUCT_FILE.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.filter(F.trim("value") != "").withColumn(
        "p", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull()
    return parsed.select(
        "line_no", bad.alias("is_error"), F.when(bad, F.col("value")).alias("raw"),
        *[F.when(~bad, F.col(f"p.{f.name}")).alias(f.name) for f in PRODUCT_FILE])


def embedding_input(products: DataFrame) -> DataFrame:
    """(id, content, metadata) JSON lines for the embedding model, active products with category_name.

    Absent fields are left out of the metadata; brands are lower-cased. The id stays beside both
    lines so results are joined by id, never by line position.
    """
    text = embedding_text(F.col("name"), F.col("description"), F.col("brand"), F.col("category_name"))
    meta = F.to_json(F.struct(
        F.col("id"), F.col("category_id").alias("categoryId"),
        F.when(not_blank(F.col("brand")), F.lower("brand")).alias("brand"),
        F.col("price").cast("double").alias("price"), F.col("rating").cast("double").alias("rating")))
    return active_products(products).select(
        "id", F.to_json(F.struct(F.col("id"), text.alias("content"))).alias("content"), meta.alias("metadata"))


def write_embedding_input(products: DataFrame, content_path: str, metadata_path: str) -> None:
    lines = embedding_input(products)
    lines.select("content").write.mode("overwrite").text(content_path)
    lines.select("metadata").write.mode("overwrite").text(metadata_path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, categoryId string, brand string, price double, rating double"
    return spark.read.schema(schema).json(path).withColumnRenamed("categoryId", "category_id")


def parse_embeddings(lines: DataFrame) -> DataFrame:
    """(id, embedding) from prediction lines in column `value`; lines without values are dropped."""
    schema = ("instance struct<id:string>, predictions array<struct<embeddings:struct<values:array<float>>>>")
    values = F.get(F.col("r.predictions"), F.lit(0))["embeddings"]["values"]
    return (lines.select(F.from_json("value", schema).alias("r"))
            .select(F.col("r.instance.id").alias("id"), values.alias("embedding"))
            .filter(F.col("embedding").isNotNull()))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return parse_embeddings(spark.read.text(path))
