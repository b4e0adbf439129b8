"""Product file to catalogue rows and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.importing import build_categories, import_products
from ..sources.product_files import read_product_file


def run_import(spark: SparkSession, path: str, existing: DataFrame, offset: int = 0, limit: int = 0,
               seed: int = 42) -> DataFrame:
    """All lines of a product file with their outcome; `imported` rows are catalogue rows."""
    return import_products(read_product_file(spark, path, offset, limit), existing, seed)


def categories_of(imported: DataFrame) -> DataFrame:
    """Category tree of imported rows, in order of first use."""
    rows = imported.filter("outcome = 'imported'")
    return build_categories(rows.select(F.col("line_no").alias("line"), F.col("category_path").alias("path")))
