"""Catalogue import: category tree from paths, product rows from a product file, import counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import catalog as C
from ..functions.arrays import ancestor_paths, category_path
from ..functions.text import clean_description, cut_within
from ..schemas import PATH_DELIMITER
from ..session import materialise
from .prefilter import may_hold

OUTCOMES = ("imported", "skipped", "errors")


def build_categories(paths: DataFrame) -> DataFrame:
    """One category per distinct path prefix of (line, path) rows.

    Categories come into being in the order (first line, depth). The first path to use a
    name keeps it; later ones become `name (parent)`, a later root `name #hash`. The id is
    the hash of the path, so rebuilding gives the same ids.
    """
    distinct = paths.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min("line").alias("line"))
    nodes = (
        distinct.select("line", F.explode(ancestor_paths(F.col("path"))).alias("path"))
        .groupBy("path").agg(F.min("line").alias("line"))
    )
    parts = F.split("path", r"\Q" + PATH_DELIMITER + r"\E")
    nodes = nodes.select(
        "path", (F.size(parts) - 1).alias("level"), F.element_at(parts, -1).alias("_raw"),
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), PATH_DELIMITER))
        .alias("parent_path"),
        F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).alias("_parent"),
        F.struct(F.col("line"), (F.size(parts) - 1).alias("depth")).alias("_born"))
    alternative = F.when(
        F.col("_parent").isNotNull(),
        F.substring(F.concat("_raw", F.lit(" ("), F.trim("_parent"), F.lit(")")), 1, 250)
    ).otherwise(F.concat("_raw", F.lit(" #"), F.pmod(F.hash("path"), F.lit(10000)).cast("string")))
    nodes = nodes.withColumn("_alt", alternative)

    # A name is taken from the moment any path claims it as its own last part, or a displaced path receives it
    # as its alternative. A path displaced that way gives its own alternative away in turn, so the displaced ones,
    # few as a rule, are found in rounds until no more follow.
    claims = nodes.groupBy(F.col("_raw").alias("_name")).agg(F.min("_born").alias("_claimed"))
    claimed = materialise(nodes.join(claims, F.col("_raw") == F.col("_name")).drop("_name"), "category-claims")
    moved, before = claimed.filter(F.col("_born") > F.col("_claimed")).select("path", "_alt", "_born"), -1
    while True:
        moved = materialise(moved, "displaced-categories")
        now = moved.count()
        if now == before:
            break
        before = now
        given = moved.groupBy(F.col("_alt").alias("_name")).agg(F.min("_born").alias("_given"))
        moved = claimed.join(given, F.col("_raw") == F.col("_name"), "left").filter(
            (F.col("_born") > F.col("_claimed")) | (F.col("_born") > F.col("_given"))).select("path", "_alt", "_born")
    named = claimed.join(moved.select("path", F.lit(True).alias("_moved")), "path", "left")
    displaced = F.coalesce("_moved", F.lit(False))
    return named.select(
        F.md5("path").alias("id"),
        F.when(displaced, F.col("_alt")).otherwise(F.col("_raw")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        "path", "level", F.md5("parent_path").alias("parent_id"), F.lit(True).alias("active"))


def import_products(rows: DataFrame, existing: DataFrame, seed: int = 42) -> DataFrame:
    """Product-file rows to catalogue rows, each with its import `outcome`.

    Outcomes: `imported`, `skipped` (invalid, SKU already stored, or repeated in the file,
    where the first line wins) and `errors` (unreadable line). Only imported rows carry products.
    """
    sku = F.trim("uniq_id")
    valid = C.valid_product(F.col("uniq_id"), F.col("product_name"), F.col("selling_price"))
    good = rows.filter(~F.col("is_error")).withColumn("sku", sku).withColumn("_valid", valid)
    # First line per SKU by aggregation, not by sorting all lines of a SKU.
    firsts = good.filter("_valid").groupBy("sku").agg(F.min("line_no").alias("_first"))
    # Only stored SKUs that may be in the file are shuffled.
    known = may_hold(existing.select("sku"), firsts, "sku").distinct().withColumn("_known", F.lit(True))
    tagged = good.join(firsts, "sku", "left").join(known, "sku", "left").withColumn(
        "outcome",
        F.when(~F.col("_valid") | F.col("_known").isNotNull() | (F.col("line_no") != F.col("_first")), "skipped")
        .otherwise("imported"))
    price = F.col("selling_price")
    status = C.parse_stock_status(F.col("stock_status"))
    rating = C.default_rating(F.col("star_ratings"), F.col("sku"), seed)
    imported = F.col("outcome") == "imported"
    path = category_path(F.col("primary_category_name"), F.col("sub_category_name"), PATH_DELIMITER)
    images = F.coalesce("image_urls", F.array().cast("array<string>"))
    cols = {
        "sku": F.col("sku"),
        "name": cut_within(F.trim("product_name"), 255),
        "description": cut_within(
            F.trim(clean_description(F.col("short_description"), F.col("long_description"))), 2000),
        "price": C.money(price),
        "compare_at_price": C.compare_at_price(F.col("list_price"), price),
        "currency": C.parse_currency(F.col("currency")),
        "brand": cut_within(F.trim("brand_name"), 100),
        "gender": C.parse_gender(F.col("gender")),
        "category_path": path, "category_id": F.md5(path),
        "image_urls": images, "thumbnail_url": F.get(images, F.lit(0)),
        "rating": rating,
        "review_count": C.default_reviews(F.col("reviews_count"), rating, F.col("sku"), seed),
        "status": status,
        "stock_quantity": C.default_stock(status, F.col("sku"), seed),
        "featured": F.coalesce(F.col("product_rank") <= 50, F.lit(False)),
    }
    done = tagged.select("line_no", "outcome", *[F.when(imported, v).alias(k) for k, v in cols.items()])
    failed = rows.filter("is_error").select(
        "line_no", F.lit("errors").alias("outcome"),
        *[F.lit(None).cast(done.schema[k].dataType).alias(k) for k in cols])
    return done.unionByName(failed)


def import_stats(imported: DataFrame) -> DataFrame:
    """Rows per import outcome."""
    return imported.groupBy("outcome").agg(F.count("*").alias("rows"))


def observed_import(imported: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and rows per outcome counted while they are written: no second scan.

    The observation has its numbers once the first action on the rows has run.
    """
    counts = Observation()
    return imported.observe(counts, *[
        F.count(F.when(F.col("outcome") == outcome, True)).alias(outcome) for outcome in OUTCOMES]), counts


def observed_stats(spark: SparkSession, counts: Observation) -> DataFrame:
    """Rows per outcome of an observed import, outcomes without a row left out."""
    return spark.createDataFrame([(k, n) for k, n in counts.get.items() if n], "outcome string, rows long")
