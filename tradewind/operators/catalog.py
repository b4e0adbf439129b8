"""Catalogue filters, joins, counts and the category tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import ancestor_paths
from .prefilter import may_hold

# ---- fixed values -------------------------------------------------------------------------
DEFAULT_MIN_PRICE, DEFAULT_MAX_PRICE = 0, 999999
# -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filters:
    """Inclusive bounds; None means no bound, and a set bound drops rows with a null value."""

    min_price: float | None = None
    max_price: float | None = None
    min_rating: float | None = None

    def apply(self, products: DataFrame) -> DataFrame:
        """Only bounds that are set become predicates, so they can reach the scan."""
        for cond in (
            None if self.min_price is None else F.col("price") >= F.lit(self.min_price),
            None if self.max_price is None else F.col("price") <= F.lit(self.max_price),
            None if self.min_rating is None else F.col("rating") >= F.lit(self.min_rating),
        ):
            if cond is not None:
                products = products.filter(cond)
        return products


NO_FILTERS = Filters()


def active_products(products: DataFrame) -> DataFrame:
    return products.filter(F.col("status") == "ACTIVE")


def products_by_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products whose id occurs in `ids`; unknown ids give nothing."""
    return products.join(ids.select("id"), "id", "left_semi")


def product_by_id(products: DataFrame, product_id: str) -> DataFrame:
    return products.filter(F.col("id") == product_id)


def product_by_sku(products: DataFrame, sku: str) -> DataFrame:
    return products.filter(F.col("sku") == sku)


def products_by_category_direct(products: DataFrame, category_id: str, filters: Filters = NO_FILTERS) -> DataFrame:
    return filters.apply(active_products(products).filter(F.col("category_id") == category_id)).orderBy("id")


def products_by_brand(products: DataFrame, brand: str) -> DataFrame:
    """Exact brand, any status."""
    return products.filter(F.col("brand") == brand)


def products_by_brand_filtered(products: DataFrame, brand: str, filters: Filters = NO_FILTERS) -> DataFrame:
    """Brand ignoring case, active only, cheapest first."""
    same = F.lower("brand") == brand.lower()
    return filters.apply(active_products(products).filter(same)).orderBy("price", "id")


def products_by_price_range(products: DataFrame, low: float | None = DEFAULT_MIN_PRICE,
                            high: float | None = DEFAULT_MAX_PRICE) -> DataFrame:
    """Active products within inclusive prices; None is no bound. The defaults are those of the service it follows."""
    if low is not None and high is not None and low > high:
        raise ValueError("minimum price is above maximum price")
    return Filters(min_price=low, max_price=high).apply(active_products(products)).filter(F.col("price").isNotNull())


def featured_products(products: DataFrame) -> DataFrame:
    return active_products(products).filter(F.col("featured"))


def in_stock() -> Column:
    return (F.coalesce(F.col("stock_quantity"), F.lit(0)) > 0) & (F.col("status") == "ACTIVE")


def valid_preferences(preferences: DataFrame) -> DataFrame:
    """Stored price preferences whose minimum is not above their maximum; an open end is valid."""
    lo, hi = F.col("min_price"), F.col("max_price")
    return preferences.filter(lo.isNull() | hi.isNull() | (lo <= hi))


def with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Add category_name and category_path; products without a category stay."""
    names = categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("path").alias("category_path"))
    return products.join(names, "category_id", "left")


def categories_by(categories: DataFrame, *, root: bool | None = None, parent_id: str | None = None,
                  level: int | None = None, path: str | None = None, path_prefix: str | None = None,
                  name: str | None = None, ignore_case: bool = False, active_only: bool = True) -> DataFrame:
    """Categories by any combination of criteria, in name order."""
    out = categories.filter("active") if active_only else categories
    if root:
        out = out.filter(F.col("parent_id").isNull())
    if parent_id is not None:
        out = out.filter(F.col("parent_id") == parent_id)
    if level is not None:
        out = out.filter(F.col("level") == level)
    if path is not None:
        out = out.filter(F.col("path") == path)
    if path_prefix is not None:
        out = out.filter(F.col("path").startswith(path_prefix))
    if name is not None:
        out = out.filter(F.lower("name") == name.lower() if ignore_case else F.col("name") == name)
    return out.orderBy("name")


def descendants(categories: DataFrame) -> DataFrame:
    """(ancestor_id, id, name): every category with itself and its active descendants.

    Each category names its own ancestors through the prefixes of its path, so this is an
    equi-join instead of a prefix comparison of all pairs.
    """
    lower = categories.filter("active").select(
        "id", "name", F.col("path").alias("_own"), F.explode(ancestor_paths(F.col("path"))).alias("path")
    ).filter(F.col("path") != F.col("_own"))
    upper = categories.filter(F.col("path").isNotNull()).select(F.col("id").alias("ancestor_id"), "path")
    below = lower.join(upper, "path").select("ancestor_id", "id", "name")
    return below.unionByName(categories.select(F.col("id").alias("ancestor_id"), "id", "name"))


def products_by_category(products: DataFrame, categories: DataFrame, category_id: str) -> DataFrame:
    """Active products of a category and everything below it, best rated first."""
    ids = descendants(categories).filter(F.col("ancestor_id") == category_id).select(F.col("id").alias("category_id"))
    return (active_products(products).join(ids, "category_id", "left_semi")
            .orderBy(F.col("rating").desc_nulls_last(), "id"))


def products_under(products: DataFrame, categories: DataFrame, root_names: list[str]) -> DataFrame:
    """Active products under the named categories, ignoring case; unknown names give nothing."""
    lowered = [n.lower() for n in root_names]
    roots = categories.filter(F.lower("name").isin(lowered)).select(F.col("id").alias("ancestor_id"))
    ids = descendants(categories).join(roots, "ancestor_id", "left_semi").select(F.col("id").alias("category_id"))
    return active_products(products).join(ids, "category_id", "left_semi")


def distinct_brands(products: DataFrame) -> DataFrame:
    return active_products(products).filter(F.col("brand").isNotNull()).select("brand").distinct().orderBy("brand")


def count_by_category(products: DataFrame) -> DataFrame:
    return active_products(products).groupBy("category_id").agg(F.count("*").alias("product_count"))


def count_in_category(products: DataFrame, category_id: str) -> DataFrame:
    return (active_products(products).filter(F.col("category_id") == category_id)
            .agg(F.count("*").alias("product_count")))


def rollup_counts(categories: DataFrame, products: DataFrame) -> DataFrame:
    """Products per active category including its active descendants.

    A category without a path, and one that is inactive, keeps its direct count.
    """
    direct = count_by_category(products)
    own = categories.join(direct.withColumnRenamed("category_id", "id"), "id", "left").select(
        "id", "name", "path", "active", F.coalesce("product_count", F.lit(0)).alias("_own"))
    deep = (
        descendants(categories).join(direct.withColumnRenamed("category_id", "id"), "id")
        .groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("product_count").alias("_deep"))
    )
    tree = F.col("active") & F.col("path").isNotNull()
    return own.join(deep, "id", "left").select(
        "id", "name", F.when(tree, F.coalesce("_deep", F.lit(0))).otherwise(F.col("_own")).alias("product_count"))


def category_tree(categories: DataFrame, products: DataFrame) -> DataFrame:
    """Active roots with one level of active children, each with its rolled-up product count."""
    counted = categories.filter("active").join(rollup_counts(categories, products).drop("name"), "id")
    children = counted.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("name", "product_count"))).alias("children"))
    roots = counted.filter(F.col("parent_id").isNull()).select("id", "name", "path", "product_count")
    empty = F.array().cast("array<struct<name:string,product_count:bigint>>")
    return (roots.join(children, "id", "left")
            .withColumn("children", F.coalesce("children", empty)).orderBy("name"))


def missing_skus(incoming: DataFrame, products: DataFrame) -> DataFrame:
    """Incoming rows whose SKU is not stored yet.

    Of the stored catalogue only SKUs that may be among the incoming ones are shuffled.
    """
    return incoming.join(may_hold(products.select("sku"), incoming, "sku"), "sku", "left_anti")


def rows_by_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose `column` occurs in the key table."""
    return rows.join(keys.select(column), column, "left_semi")


def exists_by(keys: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Each distinct key with whether any row holds it."""
    known = rows.select(column).distinct().withColumn("_hit", F.lit(True))
    return keys.select(column).distinct().join(known, column, "left").select(
        column, F.col("_hit").isNotNull().alias("found"))
