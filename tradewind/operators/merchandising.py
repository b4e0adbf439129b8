"""Diverse product lists: trending, featured, best-of and top rated per category.

The small top-k is taken first (a distributed take-ordered); windows then run on at most
a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .catalog import active_products, featured_products, products_under
from .ranking import top_k

# ---- fixed values -------------------------------------------------------------------------
NO_CATEGORY = "Uncategorized"
ELECTRONICS, ELECTRONICS_BANDS = ["Electronics"], (5000, 30000)
FASHION, FASHION_BANDS = ["Clothing & Accessories", "Shoes & Handbags"], (1000, 5000)
# -------------------------------------------------------------------------------------------


def _rotate(picked: DataFrame, group: str, within: list[Column], position: str, size: int) -> DataFrame:
    """One row from each group in turn; groups in order of first position, rows by `within`."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*within))
    first = F.min(position).over(W.partitionBy(group))
    ranked = picked.withColumn("_turn", turn).withColumn("_first", first)
    return (
        ranked.orderBy("_turn", "_first").limit(size)
        .withColumn("rank", F.row_number().over(W.orderBy("_turn", "_first")))
        .drop("_turn", "_first", position)
    )


def _head(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """Top n rows numbered by position; None: all rows."""
    top = df if n is None else df.orderBy(*order).limit(n)
    return top.withColumn("_pos", F.row_number().over(W.orderBy(*order)))


def shuffled(seed: int) -> list[Column]:
    """A fixed shuffle of products: by the digest of id and seed."""
    return [F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), F.col("id")]


def trending(products: DataFrame, limit: int = 20, pool: int | None = -1) -> DataFrame:
    """Featured, then best rated, then most reviewed products, spread over categories.

    The list is drawn from the first `pool` products of that order: by default five times the limit, at most
    100, as the service it follows does; None draws from all.
    """
    order = [F.col("featured").desc_nulls_last(), F.col("rating").desc_nulls_last(),
             F.col("review_count").desc_nulls_last(), F.col("id").asc()]
    pool = min(limit * 5, 100) if pool == -1 else pool
    return _spread(active_products(products), order, None, limit, pool)


def featured_diverse(products: DataFrame, size: int = 10, seed: int = 42, pool: int | None = -1) -> DataFrame:
    """Featured products spread over categories, shuffled within each by a seed; `pool` as in `trending`."""
    pool = min(size * 5, 100) if pool == -1 else pool
    return _spread(featured_products(products), [F.col("id").asc()], shuffled(seed), size, pool)


def _spread(products: DataFrame, order: list[Column], within: list[Column] | None, size: int,
            pool: int | None) -> DataFrame:
    """`size` products of the pool, from each category in turn, in the order `within` (None: of the pool)."""
    named = products.withColumn("category_name", F.coalesce("category_name", F.lit(NO_CATEGORY)))
    if pool is not None:
        return _rotate(_head(named, order, pool), "category_name", within or [F.col("_pos")], "_pos", size)
    # Without a pool a category takes part with its first `size` products, and only the `size` categories whose
    # first product comes first can be reached; both cuts are made where the rows are.
    turns = top_k(named, ["category_name"], order if within is None else within, size, "_turn")
    heads = top_k(named, ["category_name"], order, 1, "_one").drop("_one")
    heads = _head(heads, order, size).select("category_name", F.col("_pos").alias("_first"))
    ranked = turns.join(F.broadcast(heads), "category_name").orderBy("_turn", "_first").limit(size)
    return ranked.withColumn("rank", F.row_number().over(W.orderBy("_turn", "_first"))).drop("_turn", "_first")


def best_of(products: DataFrame, categories: DataFrame, root_names: list[str], bands: tuple[float, float],
            page: int = 0, size: int = 20, seed: int = 42, pool: int | None = -1) -> DataFrame:
    """A page of the best rated products under some roots, alternating mid, premium and budget prices.

    Pages are cut from the `pool` best rated products: by default ten times the size, at most 200, as the service it
    follows does, so pages past that are empty; None pages through all of them.
    """
    order = [F.col("rating").desc_nulls_last(), F.col("id").asc()]
    under = products_under(products, categories, root_names)
    low, high = bands
    price = F.col("price").cast("double")
    band = F.when(price < low, 2).when(price <= high, 0).otherwise(1)
    pool = min(size * 10, 200) if pool == -1 else pool
    picked = (under if pool is None else under.orderBy(*order).limit(pool)).withColumn("band", band)
    last = (page + 1) * size  # of each band no more rows than a page ends with can come up
    ranked = top_k(picked, ["band"], shuffled(seed), last, "_turn")
    ranked = ranked.orderBy("_turn", "band").limit(last)
    ranked = ranked.withColumn("rank", F.row_number().over(W.orderBy("_turn", "band")))
    return ranked.filter(F.col("rank") > page * size).drop("_turn")


def top_rated_by_categories(products: DataFrame, names: list[str], low: float | None = None,
                            high: float | None = None, limit: int = 10) -> DataFrame:
    """Best rated active products of the named categories within a price range."""
    out = active_products(products).filter(F.col("category_name").isin(names))
    if low is not None:
        out = out.filter(F.col("price") >= low)
    if high is not None:
        out = out.filter(F.col("price") <= high)
    return out.orderBy(F.col("rating").desc_nulls_last(), F.col("review_count").desc_nulls_last(), "id").limit(limit)


def top_rated_per_category(products: DataFrame, n: int, group: list[str] | None = None) -> DataFrame:
    """Best n active products of every category at once."""
    w = W.partitionBy(*(group or ["category_name"])).orderBy(
        F.col("rating").desc_nulls_last(), F.col("review_count").desc_nulls_last(), F.col("id").asc())
    return active_products(products).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
