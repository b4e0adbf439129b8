"""Activity aggregates over timed events.

Each aggregate first reduces the events by a finer key, with map-side combination, and
only then by its own key; a hot user or session therefore reaches the last shuffle as a
few partial rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import default_blank, sorted_field
from .collecting import distinct_values, first_rows, first_values, last_value

ORDER = ["event_time", "event_id"]
SESSION = ["user_id", "session_id"]


def _distinct_by_first(order: str, value: str, newest: bool = False) -> Column:
    """Distinct values of pre-aggregated rows, ordered by their first (newest: last) occurrence; unbounded by definition."""
    pairs = F.collect_list(F.when(F.col(value).isNotNull() & F.col(order).isNotNull(), F.struct(order, value)))
    values = sorted_field(pairs, value)
    return F.reverse(F.array_distinct(F.reverse(values))) if newest else F.array_distinct(values)


# ---- parts: what is kept of events between the finer and the final key; parts of several batches merge ------------

#: How the columns of parts merge; columns that are not listed are keys.
MERGE = {"_o": F.min, "_added": F.min, "_device": F.min, "_first": F.min, "_min": F.min, "_max": F.max, "_last": F.max,
         "_total": F.max, "_items": F.max, "_budget": F.max,
         **{c: F.sum for c in ("_n", "_price", "_prices", "_ms", "_mss", "_adds", "_removes", "_views", "_lo", "_los", "_hi",
                               "_his", "_search", "_details", "_compare", "_results")}}
#: First values are parts of their own: (keys, value, how many).
FIRSTS = {"view_products": (SESSION, "product_id", 10), "ai_queries": (["user_id"], "query", 10)}


PART_TABLES = ["views", "view_products", "carts", "pages", "ai", "ai_queries", "orders", "order_categories", "order_products"]


def merge_parts(name: str, parts: DataFrame) -> DataFrame:
    """One row per key from the united parts of several batches."""
    if name in FIRSTS:
        keys, value, n = FIRSTS[name]
        return first_rows(parts, keys, value, ORDER, n)
    keys = [c for c in parts.columns if c not in MERGE]
    return parts.groupBy(*keys).agg(*[MERGE[c](c).alias(c) for c in parts.columns if c in MERGE])


def view_parts(views: DataFrame, keep: str = "first") -> DataFrame:
    return views.groupBy(*SESSION, "category", "search_query").agg(
        (F.max if keep == "last" else F.min)(F.struct(*ORDER)).alias("_o"),
        F.count("*").alias("_n"),
        F.sum("price").alias("_price"), F.count("price").alias("_prices"),
        F.max("price").alias("_max"), F.min("price").alias("_min"),
        F.sum("view_duration_ms").alias("_ms"), F.count("view_duration_ms").alias("_mss"),
        F.max("event_time").alias("_last"),
    )


def cart_parts(carts: DataFrame) -> DataFrame:
    return carts.groupBy(*SESSION, "product_id", "category").agg(
        F.min(F.when(F.col("action") == "ADD", F.struct(*ORDER))).alias("_added"),
        F.count_if(F.col("action") == "ADD").alias("_adds"),
        F.count_if(F.col("action") == "REMOVE").alias("_removes"),
        F.max(F.when(F.col("cart_total").isNotNull(), F.struct(*ORDER, "cart_total"))).alias("_total"),
        F.max(F.when(F.col("cart_item_count").isNotNull(), F.struct(*ORDER, "cart_item_count"))).alias("_items"),
        F.max("event_time").alias("_last"),
    )


def page_parts(events: DataFrame) -> DataFrame:
    return events.groupBy(*SESSION, "page_type").agg(
        F.min(F.when(F.col("device_type").isNotNull(), F.struct(*ORDER, "device_type"))).alias("_device"),
        F.count("*").alias("_n"), F.count_if(F.col("event_type") == "PAGE_VIEW").alias("_views"),
        F.min("event_time").alias("_first"), F.max("event_time").alias("_last"))


def ai_parts(events: DataFrame, keep: str = "first") -> DataFrame:
    return events.groupBy("user_id", "category").agg(
        (F.max if keep == "last" else F.min)(F.struct(*ORDER)).alias("_o"), F.count("*").alias("_n"),
        F.sum("min_price").alias("_lo"), F.count("min_price").alias("_los"),
        F.sum("max_price").alias("_hi"), F.count("max_price").alias("_his"),
        F.max("max_price").alias("_budget"),
        F.count_if(F.col("tool_name") == "searchProducts").alias("_search"),
        F.count_if(F.col("tool_name") == "getProductDetails").alias("_details"),
        F.count_if(F.col("tool_name") == "compareProducts").alias("_compare"),
        F.sum("results_count").alias("_results"), F.max("event_time").alias("_last"),
    )


def order_parts(items: DataFrame) -> DataFrame:
    """Amounts are the same on every line of an event, so lines are counted per event, which their own task does."""
    return items.groupBy("user_id", "event_id", "order_id", "event_time", "total", "discount", "payment_method",
                         "status").agg(F.count("*").alias("_n"))


def item_parts(items: DataFrame, value: str, keep: str = "first") -> DataFrame:
    """Distinct categories or products of a user's order lines with their first (or last) place."""
    pick = F.max if keep == "last" else F.min
    return items.filter(F.col(value).isNotNull()).groupBy("user_id", value).agg(
        pick(F.struct(*ORDER, "item_pos")).alias("_o"))


def activity_parts(views: DataFrame, carts: DataFrame, users: DataFrame, ai: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Everything that profiles need of timed events and flattened order lines."""
    return {
        "views": view_parts(views), "view_products": first_rows(views, *FIRSTS["view_products"][:2], ORDER, 10),
        "carts": cart_parts(carts), "pages": page_parts(users), "ai": ai_parts(ai),
        "ai_queries": first_rows(ai, *FIRSTS["ai_queries"][:2], ORDER, 10), "orders": order_parts(items),
        "order_categories": item_parts(items, "category"), "order_products": item_parts(items, "product_id")}


def activities_of(parts: dict[str, DataFrame]) -> list[DataFrame]:
    """The five activity aggregates from their parts."""
    return [product_of(parts["views"], parts["view_products"]), cart_of(parts["carts"]), session_of(parts["pages"]),
            ai_of(parts["ai"], parts["ai_queries"]),
            order_of(parts["orders"], parts["order_categories"], parts["order_products"])]


# ---- aggregates -------------------------------------------------------------------------------------------------

def product_activity(views: DataFrame, keep: str = "first", products: int | None = 10,
                     categories: int | None = 5) -> DataFrame:
    """Per (user, session): viewed products, categories, queries, durations and prices.

    `keep='first'` retains the earliest `products` and `categories` of the session,
    `keep='last'` the latest; None retains all.
    """
    return product_of(view_parts(views, keep), views, keep, products, categories)


def product_of(parts: DataFrame, views: DataFrame, keep: str = "first", products: int | None = 10,
               categories: int | None = 5) -> DataFrame:
    main = parts.groupBy(*SESSION).agg(
        default_blank(_distinct_by_first("_o", "search_query", keep == "last")).alias("recent_search_queries"),
        F.sum("_n").alias("total_product_views"),
        F.expr("coalesce(sum(_ms) div nullif(sum(_mss), 0), 0)").alias("avg_view_duration_ms"),
        F.expr("coalesce(sum(_price) / nullif(sum(_prices), 0), 0.0D)").alias("avg_product_price"),
        F.coalesce(F.max("_max"), F.lit(0.0)).alias("max_viewed_price"),
        F.coalesce(F.min("_min"), F.lit(0.0)).alias("min_viewed_price"),
        F.max("_last").alias("last_event_time"),
    )
    seen_products = first_values(views, SESSION, "product_id", ORDER, products, "_products", keep)
    seen_categories = distinct_values(parts, SESSION, "category", ["_o"], "_categories", categories, keep)
    return main.join(seen_products, SESSION, "left").join(seen_categories, SESSION, "left").select(
        *SESSION, default_blank(F.col("_products")).alias("recent_product_ids"),
        default_blank(F.col("_categories")).alias("recent_categories"), "recent_search_queries", "total_product_views",
        "avg_view_duration_ms", "avg_product_price", "max_viewed_price", "min_viewed_price", "last_event_time")


def cart_activity(carts: DataFrame) -> DataFrame:
    """Per (user, session): latest cart state, add and remove counts, distinct added products and categories."""
    return cart_of(cart_parts(carts))


def cart_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*SESSION).agg(
        F.coalesce(F.max("_total")["cart_total"], F.lit(0.0)).alias("current_cart_total"),
        F.coalesce(F.max("_items")["cart_item_count"].cast("bigint"), F.lit(0)).alias("current_cart_items"),
        F.sum("_adds").alias("cart_adds"),
        F.sum("_removes").alias("cart_removes"),
        default_blank(_distinct_by_first("_added", "product_id")).alias("cart_product_ids"),
        default_blank(_distinct_by_first("_added", "category")).alias("cart_categories"),
        F.max("_last").alias("last_event_time"),
    )


def session_activity(events: DataFrame) -> DataFrame:
    """Per (user, session): device, page counts and duration. Every event counts as a page view."""
    return session_of(page_parts(events))


def session_of(parts: DataFrame) -> DataFrame:
    def pages(kind: str) -> Column:
        return F.sum(F.when(F.col("page_type") == kind, F.col("_views")).otherwise(0))
    return parts.groupBy(*SESSION).agg(
        F.coalesce(F.min("_device")["device_type"], F.lit("UNKNOWN")).alias("device_type"),
        F.sum("_n").alias("total_page_views"),
        F.count("page_type").alias("unique_page_types"),
        pages("PRODUCT").alias("product_page_views"),
        pages("CART").alias("cart_page_views"),
        pages("CHECKOUT").alias("checkout_page_views"),
        F.expr("coalesce(timestampdiff(SECOND, min(_first), max(_last)) * 1000, 0L)").alias("session_duration_ms"),
        F.max("_last").alias("last_event_time"),
    )


def ai_activity(events: DataFrame, keep: str = "first", queries: int | None = 10,
                categories: int | None = 5) -> DataFrame:
    """Per user: assistant searches, their queries, categories, price bounds and tool use.

    The first (or last) `queries` and `categories` are kept, None keeps all. A bound of 0.0 means "none given" and
    still enters the averages.
    """
    return ai_of(ai_parts(events, keep), events, keep, queries, categories)


def ai_of(parts: DataFrame, events: DataFrame, keep: str = "first", queries: int | None = 10,
          categories: int | None = 5) -> DataFrame:
    main = parts.groupBy("user_id").agg(
        F.sum("_n").alias("ai_search_count"),
        F.expr("coalesce(sum(_lo) / nullif(sum(_los), 0), 0.0D)").alias("ai_avg_min_price"),
        F.expr("coalesce(sum(_hi) / nullif(sum(_his), 0), 0.0D)").alias("ai_avg_max_price"),
        F.coalesce(F.max("_budget"), F.lit(0.0)).alias("ai_max_budget"),
        F.sum("_search").alias("ai_product_searches"),
        F.sum("_details").alias("ai_product_detail_views"),
        F.sum("_compare").alias("ai_product_comparisons"),
        F.coalesce(F.sum("_results"), F.lit(0)).alias("ai_total_results_shown"),
        F.max("_last").alias("last_event_time"),
    )
    asked = first_values(events, ["user_id"], "query", ORDER, queries, "_queries", keep)
    about = distinct_values(parts, ["user_id"], "category", ["_o"], "_categories", categories, keep)
    return main.join(asked, "user_id", "left").join(about, "user_id", "left").select(
        "user_id", "ai_search_count", default_blank(F.col("_queries")).alias("ai_search_queries"),
        default_blank(F.col("_categories")).alias("ai_search_categories"),
        *[c for c in main.columns if c not in ("user_id", "ai_search_count")])


def order_activity(items: DataFrame, keep: str = "first", per_order: bool = False, categories: int | None = 10,
                   products: int | None = 20) -> DataFrame:
    """Per user over flattened order lines; of categories and products the first (or last) so many are kept, None: all.

    Amounts repeat on every line, so spend is weighted by line count (the published
    behaviour). `per_order=True` counts every order event once instead.
    """
    parts = order_parts(items)
    if per_order:
        parts = parts.withColumn("_n", F.lit(1).cast("bigint"))
    return order_of(parts, item_parts(items, "category", keep), item_parts(items, "product_id", keep), keep, categories,
                    products)


def order_of(parts: DataFrame, item_categories: DataFrame, item_products: DataFrame, keep: str = "first",
             categories: int | None = 10, products: int | None = 20) -> DataFrame:
    main = parts.groupBy("user_id").agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.coalesce(F.sum(F.col("total") * F.col("_n")), F.lit(0.0)).alias("total_spent"),
        F.expr("coalesce(sum(total * _n) / nullif(sum(if(total IS NOT NULL, _n, 0)), 0), 0.0D)").alias("avg_order_value"),
        F.coalesce(F.sum(F.col("discount") * F.col("_n")), F.lit(0.0)).alias("total_discount"),
        F.coalesce(last_value("total", ORDER), F.lit(0.0)).alias("last_order_total"),
        F.coalesce(last_value("payment_method", ORDER), F.lit("UNKNOWN")).alias("preferred_payment_method"),
        F.coalesce(last_value("status", ORDER), F.lit("UNKNOWN")).alias("last_order_status"),
        F.max("event_time").alias("last_event_time"),
    )
    kinds = distinct_values(item_categories, ["user_id"], "category", ["_o"], "_categories", categories, keep)
    bought = distinct_values(item_products, ["user_id"], "product_id", ["_o"], "_products", products, keep)
    return main.join(kinds, "user_id", "left").join(bought, "user_id", "left").select(
        "user_id", "total_orders", "total_spent", "avg_order_value", "total_discount", "last_order_total",
        default_blank(F.col("_categories")).alias("purchased_categories"),
        default_blank(F.col("_products")).alias("purchased_product_ids"),
        "preferred_payment_method", "last_order_status", "last_event_time")
