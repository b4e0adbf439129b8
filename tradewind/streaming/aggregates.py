"""Native streaming aggregates: update-mode counts, and keyed state with expiry."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def running_session_counts(events: DataFrame) -> DataFrame:
    """Update-mode aggregate per (user, session); distinct counts are exact only in the batch form."""
    pages = lambda kind: F.count_if((F.col("event_type") == "PAGE_VIEW") & (F.col("page_type") == kind))
    return events.groupBy("user_id", "session_id").agg(
        F.count("*").alias("total_page_views"), pages("PRODUCT").alias("product_page_views"),
        pages("CART").alias("cart_page_views"), pages("CHECKOUT").alias("checkout_page_views"),
        F.max("event_time").alias("last_event_time"))


def _latest(*columns: str) -> list[Column]:
    """The newest row's values, by event time and event id."""
    newest = F.max(F.struct("event_time", "event_id", *columns))
    return [newest[c].alias(f"_{c}") for c in columns]


def running_product_totals(views: DataFrame) -> DataFrame:
    """Update-mode aggregate per (user, session) of product views: totals, prices, durations."""
    valid = F.when(F.col("view_duration_ms") > 0, F.col("view_duration_ms"))
    return views.groupBy("user_id", "session_id").agg(
        F.count("*").alias("total_product_views"), F.coalesce(F.avg("price"), F.lit(0.0)).alias("avg_product_price"),
        F.coalesce(F.max("price"), F.lit(0.0)).alias("max_viewed_price"),
        F.coalesce(F.min("price"), F.lit(0.0)).alias("min_viewed_price"),
        F.sum(valid).alias("viewed_ms"), F.max("event_time").alias("last_event_time"))


def running_cart_state(carts: DataFrame) -> DataFrame:
    """Update-mode aggregate per (user, session): the newest cart total and item count, adds and removes."""
    action = lambda kind: F.count_if(F.col("action") == kind)
    return carts.groupBy("user_id", "session_id").agg(
        *_latest("cart_total", "cart_item_count"), action("ADD").alias("cart_adds"), action("REMOVE").alias("cart_removes"),
        F.max("event_time").alias("last_event_time")).select(
        "user_id", "session_id", F.coalesce("_cart_total", F.lit(0.0)).alias("current_cart_total"),
        F.coalesce(F.col("_cart_item_count").cast("bigint"), F.lit(0)).alias("current_cart_items"), "cart_adds", "cart_removes",
        "last_event_time")


def running_ai_totals(events: DataFrame) -> DataFrame:
    """Update-mode aggregate per user of assistant searches: counts by tool, price bounds, results shown."""
    tool = lambda kind: F.count_if(F.col("tool_name") == kind)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return events.groupBy("user_id").agg(
        F.count("*").alias("ai_search_count"), mean("min_price").alias("ai_avg_min_price"),
        mean("max_price").alias("ai_avg_max_price"), F.coalesce(F.max("max_price"), F.lit(0.0)).alias("ai_max_budget"),
        tool("searchProducts").alias("ai_product_searches"), tool("getProductDetails").alias("ai_product_detail_views"),
        tool("compareProducts").alias("ai_product_comparisons"),
        F.coalesce(F.sum("results_count"), F.lit(0)).cast("bigint").alias("ai_total_results_shown"),
        F.max("event_time").alias("last_event_time"))


def running_order_totals(orders: DataFrame) -> DataFrame:
    """Update-mode aggregate per user of order events with lines: orders, spend weighted by lines, the newest order.

    Each order event counts as one order; a stream that may repeat events is cleared of them first.
    """
    lines = F.size("items")
    return orders.where(lines > 0).groupBy("user_id").agg(
        F.count("*").alias("total_orders"), F.coalesce(F.sum(F.col("total") * lines), F.lit(0.0)).alias("total_spent"),
        F.sum(F.when(F.col("total").isNotNull(), lines)).alias("_lines"),
        *_latest("total", "payment_method", "status"), F.max("event_time").alias("last_event_time")).select(
        "user_id", "total_orders", "total_spent",
        F.coalesce(F.col("total_spent") / F.nullif("_lines", F.lit(0)), F.lit(0.0)).alias("avg_order_value"),
        F.coalesce("_total", F.lit(0.0)).alias("last_order_total"),
        F.coalesce("_payment_method", F.lit("UNKNOWN")).alias("preferred_payment_method"),
        F.coalesce("_status", F.lit("UNKNOWN")).alias("last_order_status"), "last_event_time")


@contextlib.contextmanager
def stateful_settings(spark: SparkSession):
    """Settings for a run of `running_views` that stops at the end of its input, restored afterwards.

    Keyed state with expiry needs the RocksDB store, and processing-time expiry asks for empty
    batches for ever, which a run that stops must not wait for.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ViewCounter(StatefulProcessor):
    """Running view totals per (user, session), forgotten after `ttl_ms` without an update."""

    SCHEMA = "views long, prices long, price_sum double, max_price double"
    OUTPUT = "user_id string, session_id string, total_product_views long, avg_product_price double, max_viewed_price double"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", self.SCHEMA, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        views, prices, price_sum, max_price = self.totals.get() if self.totals.exists() else (0, 0, 0.0, 0.0)
        for batch in rows:
            given = batch["price"].dropna()  # a view without a price counts as a view, not in the mean
            views += len(batch)
            prices += len(given)
            price_sum += float(given.sum())
            max_price = max(max_price, float(given.max())) if len(given) else max_price
        self.totals.update((views, prices, price_sum, max_price))
        yield pd.DataFrame({
            "user_id": [key[0]], "session_id": [key[1]], "total_product_views": [views],
            "avg_product_price": [price_sum / prices if prices else 0.0], "max_viewed_price": [max_price]})

    def close(self) -> None:
        pass


def running_views(views: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Upserts of view totals per (user, session) with state expiry; needs the RocksDB state store."""
    return views.select("user_id", "session_id", "price").groupBy("user_id", "session_id").transformWithStateInPandas(
        ViewCounter(ttl_seconds * 1000), outputStructType=ViewCounter.OUTPUT, outputMode="Update", timeMode="ProcessingTime")
