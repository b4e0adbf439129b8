"""From topic rows to typed, timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def timed_events(events: DataFrame) -> DataFrame:
    """Add `event_time` from the text `timestamp`; rows without a readable time are dropped."""
    return (
        events.filter(F.col("timestamp").isNotNull() & (F.col("timestamp") != ""))
        .withColumn("event_time", F.expr("try_to_timestamp(timestamp)"))
        .filter("event_time IS NOT NULL")
    )


def timed_ai_events(events: DataFrame) -> DataFrame:
    """Assistant events carry ISO instants: seconds precision from the first 19 characters."""
    return (
        events.filter(F.col("timestamp").isNotNull() & (F.col("timestamp") != ""))
        .withColumn("event_time", F.expr("try_to_timestamp(substring(timestamp, 1, 19), \"yyyy-MM-dd'T'HH:mm:ss\")"))
        .filter("event_time IS NOT NULL")
    )


def flatten_order_items(orders: DataFrame) -> DataFrame:
    """One row per order line, by field name; orders without lines disappear."""
    return (
        orders.select(
            "event_id", "user_id", "order_id", "total", "discount", "payment_method", "status", "event_time",
            F.posexplode("items").alias("item_pos", "item"))
        .select("*", F.col("item.category").alias("category"), F.col("item.product_id").alias("product_id"))
        .drop("item")
    )


def minute_activity(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Event counts per user and minute; with a watermark it also runs as an append-mode stream."""
    if watermark:
        events = events.withWatermark("event_time", watermark)
    return (
        events.groupBy("user_id", F.window("event_time", "1 minute"))
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("window.start").alias("minute"), "events")
    )
