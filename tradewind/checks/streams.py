"""Queries run as streams over the given tables, checked against the batch SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.events import minute_activity, timed_events
from ..schemas import PROFILE, TOPICS
from ..session import fresh_path, materialise
from ..sources.topics import OffsetLog, events_of, read_events, read_records
from ..streaming import aggregates
from ..streaming.profiles import ProfileStream, envelope, merge_into_cache
from .behaviour import PROFILE_SQL_COLS, READ_COLUMNS, READ_SQL, _merge_sql, profiles_staged
from .registry import flat, query, r
from .shapes import Shapes


FILE_ROWS = 100_000  # events in a landed file, which one task writes and reads
ROW_TABLES = {"order-events": "orders", "ai-events": "conversations"}  # tables with at least a topic's rows; else events


def topic_folder(s: Shapes, topic: str, files: int = 3) -> str:
    """A topic landed as a few files, so that a stream reads it in several batches."""
    path = fresh_path(s.spark, topic)
    s.wire(topic).repartition(files, "eventId").write.parquet(path)
    return path


def topic_stream(s: Shapes, topic: str, batches: int = 3) -> DataFrame:
    """A landed topic as a stream of so many batches, each of as many files of FILE_ROWS rows as its rows ask for."""
    rows = s.t(ROW_TABLES.get(topic, "events")).count()
    files = max(1, -(-rows // (batches * FILE_ROWS)))
    path = topic_folder(s, topic, batches * files)
    return read_events(s.spark, topic, path, streaming=True, maxFilesPerTrigger=str(files))


def run_to_table(df: DataFrame, s: Shapes, mode: str, keys: list[str], places: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there, keep every emitted row with its batch, read the newest per key.

    `places` are the folders of the output and the checkpoint, if a run goes on with those of an earlier one.
    """
    out, state = places or (fresh_path(s.spark, "stream-out"), fresh_path(s.spark, "stream-state"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = s.spark.read.parquet(out).drop("b")
    cols = [c for c in rows.columns if c != "_batch"]
    newest = F.max(F.struct("_batch", F.struct(*cols).alias("row")))["row"]
    return rows.groupBy(*keys).agg(newest.alias("row")).select("row.*")


def record_folder(s: Shapes, topic: str) -> str:
    """A topic as records of a bus with three partitions, landed in three files of which the second comes twice."""
    path = fresh_path(s.spark, f"{topic}-records")
    wire = s.wire(topic)
    part = F.pmod(F.xxhash64("userId"), F.lit(3)).cast("int")
    rows = wire.select(F.to_json(F.struct(*wire.columns)).alias("value"), part.alias("partition"), "eventId")
    place = F.row_number().over(Window.partitionBy("partition").orderBy(F.xxhash64("eventId"), "eventId")) - 1
    rows = materialise(rows.withColumn("offset", place.cast("long")).select("value", "partition", "offset"), "records")
    third = F.ceil((rows.agg(F.max("offset")).first()[0] + 1) / F.lit(3))
    for i in (0, 1, 1, 2):
        rows.where(F.floor(F.col("offset") / third) == i).coalesce(1).write.mode("append").parquet(path)
    return path


@query("s1_read_records", READ_SQL)
def s1_records(s: Shapes) -> DataFrame:
    """Records of a bus read in one batch, records that came twice once."""
    log = OffsetLog(fresh_path(s.spark, "offsets"))
    records = log.fresh(read_records(s.spark, record_folder(s, "product-views")), 0)
    return flat(events_of(records, "product-views"), *READ_COLUMNS)


@query("s1_stream_records", READ_SQL)
def s1_stream_records(s: Shapes) -> DataFrame:
    """The same as a stream of several batches that marks how far each partition was taken."""
    log, out = OffsetLog(fresh_path(s.spark, "offsets")), fresh_path(s.spark, "stream-out")

    def write(batch: DataFrame, number: int) -> None:
        fresh = materialise(log.fresh(batch, number), "fresh-records")
        events_of(fresh, "product-views").write.mode("overwrite").parquet(f"{out}/b={number}")
        log.commit(fresh, number)

    stream = read_records(s.spark, record_folder(s, "product-views"), streaming=True, maxFilesPerTrigger="1")
    q = stream.writeStream.option("checkpointLocation", fresh_path(s.spark, "stream-state")).foreachBatch(write).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return flat(s.spark.read.parquet(out).drop("b"), *READ_COLUMNS)


@query("st1_stream_session_counts", """
SELECT user_id, session_id, total_page_views, product_page_views, cart_page_views, checkout_page_views,
  strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time FROM x_a3""")
def st1(s: Shapes) -> DataFrame:
    stream = topic_stream(s, "user-events")
    counts = aggregates.running_session_counts(timed_events(stream))
    return flat(run_to_table(counts, s, "update", ["user_id", "session_id"]))


def run_aggregate(s: Shapes, topic: str, aggregate, keys: list[str]) -> DataFrame:
    """A running aggregate of a topic in three batches, newest row for each key."""
    return flat(run_to_table(aggregate(timed_events(topic_stream(s, topic))), s, "update", keys))


TIME = "strftime(t, '%Y-%m-%d %H:%M:%S') AS last_event_time"


@query("st1_stream_product_totals", f"""
SELECT user_id, session_id, total_product_views, {r('avg_product_price')}, max_viewed_price, min_viewed_price, viewed_ms, strftime(v.t, '%Y-%m-%d %H:%M:%S') AS last_event_time
FROM x_a1 JOIN (SELECT user_id, session_id, sum(view_duration_ms) FILTER (view_duration_ms > 0)::BIGINT AS viewed_ms, max(event_time) AS t
  FROM x_views GROUP BY ALL) v USING (user_id, session_id)""")
def st1_products(s: Shapes) -> DataFrame:
    return run_aggregate(s, "product-views", aggregates.running_product_totals, ["user_id", "session_id"])


@query("st1_stream_cart_state", f"""
SELECT user_id, session_id, {r('current_cart_total')}, current_cart_items, cart_adds, cart_removes, {TIME} FROM x_a2""")
def st1_carts(s: Shapes) -> DataFrame:
    return run_aggregate(s, "cart-events", aggregates.running_cart_state, ["user_id", "session_id"])


@query("st1_stream_ai_totals", f"""
SELECT user_id, ai_search_count, {r('ai_avg_min_price')}, {r('ai_avg_max_price')}, {r('ai_max_budget')}, ai_product_searches,
  ai_product_detail_views, ai_product_comparisons, ai_total_results_shown, {TIME} FROM x_a4""")
def st1_ai(s: Shapes) -> DataFrame:
    return run_aggregate(s, "ai-events", aggregates.running_ai_totals, ["user_id"])


@query("st1_stream_order_totals", f"""
SELECT user_id, total_orders, {r('total_spent')}, {r('avg_order_value')}, {r('last_order_total')}, preferred_payment_method,
  last_order_status, {TIME} FROM x_a5""")
def st1_orders(s: Shapes) -> DataFrame:
    return run_aggregate(s, "order-events", aggregates.running_order_totals, ["user_id"])


@query("st2_stream_profiles", f"SELECT {PROFILE_SQL_COLS} FROM x_prof")
def st2(s: Shapes) -> DataFrame:
    """All five topics as one stream in three batches; the last snapshot equals the batch profiles."""
    streams = {t: topic_stream(s, t) for t in TOPICS}
    job = ProfileStream(fresh_path(s.spark, "profile-stream"), buckets=8)
    q = job.start(envelope(streams))
    q.awaitTermination()
    return flat(job.snapshot(s.spark))


@query("st3_stream_views_with_ttl", "SELECT user_id, session_id, total_product_views, "
       + r("avg_product_price") + ", max_viewed_price FROM x_a1")
def st3(s: Shapes) -> DataFrame:
    """Keyed state with expiry; nothing expires within one run, so totals equal the batch ones."""
    stream = topic_stream(s, "product-views")
    totals = aggregates.running_views(timed_events(stream))
    with aggregates.stateful_settings(s.spark):
        return flat(run_to_table(totals, s, "update", ["user_id", "session_id"]))


SECOND = "right(event_id, 1) IN ('0', '1', '2')"


@query("st3_stream_views_expired", f"""
SELECT user_id, session_id, count(*) AS total_product_views, {r('coalesce(avg(price), 0)', 'avg_product_price')}, coalesce(max(price), 0.0) AS max_viewed_price
FROM x_views v WHERE {SECOND} OR NOT EXISTS (
  SELECT 1 FROM x_views w WHERE w.user_id = v.user_id AND w.session_id = v.session_id AND {SECOND.replace('event_id', 'w.event_id')})
GROUP BY ALL""")
def st3_expired(s: Shapes) -> DataFrame:
    """Two runs over one state, further apart than its time to live: keys seen again start anew."""
    path, places = fresh_path(s.spark, "product-views"), (fresh_path(s.spark, "stream-out"), fresh_path(s.spark, "stream-state"))
    wire = s.wire("product-views")
    second = F.substring("eventId", -1, 1).isin("0", "1", "2")
    for part in (wire.filter(~second), wire.filter(second)):
        part.write.mode("append").parquet(path)
        stream = read_events(s.spark, "product-views", path, streaming=True)
        with aggregates.stateful_settings(s.spark):
            rows = run_to_table(aggregates.running_views(timed_events(stream), ttl_seconds=2), s, "update",
                                ["user_id", "session_id"], places)
        time.sleep(3)
    return flat(rows)


FILLED_AT, MERGED_AT = "2024-01-31 00:00:00", "2024-02-01 00:00:00"


@query("st4_merge_into_cache", f"""
SELECT * REPLACE (CASE WHEN user_id IN (SELECT user_id FROM x_prof WHERE session_id LIKE '%-b') THEN '{MERGED_AT}' ELSE '{FILLED_AT}' END
  AS last_updated) FROM ({_merge_sql("b")})""")
def st4(s: Shapes) -> DataFrame:
    """First sessions fill the cache, second sessions are merged into it while it is live."""
    p, month = profiles_staged(s), 60 * 86400
    cache = merge_into_cache(None, p.filter(F.col("session_id").endswith("-a")), FILLED_AT, month)
    merged = merge_into_cache(cache, p.filter(F.col("session_id").endswith("-b")), MERGED_AT, month)
    return flat(merged, *[f.name for f in PROFILE])


@query("st5_stream_minute_activity", """
SELECT user_id, strftime(date_trunc('minute', event_time), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS events
FROM x_views GROUP BY ALL""")
def st5(s: Shapes) -> DataFrame:
    stream = topic_stream(s, "product-views")
    minutes = minute_activity(timed_events(stream), watermark="40 days")
    return flat(run_to_table(minutes, s, "update", ["user_id", "minute"]))
