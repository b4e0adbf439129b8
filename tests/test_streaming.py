"""Streams against the batch operators, replays, and the profile stores."""

import random

from pyspark.sql import functions as F

from tradewind.operators.profiles import live_profiles
from tradewind.plans.profile_build import build_profiles_from_events
from tradewind.schemas import PROFILE, TOPICS, from_wire, to_wire
from tradewind.sources.profile_store import upsert, write_profiles
from tradewind.sources.topics import read_events
from tradewind.streaming.profiles import ProfileStream, envelope, merge_into_cache


def make_events(spark, seed=1, n=60):
    """Random events of all topics for a few users; user u0 holds a third of them."""
    rng, rows = random.Random(seed), {t: [] for t in TOPICS}
    for i in range(n):
        u = "u0" if rng.random() < 0.33 else f"u{rng.randrange(5)}"
        at = f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00.000"
        p, c, s = f"p{rng.randrange(9)}", f"c{rng.randrange(4)}", f"{u}-{rng.randrange(2)}"
        kind = rng.choice(list(TOPICS))
        rows[kind].append({
            "user-events": (str(i), u, s, "PAGE_VIEW", rng.choice(["PRODUCT", "CART"]), "", "MOBILE", "", at),
            "product-views": (str(i), u, s, p, p, c, 10.0 * i, "SEARCH", f"q{i % 3}", i, at),
            "cart-events": (str(i), u, s, rng.choice(["ADD", "REMOVE"]), p, p, c, 1, 5.0, float(i), i, at),
            "order-events": (str(i), u, f"o{i}", [(p, p, c, 1, 2.0)], 2.0, 0.0, 2.0, "UPI", "PLACED", "", "", at),
            "ai-events": (str(i), u, "", f"ask {i}", "HYBRID", "searchProducts", c, 0.0, 100.0 * (i % 4), 0.0, 3, [], 1,
                          at.replace(" ", "T") + "Z")}[kind])
    return {t: spark.createDataFrame(rows[t], TOPICS[t]) for t in TOPICS}


def key(df):
    return sorted((tuple(str(r[c]) for c in PROFILE.names)) for r in df.collect())


def batch_profiles(events):
    e = {t: from_wire(df) for t, df in events.items()}
    return build_profiles_from_events(e["product-views"], e["cart-events"], e["user-events"], e["ai-events"], e["order-events"])


def test_stream_in_batches_equals_one_batch_and_replays(spark, tmp_path):
    events = make_events(spark)
    for t, df in events.items():
        df.repartition(2).write.parquet(str(tmp_path / t))
    streams = {t: read_events(spark, t, str(tmp_path / t), streaming=True, maxFilesPerTrigger="1") for t in TOPICS}
    job = ProfileStream(str(tmp_path / "state"), buckets=3)
    q = job.start(envelope(streams))
    q.awaitTermination()
    want = key(batch_profiles(events))
    assert q.lastProgress["batchId"] >= 1 and want
    assert key(job.snapshot(spark)) == want
    # The same batch again, as after a failure between write and commit, changes nothing.
    logged = spark.read.parquet(f"{job.log_path()}/batch=1").select("topic", "user_id", "body").collect()
    job.process(spark.createDataFrame(logged, "topic string, user_id string, body string"), 1)
    assert key(job.snapshot(spark)) == want


def envelopes(events):
    return envelope({t: from_wire(df) for t, df in events.items()})


def test_a_batch_reads_the_newest_state_of_its_buckets_and_nothing_else(spark, tmp_path):
    events = envelopes(make_events(spark, n=120))
    job, seen, plain = ProfileStream(str(tmp_path / "state"), buckets=2), [], ProfileStream.stored

    def stored(self, session, name, schema, at):
        df = plain(self, session, name, schema, at)
        seen.append(set() if df is None else {int(f.split("/batch=")[1].split("/")[0]) for f in df.inputFiles()})
        return df

    rows = events.collect()
    for n in range(4):
        del seen[:]
        ProfileStream.stored = stored
        try:
            job.process(spark.createDataFrame(rows[n::4], events.schema), n)
        finally:
            ProfileStream.stored = plain
        assert set().union(*seen) <= {n - 1}  # both buckets are touched by every batch
    want = key(batch_profiles(make_events(spark, n=120)))
    assert key(job.snapshot(spark)) == want
    job.compact(spark)
    assert key(job.snapshot(spark)) == want and job._batches(spark, "profiles") == []
    job.process(spark.createDataFrame(rows[:1], events.schema), 4)  # the state goes on after compaction
    assert {r.user_id for r in job.snapshot(spark).collect()} == {r[0] for r in want}


def test_life_spans_end_between_batches(spark, tmp_path):
    events = make_events(spark, n=150)
    rows = envelopes(events).collect()
    import json
    stamp = lambda r: json.loads(r.body)["timestamp"].replace("T", " ").replace("Z", "")[:19]
    rows = sorted(rows, key=stamp)  # batches in the order of time
    job = ProfileStream(str(tmp_path / "state"), ttl_seconds=3600, buckets=2)
    for n in range(3):
        job.process(spark.createDataFrame(rows[50 * n:50 * n + 50], "topic string, user_id string, body string"), n)
    from tradewind.operators.events import timed_ai_events, timed_events
    from tradewind.operators.ranking import expire_idle
    from tradewind.operators import activity as A
    from tradewind.operators.events import flatten_order_items
    from tradewind.operators.profiles import build_user_profiles
    e = {t: from_wire(df) for t, df in events.items()}
    session = ["user_id", "session_id"]
    live = lambda t, keys, timed=timed_events: expire_idle(timed(e[t]), keys, 3600)
    want = build_user_profiles(
        A.product_activity(live("product-views", session)), A.cart_activity(live("cart-events", session)),
        A.session_activity(live("user-events", session)), A.ai_activity(live("ai-events", ["user_id"], timed_ai_events)),
        A.order_activity(flatten_order_items(live("order-events", ["user_id"]))), 3600)
    everything = key(batch_profiles(events))
    assert key(want) != everything
    got = {r[:2]: r for r in key(job.snapshot(spark))}
    assert got == {r[:2]: r for r in key(want)}


def test_wire_names_survive_a_round_trip(spark, tmp_path):
    orders = make_events(spark)["order-events"]
    path = str(tmp_path / "orders")
    orders.write.json(path)
    df = read_events(spark, "order-events", path, fmt="json")
    assert "payment_method" in df.columns and "product_id" in df.schema["items"].dataType.elementType.names
    assert to_wire(df).columns == orders.columns and df.count() == orders.count()


def test_upserts_skip_tombstones_and_keep_the_newest(spark):
    p = batch_profiles(make_events(spark))
    rows = p.withColumn("is_tombstone", F.lit(False)).withColumn("total_orders", F.lit(1).cast("bigint"))
    newer = rows.withColumn("last_updated", F.lit("2030-01-01 00:00:00")).withColumn("total_orders", F.lit(7).cast("bigint"))
    dead = newer.withColumn("is_tombstone", F.lit(True)).withColumn("last_updated", F.lit("2031-01-01 00:00:00"))
    nobody = newer.withColumn("user_id", F.lit(" "))
    got = upsert(None, rows.unionByName(newer).unionByName(dead).unionByName(nobody), ["user_id", "session_id"], ["last_updated"])
    assert got.count() == p.count() and {r.total_orders for r in got.collect()} == {7}
    first = write_profiles(spark, p.filter("session_id LIKE '%-0'"))
    assert key(spark.read.parquet(write_profiles(spark, p, first))) == key(p)


def test_cache_forgets_idle_profiles(spark):
    p = batch_profiles(make_events(spark)).filter("user_id = 'u0'").orderBy("session_id").limit(1)
    old = p.withColumn("last_updated", F.lit("2024-01-01 00:00:00")).withColumn("total_orders", F.lit(50).cast("bigint"))
    new = p.withColumn("total_orders", F.lit(0).cast("bigint"))
    warm = merge_into_cache(old, new, "2024-01-01 00:30:00").first()
    cold = merge_into_cache(old, new, "2024-01-01 02:00:00").first()
    assert (warm.total_orders, cold.total_orders) == (50, 0)
    assert warm.last_updated == "2024-01-01 00:30:00" and live_profiles(p.limit(0), "2024-01-01 00:00:00").count() == 0


def test_landed_files_are_bounded_in_three_batches(spark, tmp_path, monkeypatch):
    """More events land in more files of bounded size; a batch takes a third of them."""
    from tradewind.checks import streams
    from tradewind.checks.shapes import Shapes

    rows = [(i, 0, "user", f"text {i}") for i in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "data" / "conversations.parquet"))
    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    seen = []

    def take(batch, number):
        files = batch.groupBy(F.input_file_name()).count().collect()
        seen.append([r["count"] for r in files])

    q = streams.topic_stream(Shapes(spark, str(tmp_path / "data")), "ai-events").writeStream.option(
        "checkpointLocation", str(tmp_path / "state")).foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 3 and sum(map(sum, seen)) == 300
    assert max(map(max, seen)) <= 60 and all(len(files) >= 4 for files in seen)
