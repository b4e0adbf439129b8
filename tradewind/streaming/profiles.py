"""Continuous profiles: the five topics in, upserted profiles per batch out.

Stream-stream joins of updating aggregates are not available, so every micro-batch reduces its events to the parts that
the batch aggregates are made of, merges them with the stored parts of the user buckets it touches, writes these
buckets anew and derives the profiles of its users. What a batch costs follows from its own events and the parts of its
buckets, not from the batches before it. Every write goes to a folder named by the batch, so a replayed batch
replaces its own output and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import activity, profiles
from ..operators.events import flatten_order_items, timed_ai_events, timed_events
from ..operators.ranking import expire_idle
from ..schemas import PROFILE, TOPICS, from_wire

_DELTA = T.StructType([*PROFILE.fields, T.StructField("batch", T.LongType())])


def envelope(streams: dict[str, DataFrame]) -> DataFrame:
    """One stream (topic, user_id, body) of all topics, so one query keeps their order per batch."""
    out = None
    for topic, df in streams.items():
        part = df.select(F.lit(topic).alias("topic"), "user_id", F.to_json(F.struct(*df.columns)).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def open_topic(spark: SparkSession, log: DataFrame, topic: str) -> DataFrame:
    """Events of one topic from envelope rows."""
    snake = from_wire(spark.createDataFrame([], TOPICS[topic])).schema
    return log.filter(F.col("topic") == topic).select(F.from_json("body", snake).alias("e")).select("e.*")


def batch_tables(spark: SparkSession, batch: DataFrame, ttl_seconds: int | None) -> dict[str, DataFrame]:
    """What is stored of a batch: parts of the aggregates, or with a time to live the events themselves."""
    events = {}
    for topic in TOPICS:
        raw = open_topic(spark, batch, topic)
        events[topic] = timed_ai_events(raw) if topic == "ai-events" else timed_events(raw)
    if ttl_seconds is not None:
        return events
    return activity.activity_parts(
        events["product-views"], events["cart-events"], events["user-events"], events["ai-events"],
        flatten_order_items(events["order-events"]))


def merge_table(name: str, rows: DataFrame, ttl_seconds: int | None) -> DataFrame:
    """One state from the stored rows and the new ones; with a time to live only each key's last life span stays."""
    if ttl_seconds is None:
        return activity.merge_parts(name, rows)
    keys = ["user_id"] if name in ("ai-events", "order-events") else ["user_id", "session_id"]
    return expire_idle(rows, keys, ttl_seconds)


def profiles_of(tables: dict[str, DataFrame], ttl_seconds: int | None) -> DataFrame:
    if ttl_seconds is None:
        return profiles.build_user_profiles(*activity.activities_of(tables))
    return profiles.build_user_profiles(
        activity.product_activity(tables["product-views"]), activity.cart_activity(tables["cart-events"]),
        activity.session_activity(tables["user-events"]), activity.ai_activity(tables["ai-events"]),
        activity.order_activity(flatten_order_items(tables["order-events"])), ttl_seconds)


@dataclass
class ProfileStream:
    """State of the continuous job below one shared folder.

    `buckets` is how finely users are dealt; a batch rewrites the buckets of its users, so there should be many more
    of them than a batch has users' worth, or as many as one batch may rewrite.
    """

    root: str
    ttl_seconds: int | None = None
    buckets: int = 64

    def log_path(self) -> str:
        """The batches as they came, for replays alone."""
        return f"{self.root}/log"

    def delta_path(self) -> str:
        return f"{self.root}/profiles"

    def bucket(self):
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _batches(self, spark: SparkSession, folder: str) -> list[int]:
        """Numbers of the batches below a folder."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)
                      if f.getPath().getName().startswith("batch="))

    def newest_buckets(self, spark: SparkSession, before: int) -> dict[int, int]:
        """The batch that wrote each bucket last, among the batches before the given one; a number per bucket."""
        written = [n for n in self._batches(spark, "index") if n < before]
        if not written:
            return {}
        rows = spark.read.schema("bucket int, at bigint").parquet(f"{self.root}/index/batch={written[-1]}").collect()
        return {r["bucket"]: r["at"] for r in rows}

    def stored(self, spark: SparkSession, name: str, schema: T.StructType, at: dict[int, int]) -> DataFrame | None:
        """The stored rows of some buckets: of each, the folder of the batch that wrote it last, no other."""
        out = None
        for n in sorted(set(at.values())):
            part = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(
                f"{self.root}/state/{name}/batch={n}").filter(
                F.col("bucket").isin([b for b, m in at.items() if m == n])).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Rebalancing gives few files per topic and splits the rows of a hot user.
        log = f"{self.log_path()}/batch={batch_id}"
        batch.select("topic", "user_id", "body").hint("rebalance", "topic").write.mode("overwrite").parquet(log)
        mine = spark.read.schema("topic string, user_id string, body string").parquet(log)
        users = mine.select("user_id").distinct()
        touched = [r["bucket"] for r in users.select(self.bucket()).distinct().collect()]
        before = self.newest_buckets(spark, batch_id)
        state = {}
        for name, fresh in batch_tables(spark, mine, self.ttl_seconds).items():
            old = self.stored(spark, name, fresh.schema, {b: before[b] for b in touched if b in before})
            merged = merge_table(name, fresh if old is None else old.unionByName(fresh), self.ttl_seconds)
            path = f"{self.root}/state/{name}/batch={batch_id}"
            merged.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
                "bucket").parquet(path)
            state[name] = spark.read.schema(T.StructType(
                [*fresh.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).drop("bucket").join(
                users, "user_id", "left_semi")
        now = [(b, n) for b, n in {**before, **{b: batch_id for b in touched}}.items()]
        spark.createDataFrame(now, "bucket int, at bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/index/batch={batch_id}")
        fresh = profiles_of(state, self.ttl_seconds)
        # A touched user without a profile leaves a row without session, which hides older ones.
        gone = users.join(fresh.select("user_id").distinct(), "user_id", "left_anti").select(
            *[(F.col("user_id") if f.name == "user_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in PROFILE])
        fresh.unionByName(gone).write.mode("overwrite").parquet(f"{self.delta_path()}/batch={batch_id}")

    def compact(self, spark: SparkSession) -> None:
        """Between two runs: one file set of all users' newest profiles, and no folder that nothing reads any more."""
        done = self._batches(spark, "profiles")
        if not done:
            return
        last = done[-1]
        self._newest(spark, None).write.mode("overwrite").parquet(f"{self.root}/compacted/batch={last}")
        used = set(self.newest_buckets(spark, last + 1).values())
        names = [f"state/{n}" for n in (TOPICS if self.ttl_seconds is not None else activity.PART_TABLES)]
        conf = spark._jsc.hadoopConfiguration()
        for folder, keep in (("profiles", set()), ("compacted", {last}), ("log", {last}), ("index", {last}),
                             *[(n, used) for n in names]):
            for n in set(self._batches(spark, folder)) - keep:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/batch={n}")
                path.getFileSystem(conf).delete(path, True)

    def start(self, events: DataFrame, trigger: dict | None = None):
        """Run over an envelope stream; the default trigger reads what is there and stops."""
        return (events.writeStream.foreachBatch(self.process)
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def _newest(self, spark: SparkSession, up_to: int | None) -> DataFrame:
        """Of every user, the rows of their newest batch."""
        rows = None
        for folder in ("profiles", "compacted"):
            if self._batches(spark, folder):
                part = spark.read.schema(_DELTA).parquet(f"{self.root}/{folder}")
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return spark.createDataFrame([], PROFILE)
        if up_to is not None:
            rows = rows.filter(F.col("batch") <= up_to)
        newest = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["user_id", "batch"], "left_semi").filter(F.col("session_id").isNotNull()).select(*PROFILE.names)

    def snapshot(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        """Profiles after a batch (default: the last): of every user, the rows of their newest batch."""
        return self._newest(spark, up_to)


def merge_into_cache(cache: DataFrame | None, incoming: DataFrame, as_of: str, ttl_seconds: int = 3600) -> DataFrame:
    """One profile per user after merging a batch of session profiles into the live cache.

    Cached profiles idle beyond the time to live have expired and are not merged; writing
    refreshes the time.
    """
    rows = incoming.withColumn("_seq", F.lit(1))
    if cache is not None:
        rows = rows.unionByName(profiles.live_profiles(cache, as_of, ttl_seconds).withColumn("_seq", F.lit(0)))
    merged = profiles.fold_profiles(rows, ["_seq", "last_updated", "session_id"])
    touched = incoming.select("user_id").distinct().withColumn("_new", F.lit(True))
    return merged.join(touched, "user_id", "left").withColumn(
        "last_updated", F.when(F.col("_new"), F.lit(as_of)).otherwise(F.col("last_updated"))).drop("_new")
