"""A table with keys that is merged when it is read: a base and deltas for each bucket of keys.

Below the root, `rows/batch=N/bucket=B` holds the rows that batch N wrote for the keys of bucket B, a removed key as a row
with `_deleted`. `manifests/snapshot=S` says for every bucket which batch is its base and which later ones change it. A
change writes its own rows and a manifest, nothing else; a bucket whose deltas have grown against its base is rewritten
alone. Files of older snapshots stay, so whoever reads one keeps its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..session import fresh_path

MANIFEST = ("bucket int, base long, deltas array<long>, base_rows long, delta_rows long, buckets int, keys array<string>, "
            "columns string, snapshot long")
BUCKET_ROWS = 100_000  # rows of a bucket when a store is created
COMPACT_SHARE = 0.25  # deltas of a bucket against its base, from which it is rewritten


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


@dataclass(frozen=True)
class KeyedStore:
    """A snapshot; `state` has (base, deltas, rows of the base, rows of the deltas) for each bucket that holds rows."""

    root: str
    snapshot: int
    keys: tuple[str, ...]
    buckets: int
    columns: str  # the schema as JSON
    state: dict[int, tuple[int, tuple[int, ...], int, int]]

    @property
    def schema(self) -> StructType:
        import json

        return StructType.fromJson(json.loads(self.columns))

    def rows(self, spark: SparkSession, buckets: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the given buckets (column bucket): a key's newest row, unless it is deleted.

        Which files a bucket has is joined on the partition columns, so other buckets and older batches are not read. The
        base's rows meet the keys of the deltas only.
        """
        names = [f.name for f in self.schema]
        places = [(b, n, n == base) for b, (base, deltas, _, _) in self.state.items() for n in (base, *deltas)]
        if not places:
            return spark.createDataFrame([], self.schema)
        live = spark.createDataFrame(places, "bucket int, batch long, _base boolean").where("batch >= 0")
        if buckets is not None:
            live = live.join(F.broadcast(buckets.select("bucket").distinct()), "bucket")
        stored = StructType(self.schema.fields).add("_deleted", "boolean").add("batch", "long").add("bucket", "integer")
        found = spark.read.schema(stored).parquet(f"{self.root}/rows").join(F.broadcast(live), ["batch", "bucket"])
        if not any(s[1] for s in self.state.values()):
            return found.select(*names)
        latest = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.col("batch").desc()))
        changed = found.where("NOT _base").withColumn("_latest", latest).where("_latest = 1")
        return found.where("_base").join(changed.select(*self.keys), list(self.keys), "left_anti").select(*names).unionByName(
            changed.where("NOT _deleted").select(*names))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys asked for; only their buckets are read."""
        asked = keys.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]).distinct()
        # at most one row for each bucket is broadcast
        wanted = asked.select(bucket_of(list(self.keys), self.buckets)).distinct()
        return self.rows(keys.sparkSession, wanted).join(asked, list(self.keys), "left_semi")


def _write(rows: DataFrame, store: KeyedStore, batch: int) -> dict[int, int]:
    """Write rows (with _deleted) as a batch; rows of each bucket."""
    path = f"{store.root}/rows/batch={batch}"
    rows.withColumn("bucket", bucket_of(list(store.keys), store.buckets)).hint("rebalance", "bucket").write.mode(
        "overwrite").partitionBy("bucket").parquet(path)
    written = rows.sparkSession.read.schema("_deleted boolean, bucket int").parquet(path)
    return {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # one row a bucket


def _commit(spark: SparkSession, store: KeyedStore) -> KeyedStore:
    rows = [(b, base, list(deltas), n, m, store.buckets, list(store.keys), store.columns)
            for b, (base, deltas, n, m) in store.state.items()] or [
        (-1, -1, [], 0, 0, store.buckets, list(store.keys), store.columns)]
    spark.createDataFrame(rows, MANIFEST.replace(", snapshot long", "")).coalesce(1).write.mode("overwrite").parquet(
        f"{store.root}/manifests/snapshot={store.snapshot}")
    return store


def create_store(rows: DataFrame, keys: list[str], root: str | None = None, buckets: int | None = None) -> KeyedStore:
    """Write all rows as the base of the first snapshot below `root` (default: a new folder). Keys are unique in `rows`.

    Buckets hold BUCKET_ROWS rows on average unless their number is given.
    """
    spark = rows.sparkSession
    buckets = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    store = KeyedStore(root or fresh_path(spark, "keyed-store"), 0, tuple(keys), buckets, rows.schema.json(), {})
    counts = _write(rows.withColumn("_deleted", F.lit(False)), store, 0)
    return _commit(spark, KeyedStore(store.root, 0, store.keys, buckets, store.columns,
                                     {b: (0, (), n, 0) for b, n in counts.items()}))


def open_store(spark: SparkSession, root: str, snapshot: int | None = None) -> KeyedStore:
    """A snapshot of a stored table, the newest by default."""
    stored = spark.read.schema(MANIFEST).parquet(f"{root}/manifests")
    if snapshot is None:
        snapshot = stored.agg(F.max("snapshot")).first()[0]
    rows = stored.where(F.col("snapshot") == snapshot).collect()  # one row a bucket
    return KeyedStore(root, snapshot, tuple(rows[0]["keys"]), rows[0]["buckets"], rows[0]["columns"],
                      {r["bucket"]: (r["base"], tuple(r["deltas"]), r["base_rows"], r["delta_rows"]) for r in rows if r["bucket"] >= 0})


def change_store(spark: SparkSession, store: KeyedStore, upserts: DataFrame | None = None, deletes: DataFrame | None = None,
                 compact_share: float | None = COMPACT_SHARE) -> KeyedStore:
    """A new snapshot with the rows of `upserts` replacing those of their keys and the keys of `deletes` gone.

    Only the changed rows are written. A key is once in `upserts`; one that is also in `deletes` is deleted. Buckets whose
    deltas have `compact_share` of the rows of their base are rewritten (None: none are). Running a change again from
    the same snapshot replaces its own output.
    """
    if upserts is None and deletes is None:
        return store
    names, keys = [f.name for f in store.schema], list(store.keys)
    parts = []
    if deletes is not None:
        gone = deletes.select(*keys).distinct()
        parts.append(gone.select(*[
            (F.col(f.name) if f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.schema],
            F.lit(True).alias("_deleted")))
    if upserts is not None:
        kept = upserts if deletes is None else upserts.join(gone, keys, "left_anti")
        parts.append(kept.select(*names, F.lit(False).alias("_deleted")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    snapshot = store.snapshot + 1
    batch, state = 2 * snapshot, dict(store.state)
    for b, n in _write(rows, store, batch).items():
        base, deltas, base_rows, delta_rows = state.get(b, (-1, (), 0, 0))
        state[b] = (base, (*deltas, batch), base_rows, delta_rows + n)
    new = KeyedStore(store.root, snapshot, store.keys, store.buckets, store.columns, state)
    full = [b for b, (_, deltas, n, m) in state.items() if compact_share is not None and deltas and m >= compact_share * n]
    if full:
        wanted = spark.createDataFrame([(b,) for b in full], "bucket int")
        counts = _write(new.rows(spark, wanted).withColumn("_deleted", F.lit(False)), new, batch + 1)
        state = {b: s for b, s in state.items() if b not in full} | {b: (batch + 1, (), n, 0) for b, n in counts.items()}
        new = KeyedStore(store.root, snapshot, store.keys, store.buckets, store.columns, state)
    return _commit(spark, new)
