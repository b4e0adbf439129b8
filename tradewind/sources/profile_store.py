"""Profile snapshots: versioned tables keyed by (user_id, session_id) or by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import latest_by_key
from ..session import fresh_path

KEY = ["user_id", "session_id"]


def upsert(snapshot: DataFrame | None, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Snapshot after the changes: newest change per key replaces the stored row.

    Tombstones (is_tombstone true) and rows without a user are skipped.
    """
    live = changes.filter(F.trim(F.coalesce(F.col("user_id"), F.lit(""))) != "")
    if "is_tombstone" in changes.columns:
        live = live.filter(~F.coalesce(F.col("is_tombstone"), F.lit(False))).drop("is_tombstone")
    newest = latest_by_key(live, keys, order)
    if snapshot is None:
        return newest
    return snapshot.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def write_profiles(spark: SparkSession, changes: DataFrame, current: str | None = None,
                   keys: list[str] | None = None, order: list[str] | None = None) -> str:
    """Write the next snapshot version and return its path."""
    snapshot = spark.read.parquet(current) if current else None
    path = fresh_path(spark, "profiles")
    upsert(snapshot, changes, keys or KEY, order or ["last_updated"]).write.parquet(path)
    return path
