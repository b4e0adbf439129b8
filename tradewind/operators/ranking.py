"""Paging, top-k, ordered unions, compaction and idle expiry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def page(df: DataFrame, order: Sequence[Column | str], number: int = 0, size: int = 20) -> DataFrame:
    """Page `number` (from 0) in the given order, which must end in a unique column."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_info(df: DataFrame, number: int = 0, size: int = 20) -> DataFrame:
    """Row total and page total that accompany a page."""
    return df.agg(F.count("*").alias("total_elements")).select(
        "total_elements", F.ceil(F.col("total_elements") / size).alias("total_pages"),
        F.lit(number).alias("page"), F.lit(size).alias("size"))


def budget_order(results: DataFrame, max_price: str = "max_price", rank: str = "rank") -> DataFrame:
    """Re-rank results per query: dearest first where a price ceiling is given, else as they are."""
    w = W.partitionBy("query_id").orderBy(
        F.when(F.col(max_price).isNotNull(), F.col("price")).desc_nulls_last(), F.col(rank), F.col("id"))
    return results.withColumn(rank, F.row_number().over(w))


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; Spark also cuts to k per group before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def share_equal(queries: DataFrame, columns: Sequence[str], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a search once per distinct combination of request columns and give every query its result.

    `search` takes and returns frames keyed by query_id. Many queries asking the same thing
    cost one search.
    """
    keyed = queries.withColumn("_request", F.sha2(F.to_json(F.struct(*columns)), 256))
    distinct = keyed.select(F.col("_request").alias("query_id"), *columns).dropDuplicates(["query_id"])
    found = search(distinct).withColumnRenamed("query_id", "_request")
    return keyed.select("query_id", "_request").join(found, "_request").drop("_request")


def ordered_union(sources: Sequence[DataFrame], keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """Union in which the first source to hold a key wins; ranks become positions in the union.

    `keys` are the group columns followed by the item column.
    """
    tagged = None
    for i, src in enumerate(sources):
        part = src.withColumn("source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    # Source and rank as one number, so that the aggregation hashes; ranks stay below 2^40.
    place = F.shiftleft(F.col("source").cast("bigint"), 40) + F.col(rank)
    firsts = tagged.groupBy(*keys).agg(F.min(place).alias("_at"))
    w = W.partitionBy(*keys[:-1]).orderBy("_at", keys[-1])
    return firsts.select(*keys, F.shiftright("_at", 40).cast("int").alias("source"), F.row_number().over(w).alias(rank))


def best_score_union(sources: Sequence[DataFrame], keys: Sequence[str], score: str = "score") -> DataFrame:
    """Union keeping the best score per key."""
    merged = sources[0]
    for src in sources[1:]:
        merged = merged.unionByName(src)
    return merged.groupBy(*keys).agg(F.max(score).alias(score))


def exclude_seen(candidates: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(seen.select(*keys), list(keys), "left_anti")


def latest_by_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. Spark keeps one row per key and task before the shuffle (window group limit).

    Rows of equal order are told apart by a hash of the row.
    """
    newest = [*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*changes.columns)]
    return top_k(changes, keys, newest, 1, "_latest").drop("_latest")


def ttl_epochs(events: DataFrame, keys: Sequence[str], ttl_seconds: int, time: str = "event_time") -> DataFrame:
    """Number the life spans of each key: an idle gap longer than the time to live starts a new one.

    Within a bucket as wide as the time to live no such gap can occur, so gaps are found
    between the few (first, last) rows per bucket and the events themselves are never
    sorted by key; a hot key spreads over its buckets.
    """
    micros = int(ttl_seconds) * 1_000_000
    bucketed = events.withColumn("_b", F.floor(F.unix_micros(F.col(time)) / micros))
    spans = bucketed.groupBy(*keys, "_b").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    w = W.partitionBy(*keys).orderBy("_b")
    gap = F.unix_micros(F.col("_lo")) - F.unix_micros(F.lag("_hi").over(w))
    spans = spans.withColumn("_new", F.coalesce((gap > micros).cast("int"), F.lit(0)))
    spans = spans.withColumn("epoch", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = W.partitionBy(*keys)
    spans = spans.withColumn("last_epoch", F.max("epoch").over(last))
    return bucketed.join(spans.select(*keys, "_b", "epoch", "last_epoch"), [*keys, "_b"]).drop("_b")


def expire_idle(events: DataFrame, keys: Sequence[str], ttl_seconds: int, time: str = "event_time") -> DataFrame:
    """Events of each key's last life span: what an aggregate with state expiry would still hold."""
    tagged = ttl_epochs(events, keys, ttl_seconds, time)
    return tagged.filter(F.col("epoch") == F.col("last_epoch")).drop("epoch", "last_epoch")
