"""Ordered arrays per group, built so that no task ever holds a whole hot group.

Plain `collect_list` over a group keeps all its rows in one buffer. Here a limit is
applied first through `row_number`, which Spark also evaluates before the shuffle
(window group limit), and repeats are removed by an aggregation that combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import sorted_field


def _ordering(order: Sequence[str], newest_first: bool) -> list[Column]:
    return [F.col(c).desc() if newest_first else F.col(c).asc() for c in order]


def _collect(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(sorted_field(F.collect_list(F.struct("_o", "_v")), "_v").alias(out))


def first_rows(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], n: int | None,
               keep: str = "first") -> DataFrame:
    """(keys, order, value): the first (or last) n rows per group with a value, in event order; None: all of them."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, *order, value)
    if n is None:
        return rows
    w = W.partitionBy(*keys).orderBy(*_ordering([*order, value], keep == "last"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], n: int | None,
                 out: str, keep: str = "first") -> DataFrame:
    """The first (or last) n non-null values per group in event order, repeats kept; None: all of them."""
    limited = first_rows(df, keys, value, order, n, keep).withColumnRenamed(value, "_v")
    return _collect(limited.withColumn("_o", F.struct(*order)), keys, out)


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str,
                    n: int | None = None, keep: str = "first") -> DataFrame:
    """Distinct non-null values per group in order of first occurrence, optionally the first n.

    keep='last' takes the n values seen most recently, in order of their last occurrence.
    """
    pick = F.max if keep == "last" else F.min
    firsts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(pick(F.struct(*order)).alias("_o"))
    )
    if n is not None:
        w = W.partitionBy(*keys).orderBy(*_ordering(["_o", "_v"], keep == "last"))
        firsts = firsts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return _collect(firsts, keys, out)


def first_value(value: str, order: Sequence[str]) -> Column:
    """First non-null value in event order."""
    return F.expr(f"min_by({value}, struct({', '.join(order)})) FILTER (WHERE {value} IS NOT NULL)")


def last_value(value: str, order: Sequence[str]) -> Column:
    """Last non-null value in event order."""
    return F.expr(f"max_by({value}, struct({', '.join(order)})) FILTER (WHERE {value} IS NOT NULL)")
