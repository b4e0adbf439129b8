"""A bit filter over the keys of one side of a join, applied to the other side before it is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FILTER_BITS = 26  # 2^26 bits: at most 2^20 rows of 64 bits are broadcast, whatever the keys


def may_hold(rows: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose `column` may be among the values of `keys`: all that are, and few others.

    Every key sets a bit chosen by its hash. The filter is built by an aggregation that combines before it shuffles, and
    has the same bound at every size; a full one would keep all rows, not lose any. Null values are dropped.
    """
    def bit(df: DataFrame) -> DataFrame:
        return df.withColumn("_bit", F.shiftrightunsigned(F.xxhash64(F.col(column).cast("string")), 64 - bits))

    mask = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = bit(keys.select(column).filter(F.col(column).isNotNull())).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_set"))
    tested = bit(rows.filter(F.col(column).isNotNull())).withColumn("_word", F.shiftright("_bit", 6))
    return tested.join(F.broadcast(words), "_word").filter(F.col("_set").bitwiseAND(mask) != 0).select(*rows.columns)
