"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import bound_broadcasts, bound_tasks
from .shapes import Shapes
from .sql import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(shapes) -> DataFrame` under a name, with SQL giving the same rows."""
    def wrap(fn: Callable[[Shapes], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            bound_broadcasts(spark)
            bound_tasks(spark)
            return fn(Shapes(spark, sf_dir))
        QUERIES[name] = run
        if sql:
            ORACLE[name] = compose(sql)
        return fn
    return wrap


def r(expression: str, name: str | None = None) -> str:
    """SQL for a rounded double; the small shift settles exact halves alike in both engines."""
    return f"round(CAST({expression} AS DOUBLE) + 0.0000001, 4) AS {name or expression}"


def j(expression: str, name: str | None = None) -> str:
    """SQL for a list joined by bars."""
    return f"array_to_string({expression}, '|') AS {name or expression}"


def flat(df: DataFrame, *cols: str) -> DataFrame:
    """Columns in a form two engines print alike: arrays joined, doubles rounded, decimals as doubles."""
    types = {f.name: f.dataType for f in df.schema}
    out = []
    for c in cols or df.columns:
        t, col = types[c], F.col(c)
        if isinstance(t, T.ArrayType):
            col = F.array_join(col, "|")
        elif isinstance(t, T.DoubleType):
            col = F.round(col + F.lit(0.0000001), 4)
        elif isinstance(t, T.DecimalType):
            col = col.cast("double")
        elif isinstance(t, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(c))
    return df.select(*out)
