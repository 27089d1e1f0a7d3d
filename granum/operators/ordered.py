"""Access by order of key: ranges, ranks, neighbours, and algebra of id sets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_range(df: DataFrame, key: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = False, limit: int = 0) -> DataFrame:
    """Rows of a key range in order. With only an upper bound a limit keeps the last keys, still in ascending order."""
    c = F.col(key)
    if low is not None:
        df = df.where(c >= low if include_low else c > low)
    if high is not None:
        df = df.where(c <= high if include_high else c < high)
    if limit > 0 and low is None and high is not None:
        return df.orderBy(c.desc()).limit(limit).orderBy(c)
    return df.orderBy(c).limit(limit) if limit > 0 else df.orderBy(c)


def rank_page(df: DataFrame, key: str, start: int, count: int) -> DataFrame:
    """`count` rows from rank `start` (0-based) in order of key; ranks come from a sort, not from one task's window."""
    return df.orderBy(key).offset(start).limit(count)


def neighbours(df: DataFrame, key: str, at: Any) -> DataFrame:
    """One row: floor, lower, ceiling, higher of a value among the keys, first and last key; null where there is none."""
    c = F.col(key)
    pick = lambda f, cond: f(F.when(cond, c))
    return df.agg(
        pick(F.max, c <= at).alias("floor_key"), pick(F.max, c < at).alias("lower_key"), pick(F.min, c >= at).alias("ceiling_key"),
        pick(F.min, c > at).alias("higher_key"), F.min(c).alias("first_key"), F.max(c).alias("last_key"),
    )


def nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """The row of 0-based rank n in order of key."""
    return df.orderBy(key).offset(n).limit(1)


def index_of(df: DataFrame, key: str, wanted: Any) -> DataFrame:
    """One row: the 0-based rank of a key, -1 if it isn't there. Counted, without a sort."""
    c = F.col(key)
    return df.agg(F.when(F.coalesce(F.bool_or(c == F.lit(wanted)), F.lit(False)), F.count_if(c < F.lit(wanted))).otherwise(-1).cast("long").alias("rank"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """The right table's latest value at or before each left row's time, per group `by`: one shuffle of both sides, no join of pairs."""
    kind = right.schema[value].dataType
    l = left.select(*left.columns, F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_side"))  # noqa: E741
    cols = [F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    r = right.select(*cols, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def combine_ids(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Set algebra over one-column tables: intersect, union, subtract."""
    return {"intersect": a.intersect, "union": lambda x: a.union(x).distinct(), "subtract": a.subtract}[kind](b)


def contains_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every row of b is in a."""
    return b.subtract(a).limit(1).agg((F.count("*") == 0).alias("contains_all"))
