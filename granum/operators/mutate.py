"""Changes to a table as new tables: upserts, updates, removals, and checks of rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of `changes` take the place of those with an equal key, others are added. One change per key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(table.columns))


def update_where(table: DataFrame, condition: Column, sets: dict[str, Any], keep_null: bool = True) -> DataFrame:
    """Columns set where the condition holds; with keep_null a null value leaves the old one."""
    value = lambda c, v: F.coalesce(v if isinstance(v, Column) else F.lit(v), F.col(c)) if keep_null else (v if isinstance(v, Column) else F.lit(v))
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, value(c, sets[c])).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, condition: Column | None) -> DataFrame:
    """Rows for which the condition isn't true; no condition deletes nothing."""
    return table if condition is None else table.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their 0-based place in `order`; equal ones follow a hash of the row.

    Rows are dealt by ranges and checkpointed with the number of their range, so that neither adaptive planning nor a
    retry can count them otherwise than they lie; each range is counted, then numbered from its offset.
    """
    from granum.sources.tables import settled

    tie = F.xxhash64(*[F.col(c) for c in rows.columns if not rows.schema[c].dataType.simpleString().startswith(("map", "variant"))])
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.withColumn("_t", tie).repartitionByRange(ranges, *order, "_t").withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a range
    n = F.row_number().over(Window.partitionBy("_p").orderBy(*order, "_t"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + n - 1).drop("_p", "_b", "_t")


def allocate_ids(rows: DataFrame, first: int, order: str, key: str = "id") -> DataFrame:
    """Ids from `first` on in `order`, without gaps."""
    return numbered_rows(rows, [F.col(order)], key).withColumn(key, F.col(key) + first)


def mark_deleted(table: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """The flag set to true on the rows of these ids; they stay in the table."""
    hit = ids.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    out = table.join(hit, key, "left")
    old = F.col(flag) if flag in table.columns else F.lit(False)
    return out.withColumn(flag, F.col("_hit").isNotNull() | F.coalesce(old, F.lit(False))).select(*table.columns, *([] if flag in table.columns else [flag]))


def update_ids(table: DataFrame, ids: DataFrame, key: str, sets: dict[str, Any]) -> DataFrame:
    """Columns set, nulls too, on the rows of these ids."""
    hit = ids.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    out = table.join(hit, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.lit(sets[c])).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in table.columns])


def merge_counts(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row: how many of the changes update a row of the table and how many insert one."""
    known = table.select(F.col(key), F.lit(1).alias("_known")).distinct()
    return changes.join(known, key, "left").agg(F.count("_known").alias("updated"), F.count_if(F.col("_known").isNull()).alias("inserted"))


#: Rows of a table or of ids that one task gets, about, when remove_with_relations deals them by key.
ROWS_DEALT = 1_000_000


def remove_with_relations(table: DataFrame, links: DataFrame, ids: DataFrame, key: str, link_key: str) -> tuple[DataFrame, DataFrame]:
    """The table and its link table without these ids. Partitions grow in number with the rows, so that no task's sorts and counts grow."""
    known, least = ids.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def without(df: DataFrame, name: str) -> DataFrame:
        n = max(-(-max(df.count(), known) // ROWS_DEALT), least)
        gone = ids.select(F.col(key).alias(name)).repartition(n, name)
        return df.repartition(n, name).join(gone.hint("merge"), name, "left_anti")

    return without(table, key), without(links, link_key)


def violations(table: DataFrame, rules: dict[str, dict[str, Any]]) -> Column:
    """Names of the broken rules of each row: per column any of nullable=False, length (UTF-8 bytes), min, max, pattern."""
    found = []
    for c, r in rules.items():
        col = F.col(c)
        checks = {
            "null": col.isNull() if r.get("nullable", True) is False else None,
            "length": F.octet_length(col.cast("string")) > r["length"] if "length" in r else None,
            "min": col < r["min"] if "min" in r else None,
            "max": col > r["max"] if "max" in r else None,
            "pattern": ~col.rlike(r["pattern"]) if "pattern" in r else None,
        }
        found += [F.when(F.coalesce(k, F.lit(False)), F.lit(f"{c}:{n}")) for n, k in checks.items() if k is not None]
    return F.array_compact(F.array(*found))
