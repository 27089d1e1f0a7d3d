"""Enrichment: lookups, collections, sub-query tests and diffs, each as joins that Catalyst plans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, target: DataFrame, on: tuple[str, str], take: dict[str, str], order: str) -> DataFrame:
    """Columns `take` (source to new name) of the target row with an equal key; unmatched rows and null keys stay with nulls.

    Of several target rows the last non-null value by `order` wins, per column; of equal ones in `order` the greatest.
    """
    last = lambda s: F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.struct(F.col(order), F.col(s))))
    one = target.where(F.col(on[1]).isNotNull()).groupBy(F.col(on[1]).alias("_k")).agg(*[last(s).alias(d) for s, d in take.items()])
    return left.join(one, left[on[0]] == one["_k"], "left").drop("_k")


def lookup_all(left: DataFrame, lookups: list[tuple[DataFrame, tuple[str, str], dict[str, str], str]]) -> DataFrame:
    """Several lookups (target, keys, columns, order) on one table, each on the result so far."""
    for target, on, take, order in lookups:
        left = lookup(left, target, on, take, order)
    return left


def lookup_all_many_keys(left: DataFrame, lookups: list[tuple[DataFrame, list[tuple[str, str]], dict[str, str], list[str]]]) -> DataFrame:
    """Several lookups by several keys (target, keys, columns, order)."""
    for target, on, take, order in lookups:
        left = lookup_many_keys(left, target, on, take, order)
    return left


def lookup_many_keys(left: DataFrame, target: DataFrame, on: list[tuple[str, str]], take: dict[str, str], order: list[str], fixed: dict[str, object] | None = None) -> DataFrame:
    """As lookup with several keys and fixed values on the target; of several rows the first by `order` wins, of equal ones any. A null key finds nothing."""
    for c, v in (fixed or {}).items():
        target = target.where(F.col(c) == F.lit(v))
    keys = [b for _, b in on]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    one = target.withColumn("_n", first).where("_n = 1").select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(keys)], *[F.col(s).alias(d) for s, d in take.items()])
    cond = [left[a] == one[f"_k{i}"] for i, (a, _) in enumerate(on)]
    return left.join(one, cond, "left").drop(*[f"_k{i}" for i in range(len(on))])


def attach_one(left: DataFrame, target: DataFrame, on: tuple[str, str], name: str) -> DataFrame:
    """The target row as a struct, null where there is none."""
    t = target.select(F.col(on[1]).alias("_k"), F.struct(*target.columns).alias(name))
    return left.join(t, left[on[0]] == t["_k"], "left").drop("_k")


def attach_many(left: DataFrame, target: DataFrame, on: tuple[str, str], name: str, fields: list[str], order: str) -> DataFrame:
    """Target rows of each key as an array of structs in `order`; an empty array where there are none."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_v")))), lambda x: x["_v"])
    t = target.groupBy(F.col(on[1]).alias("_k")).agg(items.alias(name))
    out = left.join(t, left[on[0]] == t["_k"], "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def attach_through(left: DataFrame, bridge: DataFrame, target: DataFrame, left_key: tuple[str, str], target_key: tuple[str, str], name: str, fields: list[str], order: str) -> DataFrame:
    """attach_many through a bridge table of pairs, each pair once."""
    pairs = bridge.select(F.col(left_key[1]).alias("_b"), F.col(target_key[0]).alias("_t")).distinct()
    through = pairs.join(target, pairs["_t"] == target[target_key[1]])
    return attach_many(left, through, (left_key[0], "_b"), name, fields, order)


def attach_text(left: DataFrame, target: DataFrame, on: tuple[str, str], value: str, name: str, sep: str = ",") -> DataFrame:
    """Values of each key in their order as one text, "" where there are none."""
    t = target.groupBy(F.col(on[1]).alias("_k")).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name))
    return left.join(t, left[on[0]] == t["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit("")))


def attach_text_through(left: DataFrame, bridge: DataFrame, target: DataFrame, left_key: tuple[str, str], target_key: tuple[str, str], value: str, name: str, sep: str = ",") -> DataFrame:
    """attach_text through a bridge table of pairs, each pair once."""
    pairs = bridge.select(F.col(left_key[1]).alias("_b"), F.col(target_key[0]).alias("_t")).distinct()
    return attach_text(left, pairs.join(target, pairs["_t"] == target[target_key[1]]), (left_key[0], "_b"), value, name, sep)


class Relation(NamedTuple):
    """What a table declares of another: kind is one or many, or through with a bridge (table, its key, its target key)."""

    name: str
    kind: str
    target: DataFrame
    on: tuple[str, str]
    fields: list[str]
    order: str
    bridge: tuple[DataFrame, str, str] | None = None


def check_relations(table: DataFrame, relations: list[Relation]) -> list[str]:
    """What is wrong with the declarations: names given twice or taken, kinds, columns that aren't there, types of keys that differ."""
    found, names = [], set(table.columns)
    for r in relations:
        wrong = [] if r.name not in names else ["name is taken"]
        names.add(r.name)
        wrong += [] if r.kind in ("one", "many", "through") else [f"kind {r.kind}"]
        wrong += [f"no column {c}" for c in [r.on[0]] if c not in table.columns]
        wrong += [f"target has no column {c}" for c in [r.on[1], r.order, *r.fields] if c not in r.target.columns]
        if (r.kind == "through") != (r.bridge is not None):
            wrong.append("a bridge goes with through alone")
        elif r.bridge is not None:
            wrong += [f"bridge has no column {c}" for c in r.bridge[1:] if c not in r.bridge[0].columns]
        elif not wrong and dict(table.dtypes)[r.on[0]] != dict(r.target.dtypes)[r.on[1]]:
            wrong.append("keys differ in type")
        found += [f"{r.name}: {w}" for w in wrong]
    return found


def with_relations(table: DataFrame, relations: list[Relation]) -> DataFrame:
    """The table with all of its declared relations: a struct for one, an array of structs in order for many."""
    if wrong := check_relations(table, relations):
        raise ValueError("; ".join(wrong))
    for r in relations:
        if r.kind == "one":
            table = attach_one(table, r.target.select(r.on[1], *[f for f in r.fields if f != r.on[1]]), r.on, r.name)
        elif r.kind == "many":
            table = attach_many(table, r.target, r.on, r.name, r.fields, r.order)
        else:
            bridge, key, target_key = r.bridge
            table = attach_through(table, bridge, r.target, (r.on[0], key), (target_key, r.on[1]), r.name, r.fields, r.order)
    return table


def attach_map(left: DataFrame, target: DataFrame, on: tuple[str, str], key: str, value: str, name: str) -> DataFrame:
    """Distinct keys of the target with the value of the greatest, as a map."""
    per = target.groupBy(F.col(on[1]).alias("_k"), F.col(key).alias("_mk")).agg(F.max(value).alias("_mv"))
    t = per.groupBy("_k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_mk", "_mv")))).alias(name))
    return left.join(t, left[on[0]] == t["_k"], "left").drop("_k")


def codes_to_names(left: DataFrame, codes: str, target: DataFrame, key: str, value: str, name: str, id_column: str, sep: str = ",") -> DataFrame:
    """A delimited text of codes as the text of their names, in the same order; unknown codes are left out."""
    parts = left.select(F.col(id_column).alias("_id"), F.posexplode(F.split(codes, sep)).alias("_p", "_c"))
    named = parts.join(target, F.trim("_c") == target[key].cast("string")).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_p", F.col(value).alias("_v")))).alias("_l"))
    named = named.select("_id", F.array_join(F.transform("_l", lambda x: x["_v"]), sep).alias(name))
    return left.join(named, left[id_column] == named["_id"], "left").drop("_id")


def having(outer: DataFrame, inner: DataFrame, on: tuple[str, str], found: bool = True) -> DataFrame:
    """EXISTS, or NOT EXISTS if found is false, by equal keys; also IN (sub-query)."""
    keys = inner.select(F.col(on[1]).alias("_k"))
    return outer.join(keys, outer[on[0]] == keys["_k"], "left_semi" if found else "left_anti")


def having_any(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """All rows if the uncorrelated inner query has any, else none."""
    flag = inner.limit(1).agg((F.count("*") > 0).alias("_any"))
    return outer.crossJoin(F.broadcast(flag)).where("_any").drop("_any")  # one row


def snapshot_diff(now: DataFrame, before: DataFrame, key: str, stamp: str, kind: str | None = None) -> DataFrame:
    """CREATE, MODIFY, DELETE per key between two snapshots; a changed kind is DELETE and CREATE. Unchanged keys are left out."""
    n = now.select(F.col(key).alias("k"), F.col(stamp).alias("n_t"), (F.col(kind) if kind else F.lit(0)).alias("n_k"), F.lit(True).alias("n"))
    b = before.select(F.col(key).alias("k"), F.col(stamp).alias("b_t"), (F.col(kind) if kind else F.lit(0)).alias("b_k"), F.lit(True).alias("b"))
    both = n.join(b, "k", "full_outer")
    action = (
        F.when(F.col("b").isNull(), F.array(F.lit("CREATE")))
        .when(F.col("n").isNull(), F.array(F.lit("DELETE")))
        .when(~F.col("n_k").eqNullSafe(F.col("b_k")), F.array(F.lit("DELETE"), F.lit("CREATE")))
        .when(~F.col("n_t").eqNullSafe(F.col("b_t")), F.array(F.lit("MODIFY")))
    )
    return both.select(F.col("k").alias(key), F.explode(action).alias("action"))


def last_per_group(df: DataFrame, group: str, order: str, n: int = 50, most: int = 200) -> DataFrame:
    """The last n rows of each group (at most `most`) by `order`."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= min(n, most)).drop("_n")
