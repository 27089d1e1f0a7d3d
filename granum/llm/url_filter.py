"""URL rules by a sort-merge range join on reversed hosts.

The host `a.b.c` has the key `c.b.a.`; a rule for `b.c` and all below it is then the interval of keys from `c.b.`
up to `c.b/`, as "/" follows "." in code order. Intervals of rules nest or are disjoint. Distinct hosts and rules are
dealt by ranges of keys, a rule to every range that its interval touches; each range is sorted and swept once with a
stack of the rules that are open. What depends on the page's path is then decided on the page's own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: on up to "?", "#" or the end.

    Both are empty for null or without "://".
    """
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (pid, key, hi, host, path, rule, verdict), sorted: rules have hi, hosts have not. Yields hosts with open rules."""
    item = pa.list_(pa.struct([("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())]))
    stack: list[tuple[str, dict]] = []
    at = None
    for batch in batches:
        hosts, active = [], []
        for x in batch.to_pylist():
            if x["pid"] != at:
                at, stack = x["pid"], []
            key = x["key"].encode()
            while stack and key >= stack[-1][0]:
                stack.pop()
            if x["hi"] is not None:
                stack.append((x["hi"].encode(), {k: x[k] for k in ("path", "rule", "verdict")}))
            elif stack:
                hosts.append(x["host"])
                active.append([r for _, r in stack])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(active, item)], names=["host", "active"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", sample: int = 4000) -> DataFrame:
    """Per page: id, host, path, rule (null if none fits), verdict (of the longest rule that fits, else `default`).

    `rules` has the columns rule, such as `example.com/en/`, and verdict. A rule fits its host and all subdomains if
    the path starts with the rule's path, from its first "/" on. Of equally long rules that fit the larger verdict in
    text order wins. Null rules are ignored. A null or malformed url has an empty host, which no rule fits. Repeated
    rows give repeated results; other columns are ignored; empty tables give every page the default, or no row.

    Ranges are cut at quantiles of up to `sample` hosts, which steers balance only. A host with any number of pages
    is swept once. The rules that are open at one host are held together.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    hosts = rows.select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    first = F.regexp_extract("rule", r"(?s)^[^/]*", 0)
    r = rules.where("rule is not null and verdict is not null").select(
        host_key(F.translate(first, UPPER, LOWER)).alias("key"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"), "rule", "verdict"
    )
    r = r.where("key <> '.'").distinct().withColumn("hi", F.expr("concat(substring(key, 1, length(key) - 1), '/')"))
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = sorted((x.key for x in hosts.orderBy(F.xxhash64("key"), "key").limit(sample).select("key").collect()), key=str.encode)
    cuts = F.array(*[F.lit(k) for k in sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)} if keys else set())]).cast("array<string>")

    def cuts_up_to(c: Column, strict: bool) -> Column:
        return F.size(F.filter(cuts, lambda b: (b < c) if strict else (b <= c)))

    columns = ["pid", "key", "hi", "host", "path", "rule", "verdict"]
    none = F.lit(None).cast("string")
    opened = r.withColumn("pid", F.explode(F.sequence(cuts_up_to(F.col("key"), False), F.greatest(cuts_up_to(F.col("key"), False), cuts_up_to(F.col("hi"), True))))).withColumn("host", none)
    asked = hosts.select(cuts_up_to(F.col("key"), False).alias("pid"), "key", none.alias("hi"), "host", none.alias("path"), none.alias("rule"), none.alias("verdict"))
    both = opened.select(columns).union(asked.select(columns))
    swept = both.repartition("pid").sortWithinPartitions("pid", "key", F.col("hi").asc_nulls_last(), "rule").mapInArrow(_sweep, "host string, active array<struct<path:string,rule:string,verdict:string>>")
    fits = F.filter("active", lambda a: F.startswith(F.col("path"), a["path"]))
    best = F.array_max(F.transform(fits, lambda a: F.struct(F.length(a["rule"]).alias("n"), a["verdict"].alias("verdict"), a["rule"].alias("rule"))))
    return rows.join(swept, "host", "left").withColumn("best", best).select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
