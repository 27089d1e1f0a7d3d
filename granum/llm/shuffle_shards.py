"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows lie in buckets (by a hash of their id). For every bucket the numbers of its rows that go to each shard are
drawn without replacement from what the shards still take, so that sizes come out exactly; the rows of a bucket are
permuted and dealt by these counts, and the rows of a shard are permuted again. Every arrangement is then as likely
as in one global shuffle, yet no task ever sees more than a bucket. Equal rows are numbered first, and the number counts
as part of the row: they fall into different buckets, however many there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granum.llm.common import saved


#: Equal rows that one task makes again from their count.
COPIES = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. By the exact ratios of neighbouring probabilities around the mode, for counts of any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    p = good / (good + bad)
    reach = int(14 * (n * p * (1 - p)) ** 0.5) + 30
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    w = np.concatenate(([0.0], np.cumsum(step)))
    w = np.cumsum(np.exp(w - w.max()))
    return int(k[min(np.searchsorted(w, rng.random() * w[-1], side="right"), len(k) - 1)])


def communication_matrix(counts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Per bucket the rows for each shard; row sums are `counts`, column sums are `shards`."""
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in counts:
        row, rest = [], sum(left)
        for s in range(len(left)):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, n - sum(row))
            row.append(k)
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000, least_buckets: int = 1024, most_buckets: int = 65_536) -> DataFrame:
    """Per row: id, size (UTF-8 bytes of the text and 1), text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Row counts of shards differ by one at most; slots run from 0 without gaps in each shard; the order is a uniform
    shuffle fixed by `seed`. A null text counts as empty. A null id is a value like any other. An empty table gives an
    empty result; other columns are ignored.

    Only counts of buckets come to the driver, at most `most_buckets`. Four shuffles carry narrow rows; texts stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Equal rows as one with its count, then as so many again with numbers; a large count is dealt out in parts.
    counted = saved(rows.groupBy(id_col, "size", "text_crc32").agg(F.count("*").alias("n")))
    numbers = lambda low, high: F.explode(F.sequence(low, high)).alias("copy")
    few = counted.where(F.col("n") <= COPIES).select(id_col, "size", "text_crc32", numbers(F.lit(1).cast("long"), F.col("n")))
    many = counted.where(F.col("n") > COPIES).select(id_col, "size", "text_crc32", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    many = many.repartition("part", id_col, "size", "text_crc32").select(id_col, "size", "text_crc32", numbers(F.col("part") * COPIES + 1, F.least(F.col("n"), (F.col("part") + 1) * COPIES)))
    rows = few.union(many)
    total = counted.agg(F.sum("n")).first()[0] or 0
    n = min(max(total // bucket_rows, least_buckets), most_buckets)
    identity = [F.col(id_col), F.col("text_crc32"), F.col("size"), F.col("copy")]
    rows = saved(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(n)).cast("int")))
    counts = rows.groupBy("bucket").count().orderBy("bucket").collect()
    total = sum(c["count"] for c in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([c["count"] for c in counts], sizes, seed)
    ends = [(c["bucket"], [int(x) for x in np.cumsum(row)]) for c, row in zip(counts, matrix)]
    dealt = docs.sparkSession.createDataFrame(ends, "bucket int, ends array<bigint>")

    first = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), *identity), *identity)
    placed = rows.withColumn("at", F.row_number().over(first)).join(dealt, "bucket")
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))).cast("int"))

    # The second permutation: a random part of the shard, and a random order in it. Slots follow from the parts' counts.
    parts = max(n // shards, 1)
    placed = saved(placed.select(id_col, "size", "text_crc32", "copy", "shard", F.pmod(F.xxhash64(F.lit(seed + 2), *identity), F.lit(parts)).cast("int").alias("part")))
    by_part = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    second = Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit(seed + 3), *identity), *identity)
    return (
        placed.withColumn("at", F.row_number().over(second))
        .join(offsets, ["shard", "part"])
        .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
