"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the pivots nearest to it, in order. The inverted list of a pivot holds the vectors that have
it among their first LISTED pivots; a vector looks for others in the list of its very first one. Vectors that meet
there and share enough pivots, counted in bits, are verified by cosine in double precision; no cosine is computed for
others. A pair that meets in two lists belongs to that of the lower pivot, so link counts add up over lists.

Equal vectors are one class of which one goes through the index. Long lists are split into blocks, and each block of
searchers with each block of the list is one piece of work; it returns a count per vector and edges that span the links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum.llm.common import forest, maybe_broadcast, saved, ship, sorted_groups
from granum.llm.components import components

#: Pivots of FEW vectors or fewer; their number grows with the root of the number of vectors, up to MOST_PIVOTS.
PIVOTS, FEW, MOST_PIVOTS = 128, 50_000, 2048
NEAREST, LISTED, SHARED = 12, 6, 4
MOST_ALIKE = 0.8
#: Vectors that pivots are chosen from, for each pivot.
SAMPLE = 16
BLOCK = 4096
BROADCAST_ROWS = 1_000_000


def pivots_for(n: int) -> int:
    """Rows a list, and so pairs a vector, then grow with the root of n."""
    return int(min(max(PIVOTS * (n / FEW) ** 0.5, PIVOTS), MOST_PIVOTS)) // 64 * 64


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the sample's unit vectors, each the one least similar to those before it; none like another, as the order of such pivots tells nothing."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(n, len(sample)) and near.min() < MOST_ALIKE:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Ids of each vector's k nearest pivots, nearest first; equal ones in order of id."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int32)


def units(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pivot_bits(near: np.ndarray) -> np.ndarray:
    """Sets of pivots as bits, 64 to a word."""
    bits = np.zeros((len(near), int(near.max(initial=0)) // 64 + 1), np.uint64)
    for c in near.T:
        bits[np.arange(len(near)), c // 64] |= np.uint64(1) << (c % 64).astype(np.uint64)
    return bits


def _prepare(kind: np.dtype):
    """Rows of (id, label, v): id, label, node (a hash that names the class of label and vector) and the vector's bytes; these null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            n = batch.num_rows
            data: list[bytes | None] = [None] * n
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            named = labels.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == d)
                flat = lists.take(pa.array(rows)).flatten()
                v = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), d)
                v[~flat.is_valid().to_numpy(zero_copy_only=False).reshape(v.shape)] = np.nan
                v = v + kind.type(0)  # one zero only
                ok = np.isfinite(v).all(1) & (v != 0).any(1) & named[rows]
                for i, x in zip(rows[ok], v[ok]):
                    data[i] = x.tobytes()
            node = [xxhash.xxh3_64_intdigest(b, xxhash.xxh3_64_intdigest(f"{len(b)} {x}")) >> 1 if b else None for x, b in zip(labels.to_pylist(), data)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(node, pa.int64()), pa.array(data, pa.binary())], names=["id", "label", "node", "vector"])

    return run


def _index(pivots: np.ndarray, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = pivots.shape[1]
        for batch in batches:
            if batch.num_rows:
                data = batch.column(3).to_pylist()
                fit = np.stack([np.resize(np.frombuffer(b, kind), width) for b in data])  # vectors of another length are listed all the same
                near = nearest_pivots(units(np.where(fit.any(1, keepdims=True), fit, 1)), pivots, NEAREST)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["label", "node", "n", "vector", "near"])

    return run


def _verify(cosine: float, shared: int, kind: np.dtype):
    def make(g: dict[str, np.ndarray]) -> Iterator[tuple]:
        if len(g["node"]) < 2:
            return
        pivot, here = int(g["pivot"][0]), {}
        for d in set(map(len, g["vector"])):  # vectors of different length are never linked
            rows = np.array([i for i, b in enumerate(g["vector"]) if len(b) == d])
            here[d] = rows[np.unique(g["node"][rows], return_index=True)[1]]  # one that searches and is listed in these blocks comes twice
        for rows in here.values():
            node, n, asks, listed = (g[c][rows] for c in ("node", "n", "asks", "listed"))
            twice = np.isin(node, g["node"][g["asks"] & ~g["listed"]]) & np.isin(node, g["node"][g["listed"] & ~g["asks"]])
            asks, listed = asks | twice, listed | twice
            if not asks.any() or len(rows) < 2:
                continue
            near = np.stack(g["near"][rows])
            unit = units(np.frombuffer(b"".join(g["vector"][rows]), kind).reshape(len(rows), -1))
            bits = pivot_bits(near)
            members = np.flatnonzero(listed)
            ok = np.zeros((len(rows), len(rows)), bool)
            for at in range(0, int(asks.sum()), 256):
                mine = np.flatnonzero(asks)[at : at + 256]
                count = np.zeros((len(mine), len(members)), np.uint16)
                for w in range(bits.shape[1]):
                    count += np.bitwise_count(bits[mine, w][:, None] & bits[members, w][None, :])
                i, j = np.nonzero(count >= min(shared, near.shape[1]))
                i, j = mine[i], members[j]
                first = near[j, 0]
                # Both search this list: the lower node's search counts. Else the pair may meet in the list of j's first pivot as well.
                own = np.where(first == pivot, node[i] < node[j], ~((near[i, :LISTED] == first[:, None]).any(1) & (first < pivot)))
                i, j = i[own], j[own]
                for a in range(0, len(i), 1 << 16):
                    x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                    hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    ok[x[hit], y[hit]] = True
            ok |= ok.T
            links = ok @ n.astype(np.int64)
            for i in np.flatnonzero(links):
                yield int(node[i]), None, int(links[i])
            some = np.flatnonzero(links)
            for i, j in forest(len(some), lambda i, js: ok[some[i], some[js]]):
                yield int(node[some[i]]), int(node[some[j]]), 0

    return make


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int | None = None) -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept (id = component_id).

    Vectors are linked if labels are equal and not null and their cosine is at least `cosine`. Null or empty vectors,
    zero vectors and those with a null or non-finite component have no links, nor do rows with a null id or vectors
    of different length. Equal vectors are linked. Each row is a vector of its own in n_links, also where rows repeat
    an id, with the same vector or another. An empty table gives an empty result; other columns are ignored.

    The index is fitted on up to SAMPLE distinct vectors for each of its pivots (pivots_for their number, if not given)
    and holds all. Pairs are found where the first pivot of one is among the first LISTED of the other, and which share
    SHARED of their NEAREST; the recall is measured by the tests. Shuffled: each different vector once to be told apart
    and once for each of its lists, in its own precision.
    """
    ship(vectors.sparkSession)
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    label = F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = saved(rows.mapInArrow(_prepare(kind), "id bigint, label string, node bigint, vector binary"))
    classes = saved(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    wanted = pivots or pivots_for(classes.count())
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE * wanted).select("vector").collect()
    found = [np.frombuffer(x.vector, kind) for x in sample]
    width = max(map(len, found), default=1)
    chosen = choose_pivots(units(np.array([np.resize(x, width) for x in found])), wanted) if found else np.ones((1, 1))

    indexed = saved(classes.select("label", "node", "n", "vector").mapInArrow(_index(chosen, kind), "label string, node bigint, n bigint, vector binary, near array<int>"))
    posted = indexed.select("label", "node", "n", "vector", "near", F.explode(F.slice("near", 1, LISTED)).alias("pivot")).withColumn("asks", F.col("pivot") == F.col("near")[0])
    lists = posted.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("na"), F.count("*").alias("m")).where("m > 1 and na > 0").drop("m")
    work = posted.join(maybe_broadcast(saved(lists), BROADCAST_ROWS), ["label", "pivot"])
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # A list of one block is one piece. In longer ones a vector goes to each block of searchers as listed, and to each block of the list as a searcher.
    listed = F.transform(every("na"), lambda a: F.struct(a.alias("ba"), block("nb").alias("bb"), ((F.col("nb") == 1) & F.col("asks")).alias("asks"), F.lit(True).alias("listed")))
    asking = F.when(F.col("asks") & (F.col("nb") > 1), F.transform(every("nb"), lambda b: F.struct(block("na").alias("ba"), b.alias("bb"), F.lit(True).alias("asks"), F.lit(False).alias("listed"))))
    work = work.withColumn("x", F.explode(F.concat(listed, F.coalesce(asking, F.array().cast(listed_type()))))).select("label", "pivot", "x.ba", "x.bb", "node", "n", "near", "vector", "x.asks", "x.listed")
    found = saved(sorted_groups(work, ["label", "pivot", "ba", "bb"], _verify(cosine, SHARED, kind), "a bigint, b bigint, links bigint"))

    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = saved(components(found.where("b is not null").select("a", "b")))
    reps = joined.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(maybe_broadcast(saved(reps), BROADCAST_ROWS), "component").select("node", "component_id")
    known = classes.select("node", "rep", "n").join(links, "node", "left").join(named, "node", "left").where("n > 1 or links > 0")
    known = saved(known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")))
    out = rows.select("id", "node").join(maybe_broadcast(known, BROADCAST_ROWS), "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def listed_type() -> str:
    return "array<struct<ba:int,bb:int,asks:boolean,listed:boolean>>"
