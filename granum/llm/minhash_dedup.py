"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct word shingles, as 64-bit hashes. Documents with equal sets form a class, and one
of each class goes on. Its minima under `bands * rows` hash functions give band keys; of each minimum only the lowest
two bits are kept, as two packed bit planes. Within a bucket of equal band keys the bit counts of the differing
planes estimate the similarity, corrected for chance collisions, and pairs far below the threshold are put aside.
What remains falls into groups; within each group the full sets decide.

At similarity 0.8 a pair misses all 48 bands of 6 rows with probability (1 - 0.8^6)^48 < 5e-7, and the estimate's
margin is six standard deviations. Large buckets are split into blocks, and every pair of blocks is one piece of work;
each returns edges that span what it found, never all pairs. In large groups members are held against one centre first,
and only those that aren't linked with it against all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import fewer_than, forest, maybe_broadcast, saved, ship, sorted_groups
from granum.llm.components import components

BANDS, ROWS = 48, 6
HASHES = BANDS * ROWS
BLOCK = 1024
BLOCK_SHINGLES = 500_000
BROADCAST_ROWS = 1_000_000
_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_C = (_rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(BANDS, ROWS)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P3
    x = (x ^ (x >> np.uint64(29))) * _P1
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's `width`-word shingles; with fewer words the whole sequence is one; none without words.

    A-Z are lower-cased; words are split at the six ASCII white-space characters, as bytes.split does.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _P2 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """32-bit minima of a set under all hash functions."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (np.multiply.outer(s[i : i + 512], _A) + _B).min(0), out=low)
    return low >> np.uint64(32)


def signature(m: np.ndarray) -> bytes:
    """The two lowest bits of each minimum: the plane of low bits, then that of high ones."""
    return np.packbits((m & np.uint64(1)).astype(bool)).tobytes() + np.packbits((m & np.uint64(2)).astype(bool)).tobytes()


def band_keys(m: np.ndarray) -> np.ndarray:
    return _mix((m.reshape(BANDS, ROWS) * _C).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(planes: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Similarity of i with each of js: shares of equal two-bit values, corrected for the quarter that agree by chance."""
    x = planes[js] ^ planes[i]
    half = x.shape[1] // 2
    differ = np.bitwise_count(x[:, :half] | x[:, half:]).sum(1)
    return (1 - differ / HASHES - 0.25) / 0.75


def least_estimate(threshold: float) -> float:
    equal = threshold + (1 - threshold) / 4
    return threshold - 6 * (equal * (1 - equal) / HASHES) ** 0.5 / 0.75


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                n, keys, sigs, bands = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t, width)
                    n.append(len(s))
                    if len(s):
                        m = minima(s)
                        keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                        sigs.append(signature(m))
                        bands.append(band_keys(m))
                    else:
                        keys.append(None), sigs.append(None), bands.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "sig", "bands"])

    return run


def block_pairs(df: DataFrame, blocks: Column, item: Column) -> DataFrame:
    """df with the columns bi <= bj, a row for each piece of work that needs the item: all pairs of blocks with its own, or (0, 0) for one block."""
    b = df.withColumn("_nb", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_nb")).cast("int"))
    b = b.withColumn("_o", F.explode(F.when(F.col("_nb") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_nb") - 1), lambda o: o != F.col("_b")))))
    return b.select(*df.columns, F.least("_b", "_o").cast("int").alias("bi"), F.greatest("_b", "_o").cast("int").alias("bj"))


def _bucket_edges(threshold: float):
    least = least_estimate(threshold)

    def make(g: dict[str, np.ndarray]) -> Iterator[tuple]:
        ids = g["rep"]
        if len(ids) > 1:
            planes = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(ids), -1)
            for i, j in forest(len(ids), lambda i, js: estimate(planes, i, js) >= least):
                yield int(ids[i]), int(ids[j])

    return make


def linker(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function (i, js) that tells with which of the sets js the set i is linked."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)

    def linked(i: int, js: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(js), bool)
        near = np.flatnonzero(100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))
        if near.size:
            mine = flat[starts[i] : starts[i + 1]]
            mark[mine] = True
            common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in js[near]])
            mark[mine] = False
            ok[near] = 100 * common >= percent * (sizes[i] + sizes[js[near]] - common)
        return ok

    return linked


def _of_group(g: dict[str, np.ndarray], rows: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = np.arange(len(g["rep"])) if rows is None else rows
    return g["rep"][rows], [np.frombuffer(b, np.uint64) for b in g["set"][rows]]


def _verified_edges(percent: int):
    """Groups that one task holds: edges that span their links."""

    def make(g: dict[str, np.ndarray]) -> Iterator[tuple]:
        ids, sets = _of_group(g)
        if len(ids) > 1:
            for i, j in forest(len(ids), linker(sets, percent)):
                yield int(ids[i]), int(ids[j])

    return make


def _star_edges(percent: int):
    """A part of a large group with the group's centre: each member with the centre if they are linked, else with null."""

    def make(g: dict[str, np.ndarray]) -> Iterator[tuple]:
        order = np.argsort(~g["centre"], kind="stable")
        ids, sets = _of_group(g, order)
        near = linker(sets, percent)(0, np.arange(1, len(ids))) if len(ids) > 1 else []
        yield from ((int(i), int(ids[0]) if ok else None) for i, ok in zip(ids[1:], near))

    return make


def _rest_edges(percent: int):
    """A block of a large group's rest with a block of its members: edges that span the links of the rest; what is linked with the centre is connected already."""

    def make(g: dict[str, np.ndarray]) -> Iterator[tuple]:
        asks = {int(r) for r, a in zip(g["rep"], g["asks"]) if a}
        rows = np.array(list({(int(r), s): i for i, (r, s) in enumerate(zip(g["rep"], g["set"]))}.values()))  # one that asks may be a member of the block as well
        rows = rows[np.argsort([int(r) not in asks for r in g["rep"][rows]], kind="stable")]
        ids, sets = _of_group(g, rows)
        if asks and len(ids) > 1:
            label = np.arange(len(ids))
            label[~g["rest"][rows]] = len(ids)
            for i, j in forest(len(ids), linker(sets, percent), label, sum(int(r) in asks for r in ids)):
                yield int(ids[i]), int(ids[j])

    return make


def _large_groups(filled: DataFrame, percent: int) -> DataFrame:
    """Edges of groups of more than one block, from their rows (rep, component, nb, set).

    Every member is held against one centre, in parts with a copy of the centre each. Those linked with it are
    connected; only the rest is then held against all members, block by block. No two members that are linked with the
    centre are ever compared, so a large group of copies of one text costs as much as it has rows.
    """
    filled = saved(filled)
    centres = filled.groupBy("component").agg(F.min_by("rep", F.xxhash64("rep")).alias("c"))
    marked = filled.join(maybe_broadcast(saved(centres), BROADCAST_ROWS), "component").withColumn("centre", F.col("rep") == F.col("c"))
    parts = F.when(F.col("centre"), F.sequence(F.lit(0), (F.col("nb") - 1).cast("int"))).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")))
    star = saved(sorted_groups(marked.select("component", F.explode(parts).alias("part"), "rep", "centre", "set"), ["component", "part"], _star_edges(percent), "a bigint, b bigint"))
    rest = saved(star.where("b is null").select(F.col("a").alias("rep"), F.lit(True).alias("rest")))
    edges = star.where("b is not null")
    if rest.isEmpty():
        return edges
    rows = filled.join(maybe_broadcast(rest, BROADCAST_ROWS), "rep", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
    weights = rows.where("rest").groupBy("component").agg(F.ceil(F.sum(F.length("set")) / (8 * BLOCK_SHINGLES)).alias("nr"))
    rows = rows.join(maybe_broadcast(saved(weights), BROADCAST_ROWS), "component")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    piece = lambda a, b, asks: F.struct(a.cast("int").alias("ba"), b.cast("int").alias("bb"), F.lit(asks).alias("asks"))
    member = F.transform(to("nr"), lambda a: piece(a, block("nb"), False))
    asking = F.when(F.col("rest"), F.transform(to("nb"), lambda b: piece(block("nr"), b, True)))
    work = rows.withColumn("x", F.explode(F.when(F.col("rest"), F.concat(member, asking)).otherwise(member))).select("component", "x.ba", "x.bb", "rep", "x.asks", "rest", "set")
    return edges.union(sorted_groups(work, ["component", "ba", "bb"], _rest_edges(percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, its own included), kept (id = component_id).

    Two documents are linked if 100 * shared shingles >= percent * shingles of both together, decided on full sets.
    A text without words, or null, has no shingles and no links. Rows with a null id take no part and are kept, their
    component_id null. Rows that repeat an id are one document in the links and get the same component. An empty
    table gives an empty result; other columns are ignored.

    Shuffled: 16 bytes a band and class; signatures of documents in shared buckets; sets of documents in a group. The
    ids of those are broadcast only under BROADCAST_ROWS rows, and joined by a shuffle beyond.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = saved(texts.mapInArrow(_features(width), "id bigint, n_shingles bigint, set_key binary, sig binary, bands array<bigint>"))
    whole = feats.where("id is not null and set_key is not null")
    classes = saved(whole.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    reps = saved(whole.select("id", "set_key", "sig", "bands", "n_shingles").join(classes.select("set_key", F.col("rep").alias("id")), ["set_key", "id"]).dropDuplicates(["set_key"]).select(F.col("id").alias("rep"), "sig", "bands", "n_shingles"))

    # Buckets of two or more; of buckets with the same members one will do.
    keyed = reps.select("rep", F.explode("bands").alias("bucket"))
    h = F.xxhash64("rep")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 8)).alias("s"), F.min("rep").alias("low")).where("n > 1")
    buckets = saved(shared.groupBy("n", "x", "s", "low").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    members = keyed.join(maybe_broadcast(buckets, BROADCAST_ROWS), "bucket")
    members = members.join(reps.select("rep", "sig"), "rep")
    work = block_pairs(members.select("bucket", "rep", "sig", "n"), F.ceil(F.col("n") / BLOCK), F.col("rep")).drop("n")
    coarse = components(sorted_groups(work, ["bucket", "bi", "bj"], _bucket_edges(percent / 100), "a bigint, b bigint"))

    # The full sets of each group, in blocks of bounded size.
    grouped = saved(coarse.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node"))
    sizes = grouped.groupBy("component").agg(F.sum("n_shingles").alias("weight"))
    large = saved(sizes.where(F.col("weight") > BLOCK_SHINGLES).select("component", F.ceil(F.col("weight") / BLOCK_SHINGLES).alias("nb")))  # at most all shingles / BLOCK_SHINGLES
    grouped = saved(grouped.join(maybe_broadcast(large, BROADCAST_ROWS), "component", "left").select(F.col("node").alias("id"), "component", F.coalesce("nb", F.lit(1)).alias("nb")))
    few = fewer_than(grouped, BROADCAST_ROWS)
    asked = texts.join(F.broadcast(grouped) if few else grouped, "id").select(F.col("id").alias("rep"), "component", "nb", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = pa.array([shingles(t, width).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], full], names=["rep", "component", "nb", "set"])

    def filled(groups: str) -> DataFrame:
        return asked.where(groups).mapInArrow(sets, "rep bigint, component bigint, nb bigint, set binary")

    # A group that one task holds comes in one piece; of larger ones the full sets are stored.
    edges = sorted_groups(filled("nb = 1").select("component", "rep", "set"), ["component"], _verified_edges(percent), "a bigint, b bigint")
    if not large.isEmpty():
        edges = edges.union(_large_groups(filled("nb > 1"), percent))
    links = components(edges)

    # Only rows that share a set or a link look anything up.
    several = maybe_broadcast(classes.where("n > 1").select("set_key", "rep"), BROADCAST_ROWS)
    links = maybe_broadcast(saved(links.withColumnRenamed("node", "rep")), BROADCAST_ROWS)
    out = feats.select("id", "n_shingles", "set_key").join(several, "set_key", "left")
    out = out.withColumn("rep", F.coalesce("rep", F.when(F.col("set_key").isNotNull(), F.col("id")))).join(links, "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
