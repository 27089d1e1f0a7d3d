"""What the operators of this subpackage share: tables, checkpoints, grouped streams of sorted rows."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
#: The same six characters, for translate().
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: their Python may not have the driver's path."""
    sc = spark.sparkContext
    if getattr(sc, "_granum_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="granum-"), "granum_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("granum", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._granum_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    Only in local mode, where there is one machine, a temporary one is made if it is unset; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local-cluster") and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="granum-checkpoint-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fewer_than(df: DataFrame, limit: int) -> bool:
    """Whether df has under `limit` rows; what decides if a side may be broadcast."""
    return df.limit(limit).count() < limit


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint if it has under `limit` rows; beyond that Spark's shuffled join is used."""
    return F.broadcast(df) if fewer_than(df, limit) else df


def held(columns: list[str], name: str = "_doc") -> Column:
    """A row's own columns as one struct, so that an operator's columns can bear any names beside them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)


def freed(columns: list[str], new: list[str], name: str = "_doc") -> list[Column]:
    """The columns that `held` put away; one that bears the name of a `new` one gives way to it."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns if c.lower() not in {n.lower() for n in new}]


def sorted_groups(df: DataFrame, keys: list[str], make: Callable[[dict[str, np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """Call `make` with the columns of each group of equal keys and return the rows that it yields.

    Rows are dealt by the keys and sorted within partitions, so that many small groups cost one Arrow stream
    instead of one Python call with a data frame each. Groups must be of bounded size: callers split large ones.
    """
    names = df.columns
    out = pa.schema([pa.field(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)
                rows.clear()

        def groups(t: pa.Table, last: bool):
            cols = {n: (t[n].to_numpy() if pa.types.is_primitive(t[n].type) else np.array(t[n].to_pylist() + [None], dtype=object)[:-1]) for n in names}
            new = np.zeros(len(t), bool)
            new[:1] = True
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            starts = np.append(np.flatnonzero(new), len(t))
            for a, b in zip(starts[:-1], starts[1:] if last else starts[1:-1]):
                yield {n: c[a:b] for n, c in cols.items()}
            if not last:
                yield int(starts[-2])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            t = pa.concat_tables([rest, t]) if rest is not None else t
            for g in groups(t, False):
                if isinstance(g, int):
                    rest = t.slice(g)
                else:
                    rows.extend(make(g))
                    if len(rows) > 20_000:
                        yield from flush()
        if rest is not None:
            for g in groups(rest, True):
                rows.extend(make(g))
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray | None = None, asks: int | None = None) -> list[tuple[int, int]]:
    """Edges that span the components of 0..n-1, where linked(i, js) tells which of js are linked with i.

    Pairs whose ends are known to be connected are not asked for; all others are, so the components are exact
    while the output stays below n edges. Equal values in `label` say what is connected beforehand; with `asks` only
    pairs that hold one of the first so many are asked for.
    """
    label, edges = np.arange(n) if label is None else label.copy(), []
    for i in range(min(n - 1, n if asks is None else asks)):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not others.size:
            continue
        hit = others[linked(i, others)]
        if hit.size:
            labels, first = np.unique(label[hit], return_index=True)
            edges += [(i, int(hit[f])) for f in first]
            label[np.isin(label, labels)] = label[i]
            if (label == label[0]).all():
                break
    return edges


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a folder of its own under the shared folder, read again."""
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], object]]:
    """As written, with a function that deletes the table. Unlike a checkpoint's, its size is known from its files: in a loop
    of joins Spark's estimates for checkpoints grow as powers of each other."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
