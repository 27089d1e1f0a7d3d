"""The streaming forms: windowed metrics, idempotent receipt, replay into a keyed view, file watching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from granum.functions.strings import path_passes


def watch_files(spark: SparkSession, folder: str, schema: StructType, include: list[str] | None = None, exclude: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream, by glob: excludes first, an empty include list accepts all."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder).withColumn("path", F.input_file_name())
    return rows.where(path_passes(F.col("path"), include or [], exclude or []))


def windowed(events: DataFrame, at: str, key: str, value: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key in windows of event time; rows later than `late` are left out."""
    w = F.window(at, length, slide or length)
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def once(events: DataFrame, event_id: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])


def into_view(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Batches of a change stream handed to `apply`, each exactly as often as the sink's own idempotence allows; stops when the input is read."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_view(changes: DataFrame, folder: str, key: str, sequence: str, checkpoint: str) -> StreamingQuery:
    """The last entry of each key, kept as Parquet in `folder`: a version for each batch, made of the one before and the batch.

    A batch that is run again writes the same version again. Removals stay as entries, so that a late entry of a lower
    sequence can't bring a key back; read_view leaves them out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = _version(batch.sparkSession, folder, number - 1)
        rows = batch if before is None else before.unionByName(batch)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), sequence).alias("_x"))
        last.select(key, "_x.*").write.mode("overwrite").parquet(f"{folder}/v{number}")

    return into_view(changes, apply, checkpoint)


def _version(spark: SparkSession, folder: str, most: int) -> DataFrame | None:
    """The latest version of a view up to `most`."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(n[1:]) for n in names if n[1:].isdigit() and int(n[1:]) <= most]
    return spark.read.parquet(f"{folder}/v{max(numbers)}") if numbers else None


def read_view(spark: SparkSession, folder: str, op: str, removed: str) -> DataFrame | None:
    """A kept view without the keys whose last entry removes them; None before the first batch."""
    found = _version(spark, folder, 1 << 62)
    return None if found is None else found.where(F.col(op) != removed)


def collected(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """What a stream gives for all that is there, as a table: its appended rows, or its complete result."""
    how = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{folder}/rows"))
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def live_view(puts: DataFrame, key: str, at: str, value: str, ttl: str, late: str = "10 minutes") -> DataFrame:
    """The last put of each key (text key, double value) while it lives, as a stream of key, value, expires: a null value says that the key has expired.

    `ttl` is in seconds; a key without an end has a negative one. Time is event time, so a key expires when the
    watermark has passed its end.
    """
    from collections.abc import Iterator as It

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, parts: It[pd.DataFrame], state: GroupState) -> It[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, end = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "value": [None], "expires": [pd.Timestamp(end, unit="ms")]}).astype({"value": "float64"})
            return
        newest, held, end = state.get if state.exists else (-1, None, -1)
        for part in parts:
            last = part.sort_values([at, value]).iloc[-1]
            ms = int(last[at].timestamp() * 1000)
            if ms >= newest:
                newest, held, end = ms, float(last[value]), -1 if last[ttl] < 0 else ms + 1000 * int(last[ttl])
        state.update((newest, held, end))
        if 0 <= end <= state.getCurrentWatermarkMs():
            state.remove()
            held = None
        elif end >= 0:
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({key: [k[0]], "value": [held], "expires": [pd.Timestamp(end, unit="ms") if end >= 0 else pd.NaT]}).astype({"value": "float64"})

    schema = f"{key} string, value double, expires timestamp"
    rows = puts.withWatermark(at, late).select(F.col(key).cast("string").alias(key), at, F.col(value).cast("double").alias(value), F.col(ttl).cast("long").alias(ttl))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "newest long, value double, expires long", "append", GroupStateTimeout.EventTimeTimeout)


def path_owners(events: DataFrame, path: str, event: str, at: str, late: str = "5 minutes") -> DataFrame:
    """Who holds each path, as a view that streams update: the event of newest time, of equal ones the later id."""
    return events.withWatermark(at, late).groupBy(path).agg(F.max_by(event, F.struct(at, event)).alias("owner"))


def stop_tagged(spark: SparkSession, tag: str) -> list[str]:
    """Cancel the running work of this session that bears a tag (spark.addTag); asking again does no harm."""
    return spark.interruptTag(tag)
