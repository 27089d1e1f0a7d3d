"""Queries that run as streams over a table until all of it is read; their rows are those of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granum.registry import Tables, query
from granum.sources.tables import shared_folder
from granum.streaming import events

C = F.col


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _events(t: Tables):
    return t.stream("events").withColumn("ts", C("ts").cast("timestamp"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 hour, ts)) // 1000 AS hour_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t):
    out = events.windowed(_events(t), "ts", "event_type", "value", "1 hour")
    return events.collected(out, "complete", _folder(t)).select(F.unix_timestamp("start").alias("hour_s"), "event_type", "n")


@query("SELECT event_id, user_id FROM events")
def stream_once(t):
    twice = _events(t).union(_events(t))
    return events.collected(events.once(twice, "event_id", "ts").select("event_id", "user_id"), "append", _folder(t))


@query("SELECT user_id, event_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_owners(t):
    return events.collected(events.path_owners(_events(t), "user_id", "event_id", "ts"), "complete", _folder(t))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def stream_replay(t):
    folder = _folder(t)
    changes = t.stream("events").select("user_id", "event_id", "event_type", "value")
    events.keep_view(changes, f"{folder}/view", "user_id", "event_id", f"{folder}/checkpoint").awaitTermination()
    return events.read_view(t.spark, f"{folder}/view", "event_type", "error").select("user_id", "event_id", "value")


@query("SELECT count(*) AS n FROM part WHERE p_size > 10")
def stream_files(t):
    """A watched folder's rows, by include and exclude patterns on their files' paths."""
    rows = events.watch_files(t.spark, f"{t.folder}/part.parque[t]", t("part").schema, ["**/part*", "**/part.parquet/*"], ["**/*.tmp"])
    return events.collected(rows.where("p_size > 10").select("p_partkey"), "append", _folder(t)).agg(F.count("*").alias("n"))
