"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granum.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Reads the tables of a folder: t("orders") as a table, t.stream("events") as a stream of the same rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def stream(self, name: str) -> DataFrame:
        # A stream takes a folder or a pattern: this one fits the table, be it a file or a folder.
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.folder}/{name}.parque[t]")


def query(sql: str):
    """Register a function of a table reader under its name, with DuckDB SQL for its rows."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = sql
        return f

    return add
