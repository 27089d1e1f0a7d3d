"""Declarative entity queries that become one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from granum.functions.predicates import EMBEDDED, WIRE, All, AnyOf, Criterion
from granum.operators.mutate import numbered_rows

DEFAULT_LIMIT, DEFAULT_IDS, DEFAULT_CHUNK, MOST_CHUNK = 100, 1024, 256, 4096


def parse_order(text: str) -> list[tuple[str, bool]]:
    """"age desc, name" as (column, ascending) pairs."""
    parts = [p.split() for p in text.split(",") if p.strip()]
    return [(p[0], len(p) < 2 or p[1].lower() != "desc") for p in parts]


@dataclass
class Query:
    """A query over a table with an id column.

    `where` are criteria that all hold; `any_of` are alternatives of which one must, on top of them. The dialect sets
    how nulls compare and sort: EMBEDDED puts nulls last ascending and first descending, WIRE the other way round.
    """

    where: list[Any] = field(default_factory=list)
    any_of: list[Any] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    dialect: str = EMBEDDED
    id_column: str = "id"
    aliases: dict[str, str] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)

    def add(self, op: str, column: str, a: Any = None, b: Any = None) -> Query:
        self.where.append(Criterion(op, column, a, b))
        return self

    def either(self, *groups: Any) -> Query:
        self.any_of += groups
        return self

    def sort(self, text: str) -> Query:
        self.order += parse_order(text)
        return self

    def select(self, text: str) -> Query:
        """Properties, by commas, that `project` returns; the other calls return whole rows."""
        self.columns += [c.strip() for c in text.split(",") if c.strip()]
        return self

    def merge(self, other: Query, with_order: bool = False) -> Query:
        """Criteria and alternatives of the other query; its order, behind one's own, if asked."""
        self.where += other.where
        self.any_of += other.any_of
        self.order += other.order if with_order else []
        return self

    def resolver(self, df: DataFrame) -> Callable[[str], Column]:
        """Property names as columns; an unknown one is null, or an error in WIRE."""
        known = set(df.columns)

        def resolve(name: str) -> Column:
            name = self.aliases.get(name, name)
            if name in known:
                return F.col(name)
            if self.dialect == WIRE:
                raise ValueError(f"unknown column {name}")
            return F.lit(None)

        return resolve

    def condition(self, df: DataFrame) -> Column:
        return All([*self.where, AnyOf(self.any_of)]).expr(self.dialect, self.resolver(df))

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition(df))

    def ordering(self, df: DataFrame) -> list[Column]:
        up, down = (Column.asc_nulls_last, Column.desc_nulls_first) if self.dialect == EMBEDDED else (Column.asc_nulls_first, Column.desc_nulls_last)
        keys = [(self.aliases.get(n, n), asc) for n, asc in self.order]
        return [(up if asc else down)(F.col(n)) for n, asc in keys if n in df.columns] + [F.col(self.id_column).asc()]

    def find(self, df: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
        """Rows start..end of the ordered result, both included; all of them if neither is positive."""
        out = self.rows(df).orderBy(*self.ordering(df))
        return out if start <= 0 and end <= 0 else out.offset(max(start, 0)).limit(max(end - max(start, 0) + 1, 0))

    def project(self, df: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
        """As find, with the selected properties alone, under their own names; all columns if none is selected."""
        resolve = self.resolver(df)
        return self.find(df, start, end).select(*[resolve(c).alias(c) for c in self.columns] or ["*"])

    def ids(self, df: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
        """Ids of one page; a limit of 0 or less is DEFAULT_LIMIT."""
        page = self.rows(df).orderBy(*self.ordering(df)).offset(max(offset, 0)).limit(limit if limit > 0 else DEFAULT_LIMIT)
        return page.select(self.id_column)

    def one(self, df: DataFrame) -> DataFrame:
        """The match of least id, whatever the order."""
        return self.rows(df).orderBy(self.id_column).limit(1)

    def count(self, df: DataFrame) -> DataFrame:
        return self.rows(df).agg(F.count("*").alias("n"))

    def exists(self, df: DataFrame) -> DataFrame:
        return self.rows(df).limit(1).agg((F.count("*") > 0).alias("found"))

    def chunks(self, df: DataFrame, size: int = 0, limit: int = 0, go_on: Callable[[], bool] = lambda: True) -> Iterator[tuple[list[Row], bool]]:
        """The result in chunks with a flag on the last one; partitions come one after another, never the whole.

        `go_on` is asked before each row; once it says no, what is held is the last chunk.
        """
        size = min(size if size > 0 else DEFAULT_CHUNK, MOST_CHUNK)
        out = self.rows(df)
        out = out.orderBy(*self.ordering(df)) if self.order else out
        out = out.limit(limit) if limit > 0 else out
        held: list[Row] = []
        for row in out.toLocalIterator(prefetchPartitions=True):
            if not go_on():
                break
            if len(held) == size:
                yield held, False
                held = []
            held.append(row)
        yield held, True

    def chunked(self, df: DataFrame, size: int = 0) -> DataFrame:
        """The ordered result with the chunk that each row belongs to, and whether it is the last: for writing from the executors."""
        size = min(size if size > 0 else DEFAULT_CHUNK, MOST_CHUNK)
        numbered = numbered_rows(self.rows(df), self.ordering(df), "_n").withColumn("chunk", F.floor(F.col("_n") / size))
        last = F.broadcast(numbered.agg(F.max("chunk").alias("_last")))  # one row
        return numbered.crossJoin(last).withColumn("completed", F.col("chunk") == F.col("_last")).drop("_n", "_last")


def list_ids(df: DataFrame, id_column: str, offset: int = 0, limit: int = 0) -> DataFrame:
    return df.select(id_column).orderBy(id_column).offset(max(offset, 0)).limit(limit if limit > 0 else DEFAULT_IDS)


def row_exists(df: DataFrame, id_column: str, row_id: Any) -> DataFrame:
    return df.where(F.col(id_column) == F.lit(row_id)).limit(1).agg((F.count("*") > 0).alias("found"))


def get_row(df: DataFrame, id_column: str, row_id: Any, names: list[str] | None = None) -> DataFrame:
    """The row of an id, with the named columns or all."""
    return df.where(F.col(id_column) == F.lit(row_id)).select(*(names or df.columns))


def get_column(df: DataFrame, id_column: str, row_id: Any, name: str) -> DataFrame:
    """One row: whether the id is there, and its value in one column."""
    return df.where(F.col(id_column) == F.lit(row_id)).agg((F.count("*") > 0).alias("found"), F.any_value(name).alias(name))
