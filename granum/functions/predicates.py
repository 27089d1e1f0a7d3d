"""Typed predicates in two null semantics, and condition maps.

`EMBEDDED` treats null like a value of its own: NE, LT, LE and NOT_IN are true for a null field, and EQ matches null
with null. `WIRE` is SQL's way: a null field fails all but IS_NULL, and nulls in lists are dropped. LIKE_LEFT is a
prefix match in EMBEDDED and a suffix match in WIRE, LIKE_RIGHT the other way round. LIKE takes no wildcards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBEDDED, WIRE = "embedded", "wire"
OPERATORS = ["EQ", "NE", "GT", "GE", "LT", "LE", "LIKE", "LIKE_LEFT", "LIKE_RIGHT", "BETWEEN", "IN", "NOT_IN", "IS_NULL", "IS_NOT_NULL"]
#: Names of columns that stand for several others begin so.
COMPOSITE = "@composite:"
Resolve = Callable[[str], Column]


class Criterion(NamedTuple):
    """op on a column with up to two operands; for IN and NOT_IN `a` is a list."""

    op: str
    column: str
    a: Any = None
    b: Any = None

    def expr(self, dialect: str = EMBEDDED, resolve: Resolve = F.col) -> Column:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")
        if dialect == WIRE and self.column.startswith(COMPOSITE):
            raise ValueError(f"{self.column} is a composite column, which no predicate reads")
        if dialect == WIRE and (self.op in OPERATORS[:9] and self.a is None or self.op == "BETWEEN" and None in (self.a, self.b)):
            raise ValueError(f"{self.op} needs an operand that isn't null")
        c = resolve(self.column)
        return (_embedded if dialect == EMBEDDED else _wire)(self.op, c, self.a, self.b)


class Exists(NamedTuple):
    """Whether the inner table has a row, with equal keys (outer, inner) if `on` is given; NOT EXISTS if found is false.

    It can stand anywhere in a tree of criteria; Spark plans it as a semi, anti or existence join.
    """

    inner: DataFrame
    on: tuple[str, str] | None = None
    found: bool = True

    def expr(self, dialect: str = EMBEDDED, resolve: Resolve = F.col) -> Column:
        inner = self.inner if self.on is None else self.inner.where(F.col(self.on[1]) == F.col(self.on[0]).outer())
        return inner.exists() if self.found else ~inner.exists()


def in_rows(column: str, inner: DataFrame, key: str, found: bool = True) -> Exists:
    """IN (sub-query), or NOT IN; nulls among the inner values are equal to nothing."""
    return Exists(inner, (column, key), found)


class All(NamedTuple):
    """All of the parts; an empty list holds for every row."""

    parts: Sequence[Any]

    def expr(self, dialect: str = EMBEDDED, resolve: Resolve = F.col) -> Column:
        return reduce(lambda x, y: x & y, (p.expr(dialect, resolve) for p in self.parts), F.lit(True))


class AnyOf(NamedTuple):
    """At least one of the parts; an empty list puts no condition."""

    parts: Sequence[Any]

    def expr(self, dialect: str = EMBEDDED, resolve: Resolve = F.col) -> Column:
        parts = [p.expr(dialect, resolve) for p in self.parts]
        return reduce(lambda x, y: x | y, parts) if parts else F.lit(True)


def _values(v: Any) -> list[Any]:
    return list(v) if isinstance(v, Iterable) and not isinstance(v, (str, bytes)) else [v]


def _in(c: Column, values: Any) -> tuple[Column, bool]:
    found = [v for v in _values(values) if v is not None]
    return F.coalesce(c.isin(found), F.lit(False)) if found else F.lit(False), len(found) < len(_values(values))


def _embedded(op: str, c: Column, a: Any, b: Any) -> Column:
    text = lambda: c.cast("string")
    if op in ("GT", "GE", "LT", "LE") and a is None:
        return c.isNotNull() if op in ("GT", "GE") else c.isNull()
    if op == "IN":
        hit, has_null = _in(c, a)
        return hit | c.isNull() if has_null else hit
    if op == "NOT_IN":
        hit, has_null = _in(c, a)
        return ~hit & c.isNotNull() if has_null else ~hit
    table: dict[str, Callable[[], Column]] = {
        "EQ": lambda: c.eqNullSafe(F.lit(a)),
        "NE": lambda: ~c.eqNullSafe(F.lit(a)),
        "GT": lambda: F.coalesce(c > F.lit(a), F.lit(False)),
        "GE": lambda: F.coalesce(c >= F.lit(a), F.lit(False)),
        "LT": lambda: c.isNull() | (c < F.lit(a)),
        "LE": lambda: c.isNull() | (c <= F.lit(a)),
        "BETWEEN": lambda: F.coalesce(c.between(F.lit(a), F.lit(b)), F.lit(False)),
        "LIKE": lambda: F.coalesce(F.contains(text(), F.lit(str(a))), F.lit(False)),
        "LIKE_LEFT": lambda: F.coalesce(F.startswith(text(), F.lit(str(a))), F.lit(False)),
        "LIKE_RIGHT": lambda: F.coalesce(F.endswith(text(), F.lit(str(a))), F.lit(False)),
        "IS_NULL": c.isNull,
        "IS_NOT_NULL": c.isNotNull,
    }
    return table[op]()


def _wire(op: str, c: Column, a: Any, b: Any) -> Column:
    if op == "IN":
        return _in(c, a)[0]
    if op == "NOT_IN":
        return c.isNotNull() & ~_in(c, a)[0]
    table: dict[str, Callable[[], Column]] = {
        "EQ": lambda: c == F.lit(a),
        "NE": lambda: c != F.lit(a),
        "GT": lambda: c > F.lit(a),
        "GE": lambda: c >= F.lit(a),
        "LT": lambda: c < F.lit(a),
        "LE": lambda: c <= F.lit(a),
        "BETWEEN": lambda: c.between(F.lit(a), F.lit(b)),
        "LIKE": lambda: F.contains(c, F.lit(a)),
        "LIKE_LEFT": lambda: F.endswith(c, F.lit(a)),
        "LIKE_RIGHT": lambda: F.startswith(c, F.lit(a)),
        "IS_NULL": c.isNull,
        "IS_NOT_NULL": c.isNotNull,
    }
    return F.coalesce(table[op](), F.lit(False))


SUFFIXES = {"_Gt": "GT", "_Lt": "LT", "_Ge": "GE", "_Le": "LE", "_Start": "GE", "_End": "LE", "_Like": "LIKE", "_LikeLeft": "LIKE_LEFT", "_LikeRight": "LIKE_RIGHT"}
KM_PER_DEGREE = 111.0


def conditions(spec: dict[str, Any], columns: Sequence[str]) -> All:
    """A condition map as criteria.

    `prop` is equality and `prop_NotEq` inequality; either ends what is read of that property. Others: _Like,
    _LikeLeft, _LikeRight, _In and _NotIn (a list, or text of comma-separated whole numbers), _Start, _End, _Gt, _Lt,
    _Ge, _Le, _Fuzzy (a prefix of yyyyMMddHHmmss: the whole span it names). isNullProps and isNotNullProps list
    properties by commas. lon, lat and geoSearchRadius (km) give a bounding box; lon, lat and geoHashLength the rows
    whose geo_code begins with the geohash of that length.
    """
    from granum.functions.bits import bounding_box, geohash_text
    from granum.functions.dates import fuzzy_span

    out: list[Criterion] = []
    numbers = lambda v: [int(x) for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v)
    near = {"lon", "lat"} if "geoSearchRadius" in spec or "geoHashLength" in spec else set()
    for p in columns:
        if p in near:
            continue
        if p in spec:
            out.append(Criterion("EQ", p, spec[p]))
            continue
        if f"{p}_NotEq" in spec:
            out.append(Criterion("NE", p, spec[f"{p}_NotEq"]))
            continue
        out += [Criterion(op, p, spec[p + s]) for s, op in SUFFIXES.items() if p + s in spec]
        out += [Criterion(op, p, numbers(spec[p + s])) for s, op in (("_In", "IN"), ("_NotIn", "NOT_IN")) if p + s in spec]
        if f"{p}_Fuzzy" in spec:
            out.append(Criterion("BETWEEN", p, *fuzzy_span(spec[f"{p}_Fuzzy"])))
    for key, op in (("isNullProps", "IS_NULL"), ("isNotNullProps", "IS_NOT_NULL")):
        out += [Criterion(op, p.strip()) for p in spec.get(key, "").split(",") if p.strip()]
    if "geoSearchRadius" in spec:
        west, east, south, north = bounding_box(float(spec["lon"]), float(spec["lat"]), float(spec["geoSearchRadius"]))
        out += [Criterion("BETWEEN", "lon", west, east), Criterion("BETWEEN", "lat", south, north)]
    if "geoHashLength" in spec:
        out.append(Criterion("LIKE_LEFT", "geo_code", geohash_text(float(spec["lon"]), float(spec["lat"]), int(spec["geoHashLength"]))))
    return All(out)


def positional(props: str, values: Sequence[Any]) -> All:
    """Comma-separated properties with their values in order: null asks IS_NULL, a list IN, others EQ."""
    names = [p.strip() for p in props.split(",")]
    if len(names) != len(values):
        raise ValueError(f"{len(names)} properties, {len(values)} values")
    return All([Criterion("IS_NULL", n) if v is None else Criterion("IN", n, v) if isinstance(v, (list, tuple, set)) else Criterion("EQ", n, v) for n, v in zip(names, values)])


class ConditionMap(dict):
    """A condition map made step by step: `where("age", "Ge", 18).where("name", "", "x").missing("note")`."""

    def where(self, prop: str, kind: str, value: Any) -> ConditionMap:
        self[f"{prop}_{kind}" if kind else prop] = value
        return self

    def missing(self, *props: str) -> ConditionMap:
        self["isNullProps"] = ",".join([*filter(None, [self.get("isNullProps")]), *props])
        return self

    def present(self, *props: str) -> ConditionMap:
        self["isNotNullProps"] = ",".join([*filter(None, [self.get("isNotNullProps")]), *props])
        return self
