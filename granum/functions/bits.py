"""Bit fields, packed and taken apart, and geohashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def bit_field(c: Column, start: int, end: int) -> Column:
    """Bits start..end, both included, as a number."""
    return F.shiftright(c, start).bitwiseAND(F.lit((1 << (end - start + 1)) - 1))


def pack_fields(fields: list[tuple[Column, int, int]]) -> Column:
    """Values put at bits start..end of one long; null counts as 0 and higher bits are cut off."""
    parts = [F.shiftleft(F.coalesce(c.cast("long"), F.lit(0)).bitwiseAND(F.lit((1 << (e - s + 1)) - 1)), s) for c, s, e in fields]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def set_bit(c: Column, bit: int, on: bool = True) -> Column:
    return c.bitwiseOR(F.lit(1 << bit)) if on else c.bitwiseAND(F.lit(~(1 << bit)))


def geohash(lon: Column, lat: Column, length: int) -> Column:
    """Bits of the two coordinates' places in their ranges, longitude first, five to a digit."""
    bits = 5 * length
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    place = lambda x, low, span, n: F.least(F.floor((x - low) / span * (1 << n)), F.lit((1 << n) - 1)).cast("long")
    x, y = place(lon, -180.0, 360.0, n_lon), place(lat, -90.0, 180.0, n_lat)
    digits = []
    for d in range(length):
        value = F.lit(0)
        for k in range(5 * d, 5 * d + 5):
            source, at, n = (x, k // 2, n_lon) if k % 2 == 0 else (y, k // 2, n_lat)
            value = value * 2 + F.shiftright(source, n - 1 - at).bitwiseAND(F.lit(1))
        digits.append(F.substring(F.lit(GEOHASH), value.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def hash64(c: Column) -> Column:
    """A 64-bit hash of a value's bytes; Spark's own seed and typing, so other libraries' values differ."""
    return F.xxhash64(c)


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_hex(s: Column) -> Column:
    """The text of hexadecimal bytes in UTF-8, null if it is none."""
    return F.try_validate_utf8(F.unhex(s).cast("string"))


def coerce(c: Column, kind: str) -> Column:
    """The value as another type, null where it has no such form."""
    return c.try_cast(kind)


def rescale(c: Column, scale: int, precision: int = 38) -> Column:
    """A decimal of so many places, rounded half up (away from 0)."""
    return F.round(c.cast("decimal(38,18)"), scale).cast(f"decimal({precision},{scale})")


def bounding_box(lon: float, lat: float, km: float) -> tuple[float, float, float, float]:
    """West, east, south, north of what lies within so many kilometres."""
    from math import cos, radians

    from granum.functions.predicates import KM_PER_DEGREE

    d = km / KM_PER_DEGREE
    w = d / max(cos(radians(lat)), 1e-9)
    return lon - w, lon + w, lat - d, lat + d


def geohash_text(lon: float, lat: float, length: int) -> str:
    """The geohash of one place, as geohash() gives it for columns."""
    bits = 5 * length
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    x = min(int((lon + 180) / 360 * (1 << n_lon)), (1 << n_lon) - 1)
    y = min(int((lat + 90) / 180 * (1 << n_lat)), (1 << n_lat) - 1)
    both = [x >> (n_lon - 1 - k // 2) & 1 if k % 2 == 0 else y >> (n_lat - 1 - k // 2) & 1 for k in range(bits)]
    return "".join(GEOHASH[int("".join(map(str, both[d : d + 5])), 2)] for d in range(0, bits, 5))
