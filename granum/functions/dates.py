"""Date functions as column expressions."""

from __future__ import annotations

import calendar
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are tried, by the length of the text.
FORMATS = {4: ["yyyy"], 6: ["yyyyMM"], 7: ["yyyy-MM"], 8: ["yyyyMMdd"], 10: ["yyyy-MM-dd", "yyyy/MM/dd"], 14: ["yyyyMMddHHmmss"], 16: ["yyyy-MM-dd HH:mm"], 19: ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"], 23: ["yyyy-MM-dd HH:mm:ss.SSS"]}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def parse_any(s: Column) -> Column:
    """A timestamp from text in any of FORMATS, chosen by length; longer runs of digits are epoch milliseconds; else null."""
    out = F.when(F.length(s).isin(12, 13) & s.rlike(r"^\d+$"), F.timestamp_millis(F.try_to_number(s, F.lit("9" * 13)).cast("long")))
    for n, formats in FORMATS.items():
        out = out.when(F.length(s) == n, F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]))
    return out


def fuzzy_span(prefix: str) -> tuple[datetime, datetime]:
    """First and last instant, to the microsecond of a second, of what a prefix of yyyyMMddHHmmss names."""
    low = "00000101000000"
    a = datetime.strptime(prefix + low[len(prefix) :], "%Y%m%d%H%M%S")
    month = int(prefix[4:6]) if len(prefix) >= 6 else 12
    last = f"{a.year:04d}{month:02d}{calendar.monthrange(a.year, month)[1]:02d}235959"
    return a, datetime.strptime(prefix + last[len(prefix) :], "%Y%m%d%H%M%S").replace(microsecond=999999)


def day_difference(a: Column, b: Column) -> Column:
    """Calendar days from b to a, signed."""
    return F.datediff(a, b)


def millis_to_time(ms: Column) -> Column:
    """HH:mm:ss of a duration in milliseconds; hours run on beyond 24."""
    s = F.floor(ms / 1000)
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def time_to_millis(text: Column) -> Column:
    p = F.split(text, ":")
    return (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")) * 1000


def name_index(text: Column, names: list[str]) -> Column:
    """1-based place of a month's or weekday's name by its first three letters, 0 if none."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(F.substring(text, 1, 3))).cast("int")


def next_month(d: Column, months: int = 1) -> Column:
    return F.add_months(d, months)


def week_start(d: Column) -> Column:
    return F.to_date(F.date_trunc("week", d))


def difference_in(unit: str, now: Column, old: Column) -> Column:
    """Whole units between two timestamps, toward zero and to the microsecond; unit is one of second, minute, hour, day."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    d = F.unix_micros(now) - F.unix_micros(old)
    return (F.signum(d) * F.floor(F.abs(d) / (seconds * 1_000_000))).cast("long")


def nearest_second(ts: Column) -> Column:
    """The timestamp rounded to a whole second; halves go away from 1970."""
    return F.timestamp_micros(F.round(F.unix_micros(ts), -6))


# Formats with English names of months, such as "29 Feb 2024" and "February 29, 2024".
ENGLISH = ["d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "EEE MMM dd HH:mm:ss yyyy", "d-MMM-yyyy", "dd/MMM/yyyy"]


def parse_english(s: Column) -> Column:
    """A timestamp from text in any of ENGLISH, in any case; else null. A day's name in front counts for nothing."""
    s = F.regexp_replace(F.initcap(F.lower(F.trim(s))), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    s = F.regexp_replace(F.initcap(F.regexp_replace(s, "[-/]", " ")), " +", " ")
    formats = [f.replace("-", " ").replace("/", " ").removeprefix("EEE ").replace("dd", "d") for f in ENGLISH]
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in dict.fromkeys(formats)])


def local_parts(ts: Column) -> tuple[Column, Column]:
    """Date and time of day (text, to the second) of a timestamp."""
    return F.to_date(ts), F.date_format(ts, "HH:mm:ss")


def nearest_millis(ts: Column) -> Column:
    """Milliseconds since 1970, rounded to a whole one; halves go away from 1970."""
    return (F.round(F.unix_micros(ts), -3) / 1000).cast("long")


def is_same_day(ts: Column, day: Column, ago: int = 0) -> Column:
    """Whether a timestamp falls on `day`, or so many days before it: today with 0, yesterday with 1."""
    return F.coalesce(F.to_date(ts) == F.date_sub(day, ago), F.lit(False))


def is_date_time(s: Column) -> Column:
    return parse_any(s).isNotNull()


def readable_age(now: Column, old: Column) -> Column:
    """The largest whole unit between two timestamps: "3 days", "1 hour", "0 seconds"."""
    seconds = F.abs(F.unix_micros(now) - F.unix_micros(old)) / 1_000_000
    out = None
    for unit, size in (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)):
        n = F.floor(seconds / size)
        text = F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
        out = F.when(n > 0, text) if out is None else out.when(n > 0, text)
    return out.otherwise("0 seconds")
