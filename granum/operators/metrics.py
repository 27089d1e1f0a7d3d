"""Folds over operational rows: rates, hot spots, summaries, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def hot_spots(df: DataFrame, key: str, weight: str, limit: int) -> DataFrame:
    """Groups by count, greatest weight and label, the largest first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max(weight).alias("most")).orderBy(F.desc("n"), F.desc("most"), key).limit(limit)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0).cast("long")


def rolling(df: DataFrame, at: str, value: str, seconds: int, slide: int | None = None) -> DataFrame:
    """Count, sum and rate per second in windows of event time."""
    w = F.window(at, f"{seconds} seconds", f"{slide or seconds} seconds")
    out = df.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), "n", "total", (F.col("n") / seconds).alias("per_second"))


def recent_counts(df: DataFrame, at: str, now: Column, minutes: tuple[int, ...] = (5, 60)) -> DataFrame:
    """Counts of the last so many minutes and the latest time."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return df.agg(*[F.count_if((age >= 0) & (age <= 60 * m)).alias(f"last_{m}_min") for m in minutes], F.max(at).alias("latest"))


def roll_up(df: DataFrame, reason: str, category: Column) -> DataFrame:
    """Reasons counted, then summed by category with a text of "reason=n" in order of reason."""
    per = df.groupBy(reason).agg(F.count("*").alias("n")).withColumn("category", category)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(reason).alias("r"), "n"))), lambda x: F.concat(x["r"], F.lit("="), x["n"].cast("string"))), ", ")
    return per.groupBy("category").agg(F.sum("n").alias("n"), text.alias("summary"))


def fan_in(df: DataFrame, key: str, action: str, reason: str, rank: dict[str, int]) -> DataFrame:
    """Per key the worst action by `rank` and the reason that came with it."""
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])[F.col(action)]
    worst = F.max_by(F.struct(action, reason), F.struct(order, F.col(reason)))
    return df.groupBy(key).agg(worst.alias("w")).select(key, f"w.{action}", f"w.{reason}")


def keyword_counts(df: DataFrame, text: str, limit: int) -> DataFrame:
    words = df.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def severity(value: Column, warn: float, alarm: float) -> Column:
    return F.when(value >= alarm, "ALARM").when(value >= warn, "WARN").otherwise("OK")


def resumed_spots(df: DataFrame, key: str, segments: str, limit: int) -> DataFrame:
    """Groups by the sum of their segments, their count and label, the largest first."""
    return df.groupBy(key).agg(F.sum(segments).alias("segments"), F.count("*").alias("n")).orderBy(F.desc("segments"), F.desc("n"), key).limit(limit)


def outcome_summary(df: DataFrame, ok: Column, millis: str, *keys: str) -> DataFrame:
    """Per group: whole percent of successes and whole average milliseconds, both rounded down; 0 of nothing."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("_ok"), F.sum(millis).alias("_ms"), F.count(millis).alias("_m"))
    average = F.when(F.col("_m") > 0, F.floor(F.col("_ms") / F.col("_m"))).otherwise(0).cast("long")
    return out.select(*keys, "n", percent(F.col("_ok"), F.col("n")).alias("success_pct"), average.alias("average_ms"))


def hot_failures(df: DataFrame, priority: str, retries: str, failed_at: str, limit: int, tie: str) -> DataFrame:
    """Failed items: highest priority, most retries, earliest failure first, those without a time (0) last."""
    return df.orderBy(F.desc(priority), F.desc(retries), F.nullif(F.col(failed_at), F.lit(0)).asc_nulls_last(), tie).limit(limit)


def stalled(df: DataFrame, millis: str, path: str, limit: int, least: int = 5000) -> DataFrame:
    """What has stood still for at least so many milliseconds, longest first."""
    return df.where(F.col(millis) >= least).orderBy(F.desc(millis), path).limit(limit)


def rate_percent(part: Column, whole: Column) -> Column:
    """Percent as a double, 0 of nothing."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def delays(df: DataFrame, millis: str, *keys: str) -> DataFrame:
    """Average and greatest delay per group; 0 where there is none."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(millis), F.lit(0.0)).alias("average_delay"), F.coalesce(F.max(millis), F.lit(0)).alias("most_delay"))


# Limits over which a link raises an alarm: lost, sent again, failed (percent), round trip (ms); messages per second below which it does.
LOSS, AGAIN, ERRORS, ROUND_TRIP, LEAST_RATE = 2.0, 5.0, 3.0, 500.0, 10.0


def link_alarms(df: DataFrame, sent: str, lost: str, again: str, failed: str, round_trip: str, seconds: float, *keys: str) -> DataFrame:
    """Per group: rates of loss, of sending again and of failure, average round trip, messages per second, and the alarms they raise, in that order."""
    s = F.sum(sent)
    out = df.groupBy(*keys).agg(
        rate_percent(F.sum(lost), s).alias("loss_pct"), rate_percent(F.sum(again), s).alias("again_pct"), rate_percent(F.sum(failed), s).alias("error_pct"),
        F.coalesce(F.avg(round_trip), F.lit(0.0)).alias("average_rtt"), (F.coalesce(s, F.lit(0)) / seconds).alias("per_second"),
    )
    checks = [("LOSS", F.col("loss_pct") > LOSS), ("AGAIN", F.col("again_pct") > AGAIN), ("ERRORS", F.col("error_pct") > ERRORS), ("SLOW", F.col("average_rtt") > ROUND_TRIP), ("IDLE", F.col("per_second") < LEAST_RATE)]
    return out.withColumn("alarms", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in checks])), ","))


def risk_score(base: int, rules: list[tuple[Column, int]]) -> Column:
    """The base and the points of every rule that holds."""
    total = F.lit(base)
    for condition, points in rules:
        total = total + F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    return total.cast("int")


def risk_level(score: Column, medium: int, high: int) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def first_reason(reasons: list[tuple[Column, str]], default: str) -> Column:
    """The reason of the first condition that holds."""
    out = None
    for condition, text in reasons:
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return F.lit(default) if out is None else out.otherwise(default)


def risk_summary(df: DataFrame, score: str, level: str, at: str, item: str) -> DataFrame:
    """One row: counts of each level, and the item of the highest score, of equal ones the latest."""
    counts = [F.count_if(F.col(level) == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")]
    return df.agg(*counts, F.max_by(item, F.struct(score, at, item)).alias("top"))


def grouped_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates over several sets of keys in one pass; keys that a row's set lacks are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates)
