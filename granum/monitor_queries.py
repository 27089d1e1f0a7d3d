"""Queries over operational rows: rates, summaries, alarms, grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from granum.operators import metrics
from granum.registry import query

C = F.col


@query("SELECT user_id, sum(event_id % 7)::BIGINT AS segments, count(*) AS n FROM events GROUP BY user_id ORDER BY segments DESC, n DESC, user_id LIMIT 10")
def resumed_users(t):
    return metrics.resumed_spots(t("events").withColumn("s", C("event_id") % 7), "user_id", "s", 10)


@query("SELECT count(*) FILTER (s BETWEEN 0 AND 300) AS last_5_min, count(*) FILTER (s BETWEEN 0 AND 3600) AS last_60_min, epoch_us(max(ts)) // 1000 AS latest_ms FROM (SELECT ts, epoch(TIMESTAMP '2024-01-10') - floor(epoch(ts)) AS s FROM events)")
def recent_activity(t):
    e = t("events").withColumn("ts", C("ts").cast("timestamp"))
    return metrics.recent_counts(e, "ts", F.lit("2024-01-10 00:00:00").cast("timestamp")).select("last_5_min", "last_60_min", F.unix_millis("latest").alias("latest_ms"))


@query("SELECT user_id, count(*) AS n, CAST(floor(count(*) FILTER (event_type <> 'error') * 100 / count(*)) AS BIGINT) AS success_pct, CAST(floor(sum(event_id % 1000) / count(*)) AS BIGINT) AS average_ms FROM events GROUP BY user_id")
def outcomes(t):
    return metrics.outcome_summary(t("events").withColumn("ms", C("event_id") % 1000), C("event_type") != "error", "ms", "user_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_linenumber DESC, l_quantity DESC, nullif(l_partkey % 50, 0) ASC NULLS LAST, l_orderkey LIMIT 40")
def hot_failures(t):
    rows = t("lineitem").withColumn("at", C("l_partkey") % 50)
    return metrics.hot_failures(rows, "l_linenumber", "l_quantity", "at", 40, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT event_id, event_id % 10000 AS ms FROM events WHERE event_id % 10000 >= 700 ORDER BY ms DESC, event_id LIMIT 25")
def stalled_uploads(t):
    return metrics.stalled(t("events").select("event_id", (C("event_id") % 10000).alias("ms")), "ms", "event_id", 25, 700)


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type <> 'signup') > 0 THEN count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) FILTER (event_type <> 'signup') ELSE 0.0::DOUBLE END AS error_pct FROM events GROUP BY user_id")
def error_rates(t):
    g = t("events").groupBy("user_id").agg(F.count_if(C("event_type") == "error").alias("e"), F.count_if(C("event_type") != "signup").alias("n"))
    return g.select("user_id", metrics.rate_percent(C("e"), C("n")).alias("error_pct"))


@query("SELECT event_type, coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN event_id % 100 END), 0.0) AS average_delay, coalesce(max(CASE WHEN event_id % 3 <> 0 THEN event_id % 100 END), 0) AS most_delay FROM events GROUP BY event_type")
def delay_summary(t):
    return metrics.delays(t("events").withColumn("d", F.when(C("event_id") % 3 != 0, C("event_id") % 100)), "d", "event_type")


@query("""SELECT *, concat_ws(',', CASE WHEN loss_pct > 2 THEN 'LOSS' END, CASE WHEN again_pct > 5 THEN 'AGAIN' END, CASE WHEN error_pct > 3 THEN 'ERRORS' END, CASE WHEN average_rtt > 500 THEN 'SLOW' END, CASE WHEN per_second < 10 THEN 'IDLE' END) AS alarms FROM (
  SELECT user_id, sum(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS loss_pct, sum(CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS again_pct,
    sum(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS error_pct, avg(event_id % 1000) AS average_rtt, count(*) / 0.5 AS per_second FROM events GROUP BY user_id)""")
def link_alarms(t):
    flag = lambda c: F.when(c, 1).otherwise(0)
    e, k = t("events"), C("event_id")
    rows = e.select("user_id", F.lit(1).alias("sent"), flag(k % 37 == 0).alias("lost"), flag(k % 19 == 0).alias("again"), flag((C("event_type") == "error") & (k % 5 == 0)).alias("failed"), (k % 1000).alias("rtt"))
    return metrics.link_alarms(rows, "sent", "lost", "again", "failed", "rtt", 0.5, "user_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def grouping_sets(t):
    return metrics.grouped_sets(t("part"), [["p_brand"], ["p_type"], []], F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 300000")
def having_many(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).where("n > 12 and m > 300000").select("o_custkey", "n")


@query("SELECT DISTINCT p_type, p_size FROM part")
def distinct_pairs(t):
    return t("part").select("p_type", "p_size").distinct()


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def distinct_counts(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT count(DISTINCT l_orderkey) > 0 AS near FROM lineitem")
def approximate_count(t):
    """Whether the approximate number of orders is within a tenth of the exact one."""
    # In one aggregation Spark would keep a sketch for each distinct order: both are aggregated by themselves, one row each.
    about = t("lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"))
    exact = t("lineitem").agg(F.count_distinct("l_orderkey").alias("b"))
    return about.crossJoin(F.broadcast(exact)).select((F.abs(C("a") - C("b")) <= 0.1 * C("b")).alias("near"))


@query("""SELECT count(*) FILTER (score >= 150) AS high, count(*) FILTER (score >= 120 AND score < 150) AS medium, count(*) FILTER (score < 120) AS low, arg_max(event_id, struct_pack(s := score, t := event_id)) AS top
  FROM (SELECT event_id, 100 + CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 20 ELSE 0 END + CASE WHEN value > 80 THEN 10 ELSE 0 END AS score FROM events)""")
def risk_summary(t):
    kind = C("event_type")
    score = metrics.risk_score(100, [(kind == "error", 50), (kind == "purchase", 20), (C("value") > 80, 10)])
    e = t("events").withColumn("score", score).withColumn("level", metrics.risk_level(C("score"), 120, 150))
    return metrics.risk_summary(e, "score", "level", "event_id", "event_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 80 THEN 'large' ELSE 'usual' END AS reason, CASE WHEN event_type = 'error' AND value > 80 THEN 'HIGH' WHEN event_type = 'error' THEN 'MEDIUM' ELSE 'LOW' END AS level FROM events")
def risk_reasons(t):
    kind = C("event_type") == "error"
    score = metrics.risk_score(0, [(kind, 5), (kind & (C("value") > 80), 5)])
    return t("events").select("event_id", metrics.first_reason([(kind, "failed"), (C("value") > 80, "large")], "usual").alias("reason"), metrics.risk_level(score, 5, 10).alias("level"))
