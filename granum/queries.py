"""Queries over the given tables for the engine's own operators, with DuckDB SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granum import entity_queries, function_queries, monitor_queries, stream_queries  # noqa: F401  (they register their queries)
from granum.functions import bits, dates, strings
from granum.functions.predicates import EMBEDDED, WIRE, All, Criterion, conditions, positional
from granum.operators import changelog, enrich, metrics, mutate, ordered
from granum.plans.query import Query, list_ids
from granum.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from granum.sources.tables import content_keys, keys_with_value, overlay_value, placed


def _with_nulls(t) -> DataFrame:
    """Customers whose balance and segment are null for some keys, so that null rules show."""
    return t("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"))


CUST = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg FROM customer)"
OPS = [
    ("eq", "EQ", "seg", "BUILDING", None), ("ne", "NE", "seg", "BUILDING", None), ("gt", "GT", "bal", 1000.0, None), ("ge", "GE", "bal", 1000.0, None), ("lt", "LT", "bal", 1000.0, None),
    ("le", "LE", "bal", 1000.0, None), ("between", "BETWEEN", "bal", 0.0, 5000.0), ("in_", "IN", "seg", ["BUILDING", "MACHINERY", None], None), ("not_in", "NOT_IN", "seg", ["BUILDING", "MACHINERY"], None),
    ("like", "LIKE", "seg", "IL", None), ("like_left", "LIKE_LEFT", "seg", "B", None), ("like_right", "LIKE_RIGHT", "seg", "Y", None), ("is_null", "IS_NULL", "seg", None, None), ("not_null", "IS_NOT_NULL", "seg", None, None),
]
_EMBEDDED_SQL = {
    "eq": "seg IS NOT DISTINCT FROM 'BUILDING'", "ne": "seg IS DISTINCT FROM 'BUILDING'", "gt": "bal > 1000", "ge": "bal >= 1000", "lt": "bal IS NULL OR bal < 1000", "le": "bal IS NULL OR bal <= 1000",
    "between": "bal BETWEEN 0 AND 5000", "in_": "seg IN ('BUILDING', 'MACHINERY') OR seg IS NULL", "not_in": "seg IS NULL OR seg NOT IN ('BUILDING', 'MACHINERY')",
    "like": "contains(seg, 'IL')", "like_left": "starts_with(seg, 'B')", "like_right": "ends_with(seg, 'Y')", "is_null": "seg IS NULL", "not_null": "seg IS NOT NULL",
}
_WIRE_SQL = _EMBEDDED_SQL | {
    "eq": "seg = 'BUILDING'", "ne": "seg <> 'BUILDING'", "lt": "bal < 1000", "le": "bal <= 1000", "in_": "seg IN ('BUILDING', 'MACHINERY')", "not_in": "seg NOT IN ('BUILDING', 'MACHINERY')",
    "like_left": "ends_with(seg, 'B')", "like_right": "starts_with(seg, 'Y')",
}


def _matrix(sql: dict[str, str]) -> str:
    return "SELECT c_custkey, " + ", ".join(f"coalesce({sql[n]}, false) AS {n}" for n, *_ in OPS) + f" FROM {CUST}"


@query(_matrix(_EMBEDDED_SQL))
def predicates_embedded(t):
    return _with_nulls(t).select("c_custkey", *[Criterion(op, c, a, b).expr(EMBEDDED).alias(n) for n, op, c, a, b in OPS])


@query(_matrix(_WIRE_SQL))
def predicates_wire(t):
    return _with_nulls(t).select("c_custkey", *[Criterion(op, c, a, b).expr(WIRE).alias(n) for n, op, c, a, b in OPS])


@query(f"SELECT c_custkey FROM {CUST} WHERE bal > 0 AND (seg = 'BUILDING' OR (bal BETWEEN 500 AND 800) OR (seg = 'MACHINERY' AND bal >= 9000))")
def and_or_tree(t):
    q = Query(id_column="c_custkey").add("GT", "bal", 0.0)
    q.either(Criterion("EQ", "seg", "BUILDING"), Criterion("BETWEEN", "bal", 500.0, 800.0), All([Criterion("EQ", "seg", "MACHINERY"), Criterion("GE", "bal", 9000.0)]))
    return q.rows(_with_nulls(t)).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_custkey IN (1, 2, 3, 5, 8, 13, 21) AND contains(o_orderpriority, 'URGENT') IS NOT NULL AND o_orderpriority <> '5-LOW'")
def condition_map(t):
    o = t("orders")
    spec = {"o_orderstatus": "F", "o_totalprice_Ge": 1000.0, "o_custkey_In": "1,2,3,5,8,13,21", "o_orderpriority_NotEq": "5-LOW", "isNotNullProps": "o_orderpriority"}
    return o.where(conditions(spec, o.columns).expr()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def fuzzy_month(t):
    o = t("orders")
    return o.where(conditions({"o_orderdate_Fuzzy": "199503"}, o.columns).expr()).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey IN (1, 2, 3, 17, 24)")
def positional_conditions(t):
    return t("nation").where(positional("n_regionkey,n_nationkey", [1, [1, 2, 3, 17, 24]]).expr()).select("n_nationkey", "n_name")


@query(f"SELECT c_custkey, seg, bal FROM {CUST} ORDER BY seg DESC NULLS FIRST, bal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 10")
def sorted_slice_embedded(t):
    return Query(id_column="c_custkey").sort("seg desc, bal").find(_with_nulls(t), 10, 29).select("c_custkey", "seg", "bal")


@query(f"SELECT c_custkey FROM {CUST} WHERE bal >= 0 OR bal IS NULL ORDER BY bal ASC NULLS FIRST, c_custkey LIMIT 25 OFFSET 5")
def paged_ids_wire(t):
    q = Query(dialect=WIRE, id_column="c_custkey").sort("bal")
    q.either(Criterion("GE", "bal", 0.0), Criterion("IS_NULL", "bal"))
    return q.ids(_with_nulls(t), 5, 25)


@query(f"SELECT c_custkey FROM {CUST} WHERE seg = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def get_one(t):
    return Query([Criterion("EQ", "seg", "BUILDING")], id_column="c_custkey").sort("bal desc").one(_with_nulls(t)).select("c_custkey")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def count_filtered(t):
    return Query([Criterion("EQ", "l_returnflag", "R"), Criterion("GT", "l_quantity", 25.0)]).count(t("lineitem"))


@query("SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity > 49")
def exists_any(t):
    return Query([Criterion("GT", "l_quantity", 49.0)]).exists(t("lineitem"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1024 OFFSET 100")
def list_row_ids(t):
    return list_ids(t("orders"), "o_orderkey", 100)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount > 0.05 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def top_lines(t):
    return t("lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50)


@query("SELECT s_suppkey, n_name AS nation, n_regionkey AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_nation(t):
    return enrich.lookup(t("supplier"), t("nation"), ("s_nationkey", "n_nationkey"), {"n_name": "nation", "n_regionkey": "region"}, "n_nationkey").select("s_suppkey", "nation", "region")


@query("SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_partial(t):
    return enrich.lookup(t("documents").select("doc_id"), t("labels"), ("doc_id", "doc_id"), {"quality": "quality", "toxic": "toxic"}, "doc_id")


@query("""SELECT o_orderkey, l_partkey AS part, l_quantity AS qty FROM orders LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'N') WHERE k = 1) ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus""")
def lookup_two_keys(t):
    """Lines of an order can share their number: of those the first in the table counts."""
    return enrich.lookup_many_keys(t("orders"), placed(t("lineitem")), [("o_orderkey", "l_orderkey"), ("o_orderstatus", "l_linestatus")], {"l_partkey": "part", "l_quantity": "qty"}, ["l_linenumber", "place"], {"l_returnflag": "N"}).select("o_orderkey", "part", "qty")


@query("SELECT n_nationkey, r_regionkey AS rk, r_name AS rn FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def one_to_one(t):
    return enrich.attach_one(t("nation"), t("region"), ("n_regionkey", "r_regionkey"), "region").select("n_nationkey", F.col("region.r_regionkey").alias("rk"), F.col("region.r_name").alias("rn"))


@query("SELECT r_regionkey, count(n_nationkey) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def one_to_many(t):
    out = enrich.attach_many(t("region"), t("nation"), ("r_regionkey", "n_regionkey"), "nations", ["n_name"], "n_nationkey")
    return out.select("r_regionkey", F.size("nations").cast("long").alias("n"), F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("names"))


@query("""SELECT o_orderkey, count(DISTINCT p_partkey) AS n, string_agg(p_brand, ',' ORDER BY p_partkey) AS brands
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def many_to_many(t):
    out = enrich.attach_through(t("orders").select("o_orderkey"), t("lineitem"), t("part"), ("o_orderkey", "l_orderkey"), ("l_partkey", "p_partkey"), "parts", ["p_brand"], "p_partkey")
    return out.select("o_orderkey", F.size("parts").cast("long").alias("n"), F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["p_brand"]), ",")).alias("brands"))


@query("SELECT r_regionkey, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def joined_text(t):
    return enrich.attach_text(t("region"), t("nation"), ("r_regionkey", "n_regionkey"), "n_name", "names").select("r_regionkey", "names")


@query("SELECT c_custkey, count(o_orderstatus) AS kinds, max(m) FILTER (o_orderstatus = 'F') AS best_f FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY ALL) ON c_custkey = o_custkey GROUP BY c_custkey")
def relation_map(t):
    out = enrich.attach_map(t("customer").select("c_custkey"), t("orders"), ("c_custkey", "o_custkey"), "o_orderstatus", "o_totalprice", "best")
    return out.select("c_custkey", F.coalesce(F.size("best"), F.lit(0)).cast("long").alias("kinds"), F.try_element_at("best", F.lit("F")).alias("best_f"))


@query("""WITH c AS (SELECT r_regionkey, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS codes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def codes_text(t):
    codes = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")).cast("array<string>"), ",").alias("codes"))
    return enrich.codes_to_names(codes, "codes", t("nation"), "n_nationkey", "n_name", "names", "r_regionkey").select("r_regionkey", "names")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_correlated(t):
    return enrich.having(t("customer"), t("orders").where("o_orderstatus = 'P'"), ("c_custkey", "o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_correlated(t):
    return enrich.having(t("customer"), t("orders").where("o_orderstatus = 'P'"), ("c_custkey", "o_custkey"), False).select("c_custkey")


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100)")
def exists_uncorrelated(t):
    return enrich.having_any(t("region"), t("orders").where("o_totalprice > 100")).select("r_name")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def in_subquery(t):
    return enrich.having(t("part"), t("lineitem").where("l_quantity >= 50"), ("p_partkey", "l_partkey")).select("p_partkey")


@query("""SELECT k AS o_orderkey, unnest(a) AS action FROM (
  SELECT coalesce(n.k, b.k) AS k, CASE WHEN b.k IS NULL THEN ['CREATE'] WHEN n.k IS NULL THEN ['DELETE'] WHEN n.s <> b.s THEN ['DELETE', 'CREATE'] WHEN n.t <> b.t THEN ['MODIFY'] ELSE [] END AS a
  FROM (SELECT o_orderkey AS k, o_totalprice AS t, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 3) n
  FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS t, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 7) b ON n.k = b.k)""")
def snapshot_changes(t):
    o = t("orders")
    before = o.where("o_orderkey % 10 <> 7").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END").alias("o_totalprice"), F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END").alias("o_orderstatus"))
    return enrich.snapshot_diff(o.where("o_orderkey % 10 <> 3"), before, "o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def last_turns(t):
    return enrich.last_per_group(t("conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400 ORDER BY o_orderkey LIMIT 50")
def key_range_limited(t):
    return ordered.key_range(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 400, limit=50)


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 20) ORDER BY o_orderkey")
def head_keeps_last(t):
    return ordered.key_range(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", high=500, limit=20)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 40 OFFSET 200")
def rank_range(t):
    return ordered.rank_page(t("events").select("event_id"), "event_id", 200, 40)


@query("SELECT max(o_orderkey) FILTER (o_orderkey <= 101) AS floor_key, max(o_orderkey) FILTER (o_orderkey < 101) AS lower_key, min(o_orderkey) FILTER (o_orderkey >= 101) AS ceiling_key, min(o_orderkey) FILTER (o_orderkey > 101) AS higher_key, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def neighbour_keys(t):
    return ordered.neighbours(t("orders"), "o_orderkey", 101)


@query("SELECT e.event_id, (SELECT arg_max(s.event_id, s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS last_signup FROM events e WHERE e.event_type = 'purchase'")
def as_of_signup(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return ordered.as_of(left, e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup")), "user_id", "ts", "signup", "last_signup").select("event_id", "last_signup")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def ids_intersect(t):
    k = t("lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return ordered.combine_ids("intersect", k.where("l_returnflag = 'R'").select("k"), k.where("l_returnflag = 'A'").select("k"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def ids_subtract(t):
    return ordered.combine_ids("subtract", t("part").select(F.col("p_partkey").alias("k")), t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def ids_union(t):
    return ordered.combine_ids("union", t("supplier").select(F.col("s_nationkey").alias("k")), t("customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")))


@query("SELECT count(*) = 0 AS contains_all FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)")
def ids_contain_all(t):
    return ordered.contains_all(t("part").select("p_partkey"), t("lineitem").select("l_partkey"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_per_reason(t):
    return metrics.counts_by(t("events"), "event_type")


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, most DESC, user_id LIMIT 10")
def hot_users(t):
    return metrics.hot_spots(t("events").where("event_type = 'error'"), "user_id", "value", 10)


@query("SELECT event_type, CAST(floor(count(*) FILTER (value > 50) * 100 / count(*)) AS BIGINT) AS pct, min(value) AS low, max(value) AS high, arg_max(user_id, struct_pack(v := value, u := user_id)) AS top_user FROM events GROUP BY event_type")
def health_summary(t):
    agg = t("events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("p"), F.count("*").alias("w"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("user_id", F.struct("value", "user_id")).alias("top_user"))
    return agg.select("event_type", metrics.percent(F.col("p"), F.col("w")).alias("pct"), "low", "high", "top_user")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 hour, ts)) // 1000 AS hour_s, count(*) AS n FROM events GROUP BY 1")
def hourly_rate(t):
    return metrics.rolling(t("events"), "ts", "value", 3600).select(F.unix_timestamp("start").alias("hour_s"), "n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_day(t):
    from pyspark.sql import Window

    ms = dates.nearest_millis(F.col("ts").cast("timestamp"))  # as the SQL's epoch_ms rounds it
    return t("events").select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy(ms).rangeBetween(-86_400_000, 0)).alias("n"))


@query("""SELECT category, sum(n)::BIGINT AS n, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS summary FROM (SELECT event_type, count(*) AS n, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS category FROM events GROUP BY ALL) GROUP BY category""")
def category_roll_up(t):
    return metrics.roll_up(t("events"), "event_type", F.when(F.col("event_type") == "error", "bad").otherwise("good"))


@query("""SELECT user_id, event_type, reason FROM (SELECT user_id, event_type, 'e' || event_id AS reason, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, 'e' || event_id DESC) AS k FROM events WHERE event_type IN ('error', 'purchase', 'click')) WHERE k = 1""")
def worst_action(t):
    e = t("events").where("event_type in ('error', 'purchase', 'click')").select("user_id", "event_type", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("reason"))
    return metrics.fan_in(e, "user_id", "event_type", "reason", {"error": 3, "purchase": 2, "click": 1})


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 25")
def keyword_top(t):
    return metrics.keyword_counts(t("documents"), "text", 25)


@query("SELECT event_id, CASE WHEN value >= 90 THEN 'ALARM' WHEN value >= 75 THEN 'WARN' ELSE 'OK' END AS level FROM events")
def severity_levels(t):
    return t("events").select("event_id", metrics.severity(F.col("value"), 75, 90).alias("level"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pricing_groups(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def cube_parts(t):
    return t("part").cube("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def replay_log(t):
    return changelog.replay(t("events"), "user_id", "event_id", "event_type", "error", ["event_type", "value"])


@query("""WITH p AS (SELECT user_id, epoch_ms(ts) // 1000 AS put_at, value, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 86400 * (event_id % 20) END AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 1000 DESC) AS k FROM events)
  SELECT user_id, value, CASE WHEN ttl < 0 THEN -1 ELSE put_at + ttl - 1706745600 END::BIGINT AS seconds_left FROM p WHERE k = 1 AND (ttl < 0 OR put_at + ttl > 1706745600)""")
def live_keys(t):
    at = F.floor(dates.nearest_millis(F.col("ts").cast("timestamp")) / 1000)  # as the SQL's epoch_ms rounds it
    puts = placed(t("events")).select("user_id", at.alias("at"), "value", F.expr("CASE WHEN event_id % 3 = 0 THEN -1 ELSE 86400 * (event_id % 20) END").alias("ttl"), "place")
    return changelog.live_values(puts, "user_id", "at", "value", "ttl", 1_706_745_600, tie="place")


@query("SELECT user_id, event_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def path_owners(t):
    return changelog.owners(t("events"), "user_id", "event_id", "value")


@query("SELECT l_orderkey, count(*) AS replicas, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FILTER (l_returnflag = 'N'), '') AS outstanding, bool_and(l_returnflag <> 'N') AS done FROM lineitem GROUP BY l_orderkey")
def delivery_state(t):
    acks = t("lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("replica"), (F.col("l_returnflag") != "N").alias("acked"))
    return changelog.delivery(acks, "l_orderkey", "replica", "acked")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 10000000 + c_custkey, 1.5 FROM customer WHERE c_custkey < 5")
def upsert_rows(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    changes = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).union(c.where("c_custkey < 5").select(F.col("c_custkey") + 10_000_000, F.lit(1.5)))
    return mutate.upsert(c, changes, "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'BIG' ELSE p_brand END AS p_brand FROM part WHERE NOT p_retailprice > 1500")
def update_and_delete(t):
    p = mutate.update_where(t("part"), F.col("p_size") > 25, {"p_brand": "BIG", "p_name": None})
    return mutate.delete_where(p, F.col("p_retailprice") > 1500).select("p_partkey", "p_brand")


@query("SELECT row_number() OVER (ORDER BY event_id) + 999 AS id, event_id FROM events")
def allocated_ids(t):
    return mutate.allocate_ids(t("events").select("event_id"), 1000, "event_id").select(F.col("id").cast("long").alias("id"), "event_id")


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 THEN 'p_size:min' END, CASE WHEN p_size > 45 THEN 'p_size:max' END, CASE WHEN strlen(p_name) > 20 THEN 'p_name:length' END) AS broken FROM part")
def row_violations(t):
    rules = {"p_size": {"nullable": False, "min": 5, "max": 45}, "p_name": {"length": 20}}
    return t("part").select("p_partkey", F.array_join(mutate.violations(t("part"), rules), ",").alias("broken"))


@query("SELECT sha256(p_type) AS key, p_type AS value, count(*) AS refs FROM part GROUP BY p_type")
def content_addressed(t):
    return content_keys(t("part"), "p_type")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 30 OFFSET 3")
def by_value_page(t):
    return keys_with_value(t("customer"), "c_custkey", "c_mktsegment", "BUILDING", 3, 30)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN substr(n_name, 1, 1) || 'xx' || substr(n_name, 4) ELSE n_name END AS n_name FROM nation")
def partial_update(t):
    return overlay_value(t("nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", 3, 2, "xx")


@query("""SELECT p_partkey, md5(p_name) AS m, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '...' ELSE p_name END AS short, substr(p_name, 1, 2) || repeat('*', least(6, length(p_name)) - 2) || substr(p_name, 7) AS masked,
  regexp_replace(translate(p_type, 'oO', '00'), '\\D', '', 'g') AS digits, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS first, regexp_matches(p_brand, '^[A-Za-z]+$') AS letters FROM part""")
def string_functions(t):
    n = F.col("p_name")
    return t("part").select("p_partkey", strings.md5_hex(n).alias("m"), strings.shorten(n, 10).alias("short"), strings.mask(n, 2, 6).alias("masked"), strings.only_digits(F.col("p_type")).alias("digits"), strings.first_upper(n).alias("first"), strings.is_letters(F.col("p_brand")).alias("letters"))


@query("SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS host, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) AS ext, regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', '', 'g'), '<[^>]*>', '', 'g') AS marked FROM pages")
def url_functions(t):
    return t("pages").select("page_id", strings.host_of(F.col("url")).alias("host"), strings.extension_of(F.col("url")).alias("ext"), strings.without_tags(F.col("html")).alias("marked"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-01-01') AS days, (date_trunc('week', o_orderdate)::DATE)::VARCHAR AS week, ((o_orderdate::DATE + INTERVAL 1 MONTH)::DATE)::VARCHAR AS next, month(o_orderdate)::INT AS m FROM orders")
def date_functions(t):
    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", dates.day_difference(F.lit("1998-01-01").cast("date"), d).cast("long").alias("days"), dates.week_start(d).cast("string").alias("week"), dates.next_month(d).cast("string").alias("next"), dates.name_index(F.date_format(d, "MMMM"), dates.MONTHS).alias("m"))


@query("SELECT event_id, event_id & 3 AS low, (event_id >> 2) & 15 AS mid, (event_id & 3) | ((user_id & 255) << 4) AS packed, event_id | 32 AS marked FROM events")
def bit_functions(t):
    e, u = F.col("event_id"), F.col("user_id")
    return t("events").select("event_id", bits.bit_field(e, 0, 1).alias("low"), bits.bit_field(e, 2, 5).alias("mid"), bits.pack_fields([(e, 0, 1), (u, 4, 11)]).alias("packed"), bits.set_bit(e, 5).alias("marked"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, 100 + CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 20 ELSE 0 END + CASE WHEN value > 80 THEN 10 ELSE 0 END AS score FROM events""")
def risk_scores(t):
    kind = F.col("event_type")
    return t("events").select("event_id", metrics.risk_score(100, [(kind == "error", 50), (kind == "purchase", 20), (F.col("value") > 80, 10)]).alias("score"))


@query("SELECT * FROM (SELECT 'order' AS feed, o_orderkey AS id, epoch_ms(o_orderdate) AS at_ms FROM orders UNION ALL SELECT 'ship', l_orderkey * 10 + l_linenumber, epoch_ms(l_shipdate) FROM lineitem) ORDER BY at_ms DESC, feed, id LIMIT 100")
def timeline(t):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    feeds = t("orders").select(F.lit("order").alias("feed"), F.col("o_orderkey").alias("id"), ms("o_orderdate").alias("at_ms"))
    feeds = feeds.unionByName(t("lineitem").select(F.lit("ship").alias("feed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ms("l_shipdate").alias("at_ms")))
    return feeds.orderBy(F.desc("at_ms"), "feed", "id").limit(100)
