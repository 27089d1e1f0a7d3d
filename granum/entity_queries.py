"""Queries over entities: reads by id, relations, projections, sub-queries as criteria, condition maps, changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granum.functions import bits
from granum.functions.predicates import WIRE, All, AnyOf, ConditionMap, Criterion, Exists, conditions, in_rows
from granum.operators import changelog, enrich, mutate, ordered
from granum.plans import query as plans
from granum.plans.query import Query
from granum.registry import query
from granum.sources import tables

C = F.col


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 7")
def row_columns(t):
    return plans.get_row(t("orders"), "o_orderkey", 7, ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("SELECT * FROM nation WHERE n_nationkey = 4")
def row_whole(t):
    return plans.get_row(t("nation"), "n_nationkey", 4)


@query("SELECT true AS found, (SELECT c_name FROM customer WHERE c_custkey = 5) AS c_name, false AS missing_found, NULL::VARCHAR AS missing_name")
def column_get(t):
    one, none = plans.get_column(t("customer"), "c_custkey", 5, "c_name"), plans.get_column(t("customer"), "c_custkey", -5, "c_name")
    return one.crossJoin(F.broadcast(none.select(C("found").alias("missing_found"), C("c_name").alias("missing_name"))))  # one row each


@query("SELECT (SELECT count(*) > 0 FROM orders WHERE o_orderkey = 12) AS here, (SELECT count(*) > 0 FROM orders WHERE o_orderkey = -12) AS there")
def row_exists(t):
    here, there = (plans.row_exists(t("orders"), "o_orderkey", k) for k in (12, -12))
    return here.select(C("found").alias("here")).crossJoin(F.broadcast(there.select(C("found").alias("there"))))


@query("""SELECT c_custkey, n_name AS nation, n_orders, first_priority, n_parts FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1) ON o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey AS k, count(DISTINCT l_partkey) AS n_parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey""")
def entity_with_relations(t):
    bought = t("orders").join(t("lineitem"), C("o_orderkey") == C("l_orderkey")).select("o_custkey", "l_partkey")
    relations = [
        enrich.Relation("nation", "one", t("nation"), ("c_nationkey", "n_nationkey"), ["n_name"], "n_nationkey"),
        enrich.Relation("orders", "many", t("orders"), ("c_custkey", "o_custkey"), ["o_orderkey", "o_orderpriority"], "o_orderkey"),
        enrich.Relation("parts", "through", t("part"), ("c_custkey", "p_partkey"), ["p_brand"], "p_partkey", (bought, "o_custkey", "l_partkey")),
    ]
    out = enrich.with_relations(t("customer"), relations)
    count = lambda c: F.when(F.size(c) > 0, F.size(c)).cast("long")
    return out.select("c_custkey", C("nation.n_name").alias("nation"), count("orders").alias("n_orders"), F.try_element_at("orders", F.lit(1))["o_orderpriority"].alias("first_priority"), count("parts").alias("n_parts"))


@query("SELECT unnest(['a: keys differ in type', 'a: name is taken', 'b: no column c_none', 'b: target has no column x', 'c: kind odd']) AS wrong")
def relation_check(t):
    r = enrich.Relation
    wrong = enrich.check_relations(t("customer"), [r("a", "one", t("nation"), ("c_name", "n_nationkey"), [], "n_name"), r("a", "many", t("orders"), ("c_custkey", "o_custkey"), [], "o_orderkey"), r("b", "many", t("orders"), ("c_none", "o_custkey"), ["x"], "o_orderkey"), r("c", "odd", t("orders"), ("c_custkey", "o_custkey"), [], "o_orderkey")])
    return t("region").sparkSession.createDataFrame([(w,) for w in wrong], "wrong string")


@query("SELECT o_custkey AS customer, o_totalprice AS price, o_orderkey FROM orders WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def projected_slice(t):
    q = Query(id_column="o_orderkey", aliases={"customer": "o_custkey", "price": "o_totalprice"}).add("GT", "price", 200000.0).sort("price desc").select("customer, price, o_orderkey")
    return q.project(t("orders"), 5, 24)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_ms(o_orderdate) AS at_ms, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 11")
def select_ignored_by_find(t):
    out = Query([Criterion("EQ", "o_orderstatus", "P")], id_column="o_orderkey").select("o_orderkey").find(t("orders"), 0, 10)
    return out.withColumn("at_ms", F.unix_millis(C("o_orderdate").cast("timestamp"))).drop("o_orderdate")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 2")
def order_by_unknown(t):
    return Query(dialect=WIRE, id_column="n_nationkey").sort("nothing desc, @composite:x").ids(t("nation"), 2, 10)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_custkey, o_orderkey LIMIT 15")
def merged_queries(t):
    q = Query([Criterion("EQ", "o_orderstatus", "F")], id_column="o_orderkey").sort("o_totalprice desc")
    return q.merge(Query([Criterion("GT", "o_totalprice", 100000.0)]).sort("o_custkey"), with_order=True).find(t("orders"), 0, 14).select("o_orderkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey < 2")
def unknown_column_is_null(t):
    return Query([Criterion("IS_NULL", "nothing"), Criterion("LT", "n_regionkey", 2), Criterion("NE", "other", 1)], id_column="n_nationkey").rows(t("nation")).select("n_nationkey")


def _refused(make) -> str:
    try:
        make()
    except ValueError as e:
        return str(e)
    return "nothing"


@query("SELECT '@composite:key is a composite column, which no predicate reads' AS composite, 'EQ needs an operand that isn''t null' AS empty, 'unknown operator NEAR' AS op, 'unknown column nothing' AS col")
def refused_predicates(t):
    n = t("nation")
    ask = lambda c: _refused(lambda: Query([c], dialect=WIRE).condition(n))
    found = [ask(c) for c in (Criterion("EQ", "@composite:key", 1), Criterion("EQ", "n_name"), Criterion("NEAR", "n_name", 1), Criterion("EQ", "nothing", 1))]
    return n.sparkSession.createDataFrame([tuple(found)], "composite string, empty string, op string, col string")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)
  OR (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))""")
def exists_in_or(t):
    big = t("orders").where("o_orderstatus = 'P' and o_totalprice > 200000")
    q = Query(id_column="c_custkey")
    q.either(Criterion("GT", "c_acctbal", 9000.0), Exists(big, ("c_custkey", "o_custkey")), All([in_rows("c_nationkey", t("nation").where("n_regionkey = 1"), "n_nationkey"), Exists(t("orders"), ("c_custkey", "o_custkey"), False)]))
    return q.rows(t("customer")).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) AND EXISTS (SELECT 1 FROM region)")
def not_in_rows(t):
    q = Query([in_rows("s_nationkey", t("customer").where("c_acctbal < -900"), "c_nationkey", False), Exists(t("region"))], id_column="s_suppkey")
    return q.rows(t("supplier")).select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE contains(c_name, '1') AND starts_with(c_mktsegment, 'B') AND ends_with(c_name, '3') AND c_nationkey NOT IN (1, 2, 3) AND c_custkey IN (3, 13, 23, 33, 43, 113, 133, 143)")
def condition_texts(t):
    c = t("customer").select("*", C("c_mktsegment").alias("segment"))
    spec = {"c_name_Like": "1", "segment_LikeLeft": "B", "c_name_LikeRight": "3", "c_nationkey_NotIn": "1,2,3", "c_custkey_In": [3, 13, 23, 33, 43, 113, 133, 143]}
    return c.where(conditions(spec, c.columns).expr()).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate <= TIMESTAMP '1996-02-20' AND o_totalprice > 1000 AND o_totalprice <= 150000 AND o_orderstatus IS NOT NULL")
def condition_range(t):
    from datetime import datetime

    o = t("orders")
    spec = ConditionMap().where("o_orderdate", "Start", datetime(1996, 2, 1)).where("o_orderdate", "End", datetime(1996, 2, 20)).where("o_totalprice", "Gt", 1000.0).where("o_totalprice", "Le", 150000.0).present("o_orderstatus")
    return o.where(conditions(spec, o.columns).expr()).select("o_orderkey")


#: Places for customers: lon and lat from the key, and their geohash.
def _places(t):
    return t("customer").select("c_custkey", ((C("c_custkey") * 37 % 3600) / 10 - 180).alias("lon"), ((C("c_custkey") * 53 % 1800) / 10 - 90).alias("lat"))


_PLACES = "(SELECT c_custkey, (c_custkey * 37 % 3600) / 10 - 180 AS lon, (c_custkey * 53 % 1800) / 10 - 90 AS lat FROM customer)"


@query(f"SELECT c_custkey FROM {_PLACES} WHERE lat BETWEEN 10 - 3000 / 111.0 AND 10 + 3000 / 111.0 AND lon BETWEEN 20 - 3000 / 111.0 / cos(radians(10)) AND 20 + 3000 / 111.0 / cos(radians(10))")
def near_box(t):
    p = _places(t)
    return p.where(conditions({"lon": 20, "lat": 10, "geoSearchRadius": 3000}, p.columns).expr()).select("c_custkey")


@query(f"SELECT c_custkey FROM {_PLACES} WHERE lon >= 0 AND lon < 45 AND lat >= 0 AND lat < 45")
def near_geohash(t):
    p = _places(t).withColumn("geo_code", bits.geohash(C("lon"), C("lat"), 6))
    return p.where(conditions({"lon": 20, "lat": 10, "geoHashLength": 1}, p.columns).expr()).select("c_custkey")


@query("SELECT o_orderkey, n_name AS nation, r_name AS region FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def chained_lookups(t):
    out = enrich.lookup_all(t("orders"), [(t("customer"), ("o_custkey", "c_custkey"), {"c_nationkey": "nk"}, "c_custkey"), (t("nation"), ("nk", "n_nationkey"), {"n_name": "nation", "n_regionkey": "rk"}, "n_nationkey"), (t("region"), ("rk", "r_regionkey"), {"r_name": "region"}, "r_regionkey")])
    return out.select("o_orderkey", "nation", "region")


@query("SELECT c_custkey, arg_max(o_totalprice, o_orderkey) AS last_price, arg_max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS last_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def lookup_duplicates(t):
    o = t("orders").withColumn("status", F.when(C("o_orderkey") % 3 != 0, C("o_orderstatus")))
    return enrich.lookup(t("customer"), o, ("c_custkey", "o_custkey"), {"o_totalprice": "last_price", "status": "last_status"}, "o_orderkey").select("c_custkey", "last_price", "last_status")


@query("""SELECT o_orderkey, a.l_partkey AS first_n, b.l_partkey AS first_r FROM orders
  LEFT JOIN (SELECT l_orderkey, l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) a ON a.l_orderkey = o_orderkey AND a.l_linestatus = o_orderstatus
  LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 1""")
def chained_key_lookups(t):
    o = t("orders").withColumn("one", F.lit(1))
    first = t("lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.min("l_partkey").alias("l_partkey"))
    out = enrich.lookup_all_many_keys(o, [(first, [("o_orderkey", "l_orderkey"), ("o_orderstatus", "l_linestatus")], {"l_partkey": "first_n"}, ["l_partkey"]), (t("lineitem"), [("o_orderkey", "l_orderkey"), ("one", "l_linenumber")], {"l_partkey": "first_r"}, ["l_partkey"])])
    return out.select("o_orderkey", "first_n", "first_r")


@query("SELECT o_orderkey, coalesce(string_agg(p_brand, ',' ORDER BY p_brand), '') AS brands FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def bridge_text(t):
    return enrich.attach_text_through(t("orders").select("o_orderkey"), t("lineitem"), t("part"), ("o_orderkey", "l_orderkey"), ("l_partkey", "p_partkey"), "p_brand", "brands")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 17")
def nth_key(t):
    return ordered.nth(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 17)


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey < 42) AS rank, -1 AS missing")
def index_of_key(t):
    one, none = ordered.index_of(t("part"), "p_partkey", 42), ordered.index_of(t("part"), "p_partkey", -7)
    return one.crossJoin(F.broadcast(none.select(C("rank").cast("int").alias("missing"))))  # one row each


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def deleted_by_id(t):
    return mutate.delete_ids(t("customer"), t("orders").where("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT 'order' AS kind, o_orderkey AS k, count(*) AS n FROM orders WHERE o_totalprice <= 150000 GROUP BY 2 UNION ALL SELECT 'line', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000) GROUP BY 2")
def deleted_with_links(t):
    o, l = mutate.remove_with_relations(t("orders"), t("lineitem"), t("orders").where("o_totalprice > 150000"), "o_orderkey", "l_orderkey")  # noqa: E741
    count = lambda df, kind, key: df.groupBy(C(key).alias("k")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "k", "n")
    return count(o, "order", "o_orderkey").union(count(l, "line", "l_orderkey"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS gone, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def marked_and_reset(t):
    s = mutate.mark_deleted(t("supplier"), t("supplier").where("s_suppkey % 3 = 0"), "s_suppkey", "gone")
    return mutate.update_ids(s, t("supplier").where("s_suppkey % 2 = 0"), "s_suppkey", {"s_acctbal": None}).select("s_suppkey", "gone", "s_acctbal")


@query("SELECT count(*) FILTER (p_partkey < 50) AS updated, count(*) FILTER (p_partkey >= 50) AS inserted FROM part WHERE p_partkey < 80")
def merge_split(t):
    return mutate.merge_counts(t("part").where("p_partkey < 50"), t("part").where("p_partkey < 80"), "p_partkey")


@query("SELECT n_nationkey, n_name, 42::BIGINT AS extra, CAST(NULL AS VARCHAR) AS note FROM nation")
def evolved_schema(t):
    new = StructType.fromDDL("n_nationkey int, n_name string, extra bigint, note string")
    return tables.evolve(t("nation").drop("n_regionkey"), new, {"extra": 42})


@query("SELECT unnest(['nation', 'nation', 'region']) AS name, unnest([1, 2, 1]) AS version")
def schema_registry(t):
    empty = t("region").sparkSession.createDataFrame([], "name string, version int, digest string, json string")
    nation, region = t("nation").schema, t("region").schema
    for name, s in (("nation", nation), ("nation", nation), ("region", region), ("nation", t("nation").drop("n_name").schema), ("region", region)):
        empty = tables.register_schema(empty, name, s)
    return empty.select("name", "version")


@query("SELECT k, v FROM (SELECT user_id AS k, arg_max(value, event_id) AS v FROM events WHERE event_id >= 300 GROUP BY 1) UNION ALL SELECT user_id, arg_max(value, event_id) FROM events WHERE event_id < 300 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id >= 300) GROUP BY 1")
def put_values(t):
    e = t("events").select(C("user_id").alias("k"), C("value").alias("v"), "event_id")
    store = tables.put_values(e.limit(0).select("k", "v"), e.where("event_id < 300"), "k", "event_id")
    return tables.put_values(store, e.where("event_id >= 300"), "k", "event_id")


@query("SELECT true AS found")
def store_contains(t):
    return tables.contains_key(t("nation"), "n_name", "NATION_3")


@query("SELECT row_number() OVER (ORDER BY p_name) AS id, p_name AS text, n - CASE WHEN starts_with(p_name, 'cold') THEN 1 ELSE 0 END AS refs FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) QUALIFY refs > 0")
def text_dictionary(t):
    d = tables.text_dictionary(t("part"), "p_name")
    released = d.where("text like 'cold%'").select("text", F.lit(-1).alias("by"))
    return tables.change_references(d, released.union(released.withColumn("by", F.lit(1))).union(released))


@query("SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderpriority = '1-URGENT'")
def members_of_group(t):
    edges = t("orders").select(C("o_orderpriority").alias("grp"), C("o_custkey").alias("member"))
    return tables.members_of(edges, "grp", "member", "1-URGENT")


@query("""WITH m AS (SELECT DISTINCT o_orderpriority AS grp, o_custkey AS member FROM orders), l AS (SELECT * FROM m WHERE member % 3 = 0)
  SELECT grp, count(*) AS members, count(*) FILTER (member % 2 = 0) AS admins FROM m WHERE member % 3 <> 0 GROUP BY grp""")
def group_leaves(t):
    m = t("orders").select(C("o_orderpriority").alias("grp"), C("o_custkey").alias("member")).distinct()
    members, admins = tables.leave_group(m, m.where("member % 2 = 0"), m.where("member % 3 = 0"), ["grp", "member"])
    a = admins.groupBy("grp").agg(F.count("*").alias("admins"))
    return members.groupBy("grp").agg(F.count("*").alias("members")).join(a, "grp", "left").withColumn("admins", F.coalesce("admins", F.lit(0)))


def _tags(t):
    return t("documents").select("doc_id", F.explode(F.array("lang", F.concat(F.lit("m"), (C("doc_id") % 4).cast("string")))).alias("tag"))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def files_by_tag(t):
    return tables.tagged(t("documents").select("doc_id"), _tags(t), "doc_id", "en")


@query("SELECT doc_id, lang || ',m' || (doc_id % 4) AS tags FROM documents WHERE lang IS NOT NULL")
def tags_by_file(t):
    return tables.tags_of(_tags(t).where("tag is not null"), "doc_id").join(t("documents").where("lang is not null").select("doc_id"), "doc_id").select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id, (row_number() OVER (ORDER BY value DESC, event_id) - 1) // 64 AS chunk, row_number() OVER (ORDER BY value DESC, event_id) > ((SELECT count(*) FROM events) - 1) // 64 * 64 AS completed FROM events")
def chunked_result(t):
    return Query(id_column="event_id").sort("value desc").chunked(t("events"), 64).select("event_id", "chunk", "completed")


@query("SELECT event_id, value FROM events WHERE event_id > 500 AND event_id < 900 AND event_type <> 'error'")
def replay_after_mark(t):
    log = changelog.intact_prefix(t("events"), "event_id", C("event_id") < 900)
    return changelog.replay(log, "event_id", "event_id", "event_type", "error", ["value"], after=500)


@query("SELECT mark, (SELECT count(*) FROM events WHERE event_id > mark) AS newer FROM (SELECT max(event_id) AS mark FROM events WHERE event_type = 'click')")
def high_water_mark(t):
    mark = changelog.advance_mark(t("events"), "event_id", C("event_type") == "click", 3)
    newer = t("events").join(F.broadcast(mark), C("event_id") > C("mark")).agg(F.count("*").alias("newer"))  # one row
    return mark.crossJoin(F.broadcast(newer))


@query("""WITH p AS (SELECT user_id, event_id AS put_at, value, 40 AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id < 700)
  SELECT u.user_id, p.value, coalesce(put_at + 40 - 700, -2)::BIGINT AS seconds_left FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p ON p.user_id = u.user_id AND k = 1 AND put_at + ttl > 700""")
def read_live_values(t):
    puts = t("events").where("event_id < 700").select("user_id", C("event_id").alias("at"), "value", F.lit(40).alias("ttl"))
    live = changelog.live_values(puts, "user_id", "at", "value", "ttl", 700)
    return changelog.read_values(live, t("events").select("user_id").distinct(), "user_id", "value")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'INCR' END AS op FROM events),
  g AS (SELECT *, count(*) FILTER (op <> 'INCR') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
  s AS (SELECT user_id, g, sum(CASE op WHEN 'DEL' THEN 0 ELSE event_id % 10 END)::BIGINT AS total, arg_max(op, event_id) AS last FROM g GROUP BY ALL)
  SELECT user_id, arg_max(total, g) AS total FROM s GROUP BY user_id HAVING arg_max(last, g) <> 'DEL'""")
def counters(t):
    op = F.when(C("event_type") == "signup", "SET").when(C("event_type") == "error", "DEL").otherwise("INCR")
    return changelog.increments(t("events").select("user_id", "event_id", op.alias("op"), (C("event_id") % 10).alias("by")), "user_id", "event_id", "op", "by")


@query("SELECT k, owner, put_at + 60 - 900 AS seconds_left FROM (SELECT user_id AS k, arg_max(event_type, event_id) AS op, arg_max('w' || (event_id % 5), event_id) AS owner, max(event_id) AS put_at FROM events WHERE event_id < 900 GROUP BY 1) WHERE op <> 'error' AND put_at + 60 > 900")
def locks(t):
    op = F.when(C("event_type") == "error", "RELEASE").when(C("event_type") == "click", "RENEW").otherwise("ACQUIRE")
    log = t("events").where("event_id < 900").select(C("user_id").alias("k"), "event_id", op.alias("op"), F.concat(F.lit("w"), (C("event_id") % 5).cast("string")).alias("owner"), C("event_id").alias("at"), F.lit(60).alias("ttl"))
    return changelog.lock_holders(log, "k", "event_id", "op", "owner", "at", "ttl", 900)


@query("SELECT user_id, event_id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS k FROM events WHERE value >= 60) WHERE k = 1")
def live_owners(t):
    return changelog.owners(t("events"), "user_id", "event_id", "value", since=60.0)


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'DELETE' WHEN p_partkey % 2 = 0 THEN 'RENAME' ELSE 'MOVE' END AS kind FROM part")
def moves(t):
    p = t("part").select("p_partkey", F.concat(F.lit("/a/"), C("p_partkey").cast("string")).alias("path"), (C("p_partkey") * 100).alias("at"), (C("p_partkey") * 1_000_003).alias("size"), C("p_partkey").alias("mtime"))
    to = F.when(C("p_partkey") % 2 == 0, F.concat("path", F.lit("x"))).otherwise(F.concat(F.lit("/b"), C("path")))
    close = C("size") + F.when(C("p_partkey") % 3 == 0, 5).otherwise(0)
    out = changelog.pair_moves(p.drop("p_partkey"), p.where("p_partkey % 5 <> 0").select(to.alias("path"), (C("at") + 1).alias("at"), close.alias("size"), "mtime"), 2)
    return out.select(F.substring("from_path", 4, 99).cast("long").alias("k"), "kind")


@query("SELECT p_partkey, p_size * 2 AS doubled, p_name || '!' AS loud FROM part")
def processed_rows(t):
    return t("part").transform(lambda df: df.select("p_partkey", (C("p_size") * 2).alias("doubled"), F.concat("p_name", F.lit("!")).alias("loud")))


@query("SELECT n_nationkey, n_name FROM nation")
def dropped_column(t):
    return t("nation").drop("n_regionkey")


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'c_acctbal:min' END, CASE WHEN c_acctbal > 9000 THEN 'c_acctbal:max' END, CASE WHEN c_custkey % 4 = 0 THEN 'mail:null' END, CASE WHEN c_custkey % 4 = 1 THEN 'mail:pattern' END) AS broken FROM customer")
def mail_violations(t):
    mail = F.when(C("c_custkey") % 4 == 1, "no mail").when(C("c_custkey") % 4 > 1, F.concat(F.lit("u"), C("c_custkey").cast("string"), F.lit("@x.org")))
    c = t("customer").withColumn("mail", mail)
    return c.select("c_custkey", F.array_join(mutate.violations(c, {"c_acctbal": {"min": 0, "max": 9000}, "mail": {"nullable": False, "pattern": r"^[^@\s]+@[^@\s]+\.[a-z]+$"}}), ",").alias("broken"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_quantity > 49) AND (l_discount = 0.0 OR l_tax = 0.08)")
def alternatives_twice(t):
    tree = All([AnyOf([Criterion("EQ", "l_returnflag", "R"), Criterion("GT", "l_quantity", 49.0)]), AnyOf([Criterion("EQ", "l_discount", 0.0), Criterion("EQ", "l_tax", 0.08)])])
    return t("lineitem").where(tree.expr()).select("l_orderkey", "l_linenumber")


@query("SELECT unnest(['events', 'labels', 'lineitem', 'nation', 'orders']) AS name")
def listed_files(t):
    """The second page of the tables' files by name."""
    return tables.list_files(t.spark, t.folder, 2, 5, "*.parquet").select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name"))


@query("SELECT true AS equal_to_itself, false AS equal_without_a_column")
def schema_digests(t):
    n = t("nation")
    own, other = tables.schema_digest(n.schema), tables.schema_digest(n.drop("n_name").schema)
    return t.spark.createDataFrame([(own == tables.schema_digest(t("nation").schema), own == other)], "equal_to_itself boolean, equal_without_a_column boolean")
