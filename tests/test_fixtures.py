"""Small literal cases with known results, and the streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from granum.functions import bits, dates, strings
from granum.functions.predicates import EMBEDDED, WIRE, All, AnyOf, Criterion, positional
from granum.operators import changelog, metrics, mutate
from granum.plans.query import Query
from granum.sources.tables import evolve, list_files, schema_digest
from granum.streaming import events


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", 25, 500, "sh"), (2, "b", 30, 600, "sh"), (3, "c", 35, 700, "gz"), (4, "d", 40, 800, "sh"), (5, None, None, None, None)]
    return spark.createDataFrame(rows, "id int, name string, age int, score int, city string")


def ids(df):
    return [r.id for r in df.orderBy("id").collect()]


def test_or_inside_and(people):
    q = Query([Criterion("EQ", "city", "sh"), AnyOf([Criterion("EQ", "age", 30), Criterion("EQ", "score", 800)])])
    assert ids(q.rows(people)) == [2, 4]


@pytest.mark.parametrize("op,a,embedded,wire", [("NE", 25, [2, 3, 4, 5], [2, 3, 4]), ("LT", 30, [1, 5], [1]), ("LE", 25, [1, 5], [1]), ("NOT_IN", [25, 40], [2, 3, 5], [2, 3]), ("IN", [25, None], [1, 5], [1]), ("IN", [], [], []), ("GT", 30, [3, 4], [3, 4]), ("GT", None, [1, 2, 3, 4], None), ("LT", None, [5], None)])
def test_null_rules(people, op, a, embedded, wire):
    assert ids(people.where(Criterion(op, "age", a).expr(EMBEDDED))) == embedded
    if wire is not None:
        assert ids(people.where(Criterion(op, "age", a).expr(WIRE))) == wire


def test_null_order_and_slice(people):
    order = lambda d, s: [r.id for r in Query(dialect=d).sort(s).find(people).collect()]
    assert order(EMBEDDED, "age")[-1] == 5 and order(EMBEDDED, "age desc")[0] == 5
    assert order(WIRE, "age")[0] == 5 and order(WIRE, "age desc")[-1] == 5
    assert [r.id for r in Query().sort("age desc").find(people, 1, 2).collect()] == [4, 3]


def test_unknown_column(people):
    assert Query([Criterion("IS_NULL", "nothing")]).rows(people).count() == 5
    with pytest.raises(ValueError):
        Query([Criterion("EQ", "nothing", 1)], dialect=WIRE).rows(people)
    with pytest.raises(ValueError):
        positional("a,b", [1])


def test_chunks(people):
    parts = list(Query([Criterion("IS_NOT_NULL", "age")]).sort("age").chunks(people, 2))
    assert [([r.age for r in rows], last) for rows, last in parts] == [([25, 30], False), ([35, 40], True)]
    assert [len(rows) for rows, _ in Query().chunks(people, 2, 3)] == [2, 1]


def test_moves(spark):
    d = spark.createDataFrame([("/a/x", 100, 7, 1), ("/a/y", 100, 9, 1), ("/a/z", 100, 50_000_000, 1)], "path string, at long, size long, mtime long")
    c = spark.createDataFrame([("/a/x2", 101, 7, 1), ("/b/y", 101, 10, 1)], "path string, at long, size long, mtime long")
    got = {r.from_path: (r.kind, r.to_path) for r in changelog.pair_moves(d, c, 2).collect()}
    assert got == {"/a/x": ("RENAME", "/a/x2"), "/a/y": ("MOVE", "/b/y"), "/a/z": ("DELETE", None)}


def test_strings(spark):
    row = spark.range(1).select(
        strings.full_to_half(F.lit("ＡＢ　１")).alias("half"), strings.display_width(F.lit("ab中")).alias("width"), strings.mask_email(F.lit("anna@x.org")).alias("mail"),
        strings.csv_to_longs(F.lit("1, 2,,-3")).alias("longs"), strings.format_pairs(strings.parse_pairs(F.lit("b=2&a=1"))).alias("pairs"), strings.between_marks(F.lit("x[a(b]y"), "[", "]").alias("mid"),
        strings.or_default(F.lit("  "), "d").alias("dflt"), strings.path_passes(F.lit("a/b.txt"), ["**/*.txt"], []).alias("yes"), strings.path_passes(F.lit("x.txt"), ["**/*.txt"], ["x*"]).alias("no"),
    ).first()
    assert tuple(row) == ("AB 1", 4, "a***@x.org", [1, 2, -3], "a=1&b=2", "a(b", "d", True, False)


def test_dates(spark):
    texts = spark.createDataFrame([("2024-02-29",), ("20240229103000",), ("2024/02/29 10:30:00",), ("1709202600000",), ("nope",)], "s string")
    got = [r[0] for r in texts.select(dates.parse_any(F.col("s"))).collect()]
    assert got == [dt.datetime(2024, 2, 29), *[dt.datetime(2024, 2, 29, 10, 30)] * 3, None]
    assert dates.fuzzy_span("202402") == (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 29, 23, 59, 59, 999999))
    assert spark.range(1).select(dates.millis_to_time(F.lit(90_061_000))).first()[0] == "25:01:01"


def test_bits_and_geohash(spark):
    packed = bits.pack_fields([(F.lit(5), 2, 5), (F.lit(True).cast("int"), 0, 0)])
    row = spark.range(1).select(packed.alias("p"), bits.bit_field(packed, 2, 5).alias("f"), bits.geohash(F.lit(10.40744), F.lit(57.64911), 9).alias("g")).first()
    assert tuple(row) == (21, 5, "u4pruydqq")


def test_violations_and_evolution(spark):
    df = spark.createDataFrame([(1, None), (200, "toolongname")], "age int, name string")
    rules = {"age": {"max": 150}, "name": {"nullable": False, "length": 8}}
    assert [r[0] for r in df.select(mutate.violations(df, rules)).collect()] == [["name:null"], ["age:max", "name:length"]]
    from pyspark.sql.types import _parse_datatype_string as schema_of

    new = schema_of("name string, extra long, note string")
    assert [tuple(r) for r in evolve(df, new, {"extra": 42, "note": "n"}).collect()] == [(None, 42, "n"), ("toolongname", 42, "n")]
    assert schema_digest(new) != schema_digest(df.schema)


def test_list_files(spark, tmp_path):
    for n in "cab":
        (tmp_path / f"{n}.txt").write_text(n)
    assert [r.path[-5:] for r in list_files(spark, str(tmp_path), 1, 2).collect()] == ["a.txt", "b.txt"]
    assert list_files(spark, str(tmp_path), 2, 2).count() == 1


def test_percent_of_nothing(spark):
    assert spark.range(1).select(metrics.percent(F.lit(1), F.lit(0))).first()[0] == 0


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0), "a", 1.0), (1, dt.datetime(2024, 1, 1, 0, 0), "a", 1.0), (2, dt.datetime(2024, 1, 1, 0, 30), "a", 2.0), (3, dt.datetime(2024, 1, 1, 5, 0), "b", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(str(source))
    stream = events.watch_files(spark, str(source), df.schema).drop("path")
    seen = []
    events.into_view(events.once(stream, "event_id", "ts"), lambda b, i: seen.extend(r.event_id for r in b.collect()), str(tmp_path / "c1")).awaitTermination()
    assert sorted(seen) == [1, 2, 3]
    out = []
    q = events.windowed(stream, "ts", "kind", "value", "1 hour").writeStream.outputMode("update").foreachBatch(lambda b, i: out.extend((r.kind, r.n, r.total) for r in b.collect()))
    q.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert ("a", 3, 4.0) in out and ("b", 1, 3.0) in out


def test_wire_refuses_null_operands(people):
    for op in ("EQ", "NE", "GT", "LE", "LIKE", "BETWEEN"):
        with pytest.raises(ValueError):
            Criterion(op, "age").expr(WIRE)
    with pytest.raises(ValueError):
        Criterion("NEAR", "age", 1).expr(EMBEDDED)
    with pytest.raises(ValueError):
        Criterion("EQ", "@composite:age,name", 1).expr(WIRE)


def test_cancelled_chunks(people):
    asked = iter([True, True, False])
    assert [([r.id for r in rows], last) for rows, last in Query().sort("id").chunks(people, 1, go_on=lambda: next(asked))] == [([1], False), ([2], True)]


def test_stop_tagged(spark):
    spark.addTag("mine")
    assert events.stop_tagged(spark, "nobody") == [] and spark.range(3).count() == 3
    spark.removeTag("mine")


def test_lookup_of_duplicates(spark):
    from granum.operators import enrich

    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    target = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 0, "z", 7), (None, 1, "n", 1)], "k int, at int, x string, y int")
    got = {r.k: (r.x, r.y) for r in enrich.lookup(left, target, ("k", "k"), {"x": "x", "y": "y"}, "at").select(left["k"], "x", "y").collect()}
    assert got == {1: ("a", 5), 2: (None, None), None: (None, None)}


def test_allocated_ids_of_ties(spark):
    rows = spark.range(1000).selectExpr("id % 3 as o", "id as v").repartition(7)
    got = sorted((r.id, r.o) for r in mutate.allocate_ids(rows, 10, "o").collect())
    assert [i for i, _ in got] == list(range(10, 1010)) and [o for _, o in got] == sorted(o for _, o in got)
    assert mutate.allocate_ids(rows.limit(0), 1, "o").count() == 0


def test_bulk_move(spark):
    """A thousand equal files moved at once make a thousand pairs; who loses its best create takes the next."""
    d = spark.range(1000).selectExpr("concat('/a/', id) as path", "100L as at", "7L as size", "1L as mtime")
    c = spark.range(1000).selectExpr("concat('/b/', id) as path", "101L as at", "7L as size", "1L as mtime")
    got = changelog.pair_moves(d, c, 2).collect()
    assert len({r.to_path for r in got}) == 1000 and {r.kind for r in got} == {"MOVE"} and {r.score for r in got} == {0}
    d = spark.createDataFrame([("/a/1", 100, 10, 1), ("/a/2", 100, 11, 1)], "path string, at long, size long, mtime long")
    c = spark.createDataFrame([("/a/3", 101, 12, 1), ("/a/4", 101, 30, 1)], "path string, at long, size long, mtime long")
    assert {r.from_path: (r.to_path, r.score) for r in changelog.pair_moves(d, c, 2).collect()} == {"/a/2": ("/a/3", 1), "/a/1": ("/a/4", 20)}


def test_more_strings(spark):
    row = spark.range(1).select(
        strings.unescape(F.lit("a%u4e2d%41%zz")).alias("a"), strings.decode_unicode(F.lit("x\\u4e2d\\ud83d\\ude00")).alias("b"), strings.encode_unicode(F.lit("é中")).alias("c"), strings.first_letters(F.lit("中国abC")).alias("d"),
        strings.recode(F.lit("中a"), "gbk", "gbk").alias("e"), strings.url_decode(F.lit("%zz")).alias("f"), strings.connect(F.lit("a"), F.lit(None).cast("string"), F.lit(" "), F.lit("b")).alias("g"),
        strings.split_by(F.lit("1x2X3xx"), "x").alias("h"), strings.after_marks(F.lit("ab:c/d"), ":", "/", "?").alias("i"), strings.positions(F.lit("ababa"), "ba").alias("j"), strings.clean_marks(F.lit("a#b\\c！")).alias("k"),
        strings.money_text(F.lit(2.5)).alias("l"), strings.number_or(F.lit("x"), "double", 1.5).alias("m"), strings.format_number(F.lit(2.345), 2).alias("n"), strings.strip_html(F.lit("<p>a&lt;b<script>x</script>")).alias("o"),
        strings.is_blank(F.lit(None).cast("string")).alias("p"), strings.query_parameters(F.lit("http://a/?x=1&y=2#z")).alias("q"),
    ).first()
    assert tuple(row) == ("a中A%zz", "x中😀", "\\u00e9\\u4e2d", "zgabc", "中a", None, "a b ", ["1", "2", "3"], "d", [2, 4], "a_b_c_", "2.5", 1.5, "2.35", "a<b", True, {"x": "1", "y": "2"})


def test_more_dates_and_numbers(spark):
    texts = ["29 Feb 2024", "FEBRUARY 29, 2024", "29-Feb-2024", "Thu, 29 Feb 2024", "Feb 29, 2024", "no"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").select(dates.parse_english(F.col("s"))).collect()]
    assert got == [dt.datetime(2024, 2, 29)] * 5 + [None]
    t = lambda x: F.lit(x).cast("timestamp")
    row = spark.range(1).select(dates.readable_age(t("2024-01-02 00:00:00"), t("2024-01-01 23:00:00")).alias("a"), bits.rescale(F.lit("2.345").cast("decimal(10,3)"), 2).cast("string").alias("b"), bits.rescale(F.lit("-2.345").cast("decimal(10,3)"), 2).cast("string").alias("c"), bits.from_hex(F.lit("ff")).alias("d"), bits.coerce(F.lit("x"), "int").alias("e")).first()
    assert tuple(row) == ("1 hour", "2.35", "-2.35", None, None)
    assert bits.geohash_text(10.40744, 57.64911, 9) == "u4pruydqq"


def test_live_view_stream(spark, tmp_path):
    source = tmp_path / "puts"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for i, rows in enumerate([[("a", at(0), 1.0, 60), ("b", at(0), 2.0, -1), ("a", at(1), 3.0, 120)], [("c", at(40), 9.0, -1)], [("c", at(50), 8.0, -1)]]):
        spark.createDataFrame(rows, "k string, ts timestamp, v double, ttl long").coalesce(1).write.mode("append").parquet(str(source))
    df = spark.read.parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen = []
    q = events.live_view(stream, "k", "ts", "v", "ttl", "1 minute").writeStream.outputMode("append").foreachBatch(lambda b, i: seen.extend(map(tuple, b.collect())))
    q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for k, v, _ in seen:
        last[k] = v
    assert last["b"] == 2.0 and last["c"] in (8.0, 9.0) and last["a"] is None  # a has expired
    owners = []
    q = events.path_owners(stream, "k", "v", "ts").writeStream.outputMode("update").foreachBatch(lambda b, i: owners.extend(map(tuple, b.collect())))
    q.option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert ("b", 2.0) in owners and owners.count(("a", 3.0)) == 1


def test_kept_view_over_batches(spark, tmp_path):
    source = tmp_path / "log"
    for rows in ([(1, 1, "PUT", "a"), (2, 2, "PUT", "b")], [(1, 3, "DEL", None), (3, 4, "PUT", "c")], [(1, 2, "PUT", "late"), (2, 5, "PUT", "d")]):
        spark.createDataFrame(rows, "k long, seq long, op string, v string").coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    view, check = str(tmp_path / "view"), str(tmp_path / "check")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    assert events.read_view(spark, view, "op", "DEL") is None
    events.keep_view(stream, view, "k", "seq", check).awaitTermination()
    got = lambda: {r.k: r.v for r in events.read_view(spark, view, "op", "DEL").collect()}
    assert got() == {2: "d", 3: "c"}
    spark.createDataFrame([(1, 9, "PUT", "back")], "k long, seq long, op string, v string").write.mode("append").parquet(str(source))
    events.keep_view(stream, view, "k", "seq", check).awaitTermination()
    assert got() == {1: "back", 2: "d", 3: "c"}


def test_repeats_itself(spark):
    texts = ["ab" * 50, "abcdefghij" * 3, "the quick brown fox jumps", "aaaaabcdefgh", "aaaabcdefghi", "x" * 1500 + "".join(chr(200 + i) for i in range(1500)), "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").select(strings.repeats_itself(F.col("s"))).collect()]
    assert got == [True, True, False, False, False, True, False, False]


def test_differences_to_the_microsecond(spark):
    """0.6 s short of an hour is no hour; a second counts as the nearest one, as DuckDB's TIMESTAMP_S does."""
    t = lambda x: F.lit(x).cast("timestamp")
    now, old = t("2024-06-01 00:00:00"), t("2024-05-31 23:00:00.6")
    row = spark.range(1).select(dates.difference_in("hour", now, old), dates.difference_in("hour", old, now), dates.readable_age(now, old), *[dates.nearest_second(t(f"2024-01-01 00:00:0{x}")).cast("string") for x in ("0.499999", "0.5", "9.6")]).first()
    assert tuple(row) == (0, 0, "59 minutes", "2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:10")


def test_date_tests_round_seconds(spark, tmp_path):
    from granum.queries import QUERIES

    rows = [(1, dt.datetime(2024, 1, 1, 20, 0, 0, 700_000)), (2, dt.datetime(2024, 1, 1, 20, 0, 0, 300_000)), (3, dt.datetime(2024, 1, 1, 0, 0, 0, 500_000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    got = [(r.event_id, r.hours, r.age) for r in QUERIES["date_tests"](spark, str(tmp_path)).orderBy("event_id").collect()]
    assert got == [(1, 3627, "151 days"), (2, 3628, "151 days"), (3, 3647, "151 days")]


def test_expired_a_second_ago(spark):
    """A value that ended one second before now is gone; its -1 isn't that of a value without end."""
    puts = spark.createDataFrame([("a", 659, 1.0, 40), ("b", 661, 2.0, 40), ("c", 1, 3.0, -1), ("d", 660, 4.0, 40)], "k string, at long, v double, ttl int")
    live = changelog.live_values(puts, "k", "at", "v", "ttl", 700)
    assert sorted(map(tuple, live.collect())) == [("b", 2.0, 1), ("c", 3.0, -1)]
    got = changelog.read_values(live, puts.select("k"), "k", "v").collect()
    assert sorted(map(tuple, got)) == [("a", None, -2), ("b", 2.0, 1), ("c", 3.0, -1), ("d", None, -2)]


def test_live_keys_round_millis(spark, tmp_path):
    """0.9996 s is the next second, as DuckDB's epoch_ms has it; of puts at one second the first row in the file counts."""
    from granum.queries import QUERIES

    at = lambda s, us: dt.datetime(2024, 1, 31, 0, 0, s, us)
    rows = [(1, 7, at(8, 999_600), 1.0), (1, 8, at(5, 0), 9.0), (2, 7, at(8, 999_400), 2.0), (3, 6, at(1, 100), 3.0), (3, 7, at(1, 900_000), 4.0), (3, 9, at(0, 900_000), 5.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, QUERIES["live_keys"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1.0, 6 * 86400 + 9), (2, 2.0, 6 * 86400 + 8), (3, 3.0, -1)]


def test_list_folders(spark, tmp_path):
    """A table written as a folder is one entry beside those that are files."""
    (tmp_path / "c.txt").write_text("c")
    for n in ("b.txt", "_b.txt", "d.csv"):
        (tmp_path / n).mkdir()
        for part in ("1", "22", "_333"):
            (tmp_path / n / f"{part}.bin").write_text(part)
    (tmp_path / "a.txt").write_text("aaaa")
    got = [(r.path.rsplit("/", 1)[1], r.length) for r in list_files(spark, f"{tmp_path}/", glob="*.txt").collect()]
    assert got == [("a.txt", 4), ("b.txt", 3), ("c.txt", 1)]
    assert [r.path.rsplit("/", 1)[1] for r in list_files(spark, str(tmp_path), 2, 2).collect()] == ["c.txt", "d.csv"]
    assert [r.path.rsplit("/", 1)[1] for r in list_files(spark, str(tmp_path), glob="{a,c}.t[x]?").collect()] == ["a.txt", "c.txt"]
    assert list_files(spark, str(tmp_path), glob="*.none").count() == 0


def test_lookup_of_tied_lines(spark, tmp_path):
    """Of lines that share their number the first in the table counts, though Spark reads the larger file first."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from granum.queries import QUERIES

    pq.write_table(pa.table({"o_orderkey": range(10), "o_orderstatus": ["F"] * 10}), tmp_path / "orders.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for file, n, part in (("a", 10, 1), ("b", 50_000, 2)):
        lines = {"l_orderkey": [i % 10 for i in range(n)], "l_linestatus": ["F"] * n, "l_returnflag": ["N"] * n, "l_linenumber": pa.array([1] * n, pa.int32()), "l_partkey": [part] * n, "l_quantity": [float(i) for i in range(n)]}
        pq.write_table(pa.table(lines), tmp_path / "lineitem.parquet" / f"{file}.parquet")
    got = QUERIES["lookup_two_keys"](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.part, r.qty) for r in got) == [(k, 1, float(k)) for k in range(10)]


def test_no_sketch_for_each_order(spark):
    """The approximate count is no part of an aggregation by order, which would hold a sketch for every one."""
    from granum.queries import QUERIES

    df = QUERIES["approximate_count"](spark, "/root/testdata/sf0.001")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("keys=[l_orderkey" in x for x in lines) and not any("keys=[l_orderkey" in x and "approx_count_distinct" in x for x in lines)
    assert df.first().near


def test_moves_broadcast_nothing(spark):
    """No join of pair_moves collects a side in the driver, in any of its rounds."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    d = spark.range(300).selectExpr("concat('/a/', id) as path", "100 * id as at", "1000003 * id as size", "id as mtime")
    c = spark.range(250).selectExpr("concat('/b/', id) as path", "100 * id + 1 as at", "1000003 * id + id % 3 as size", "id as mtime")
    kinds = [r.kind for r in changelog.pair_moves(d, c, 2).collect()]
    assert (kinds.count("MOVE"), kinds.count("DELETE")) == (250, 50)
    names = set()
    for i in range(store.executionsList().size()):
        if (n := store.executionsList().apply(i).executionId()) not in before:
            nodes = store.planGraph(n).allNodes()
            names |= {nodes.apply(k).name() for k in range(nodes.size())}
    assert any("SortMergeJoin" in n for n in names) and not any("Broadcast" in n for n in names)


def test_repeats_as_by_all_neighbours(spark):
    """Against a look at every pair of neighbours, on short and long texts with runs of any place; a text without runs takes little time."""
    import random
    import time

    def plain(text):
        thousands = -(-len(text) // 1000)
        tried = next((n * thousands for below, n in strings.PIECES_TRIED.items() if thousands < below), strings.MOST_TRIED)
        for size in range(1, min(tried, len(text))):
            pieces, run, longest = [text[i : i + size] for i in range(0, len(text) // size * size, size)], 0, 0
            for x, y in zip(pieces, pieces[1:]):
                run = run + 1 if x == y else 0
                longest = max(longest, run)
            if longest > strings.REPEATED_SHARE * -(-len(text) // size):
                return True
        return False

    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choice("ab\U0001f469") for _ in range(n))
    texts = [letters(rnd.randint(0, 12)) + letters(rnd.randint(1, 9)) * rnd.randint(0, 9) + letters(rnd.randint(0, 25)) for _ in range(2000)]
    texts += [letters(rnd.randint(0, 900)) + letters(rnd.randint(1, 300)) * rnd.randint(1, 9) + letters(rnd.randint(0, 900)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    got = dict(map(tuple, df.select("i", strings.repeats_itself(F.col("s"))).collect()))
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert got == want and 0 < sum(want.values()) < len(want)
    many = spark.range(0, 20_000, numPartitions=1).select(F.concat(F.lit("the quick brown fox jumps over a lazy dog and sees "), F.sha2(F.col("id").cast("string"), 512)).alias("s"))
    began = time.time()
    assert many.where(strings.repeats_itself(F.col("s"))).count() == 0
    assert time.time() - began < 6


def test_removal_deals_rows(spark, monkeypatch):
    """Partitions grow with the rows, and nothing else changes."""
    monkeypatch.setattr(mutate, "ROWS_DEALT", 100)
    table, links = spark.range(1000).withColumnRenamed("id", "k"), spark.range(3000).selectExpr("id % 1000 as l")
    left, linked = mutate.remove_with_relations(table, links, table.where("k % 2 = 0"), "k", "l")
    assert (left.rdd.getNumPartitions(), linked.rdd.getNumPartitions()) == (10, 30)
    assert left.where("k % 2 = 1").count() == left.count() == 500 and linked.where("l % 2 = 1").count() == linked.count() == 1500


def moves_by_rounds(deletes, creates, seconds, most):
    """The rounds of pair_moves one by one on groups (at, size, mtime, number): how many of each pair of groups."""
    d, c, got = {x[:3]: x[3] for x in deletes}, {x[:3]: x[3] for x in creates}, {}
    score = lambda x, y: abs(x[1] - y[1]) + 1000 * abs(x[2] - y[2])
    while True:
        asked = {}
        for x in d:
            options = [(score(x, y), y) for y in c if c[y] and 0 <= y[0] - x[0] <= seconds and score(x, y) <= most] if d[x] else []
            if options:
                s, y = min(options)
                asked.setdefault(y, []).append((s, x))
        if not asked:
            return got
        for y, by in asked.items():
            for _, x in sorted(by):
                n = min(d[x], c[y])
                d[x], c[y], got[x, y] = d[x] - n, c[y] - n, got.get((x, y), 0) + n
        got = {k: n for k, n in got.items() if n}


def test_moves_until_no_pair_is_left(spark, monkeypatch):
    """All deletes ask for one create, sixty times over: as many rounds, and as many moves. Copies that got another mtime all move."""
    schema = "path string, at long, size long, mtime long"
    d = spark.createDataFrame([(f"/a/{i}", 100, i, 1) for i in range(60)] + [(None, 100, 5, 1), ("/a/none", 100, None, 1)], schema)
    c = spark.createDataFrame([(f"/b/{i}", 101, 100 + i, 1) for i in range(60)], schema)
    want = {f"/a/{59 - i}": f"/b/{i}" for i in range(54)}
    for candidates in (changelog.CANDIDATES, 300):
        monkeypatch.setattr(changelog, "CANDIDATES", candidates)
        got = changelog.pair_moves(d, c, 2).collect()
        assert len(got) == 62 and len({r.to_path for r in got if r.to_path}) == 60
        assert {r.from_path: r.to_path for r in got if r.from_path in want} == want
    d = spark.range(3000).selectExpr("concat('/a/', id) as path", "100L as at", "7L as size", "1L as mtime")
    c = spark.range(3000).selectExpr("concat('/b/', id) as path", "101L as at", "7L as size", "2L as mtime")
    for candidates in (1000, 1):
        monkeypatch.setattr(changelog, "CANDIDATES", candidates)
        got = changelog.pair_moves(d, c, 2).collect()
        assert len({r.to_path for r in got}) == 3000 and {r.score for r in got} == {1000}


def test_moves_as_by_rounds(spark, monkeypatch):
    """Every round as a job, some in one task, and all in one task give the pairs of rounds one by one."""
    import random
    from collections import Counter

    rnd = random.Random(3)
    groups = lambda top: [(*k, n) for k, n in Counter((100 + rnd.randint(0, 4), 20 * rnd.randint(0, 30) + top, rnd.randint(1, 2)) for _ in range(60)).items()]
    deletes, creates = groups(0), groups(7)  # no size is equal, so that all is left to the rounds
    rows = lambda side, groups: spark.createDataFrame([(f"/{side}/{i}-{k}", at, size, m) for i, (at, size, m, n) in enumerate(groups) for k in range(n)], "path string, at long, size long, mtime long")
    of = lambda groups, path: groups[int(path.split("/")[2].split("-")[0])][:3]
    want = moves_by_rounds(deletes, creates, 2, 1200)
    for candidates in (1, 200, 10_000):
        monkeypatch.setattr(changelog, "CANDIDATES", candidates)
        got = changelog.pair_moves(rows("a", deletes), rows("b", creates), 2, 1200).collect()
        pairs = [(r.from_path, r.to_path) for r in got if r.to_path]
        assert len(got) == len({x for x, _ in pairs}) + sum(r.kind == "DELETE" for r in got) == 60 and len({y for _, y in pairs}) == len(pairs)
        assert Counter((of(deletes, x), of(creates, y)) for x, y in pairs) == want


def test_repeats_at_every_length(spark, monkeypatch):
    """Pieces longer than a hundred, two hundred or three thousand characters count too; all lengths at once give what each alone gives."""
    import random
    import time

    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abcde") for _ in range(n))
    long, long_a = letters(300_000), "a" * 117_000
    texts = [letters(n) * k for n, k in ((101, 2), (700, 2), (1500, 3), (5000, 2), (100_000, 3))] + [letters(400) + letters(400) * 2, long, long_a + long[117_000:]]
    texts.append((x := letters(250)) * 6 + letters(800) + x)  # five equal neighbours of eleven pieces
    began = time.time()
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "s string").coalesce(1).select(strings.repeats_itself(F.col("s"))).collect()]
    assert got == [True] * 5 + [False] * 3 + [True] and time.time() - began < 30

    def plain(text):
        return any(run > strings.REPEATED_SHARE * -(-len(text) // size) for size in range(1, len(text)) for run in runs(text, size))

    def runs(text, size):
        n = 0
        for i in range(size, len(text) // size * size, size):
            n = n + 1 if text[i : i + size] == text[i - size : i] else 0
            yield n

    short = ["ab"[rnd.randint(0, 1)] * rnd.randint(1, 6) + letters(rnd.randint(0, 5)) * rnd.randint(1, 5) + letters(rnd.randint(0, 9)) for _ in range(2000)]
    want = [plain(x) for x in short]
    assert [strings._repeats_at_any(x) for x in short] == want and 0 < sum(want) < 2000
