"""Queries over the functions for text, dates and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from granum.functions import bits, dates, strings
from granum.registry import query

C = F.col


@query(r"SELECT p_partkey, string_agg('\u' || format('{:04x}', unicode(ch)), '' ORDER BY i) AS coded, any_value(p_name) AS decoded, any_value(p_name) AS unescaped, any_value(p_name) AS through_url, any_value(replace(p_name, ' ', '+')) AS url FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS ch, generate_subscripts(string_split(p_name, ''), 1) AS i FROM part) GROUP BY p_partkey")
def text_codes(t):
    n, coded = C("p_name"), strings.encode_unicode(C("p_name"))
    return t("part").select("p_partkey", coded.alias("coded"), strings.decode_unicode(coded).alias("decoded"), strings.unescape(F.replace(coded, F.lit("\\u"), F.lit("%u"))).alias("unescaped"), strings.url_decode(strings.url_encode(n)).alias("through_url"), strings.url_encode(n).alias("url"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS ascii, strlen(text) AS latin_chars FROM documents")
def charsets(t):
    d = C("text")
    return t("documents").select("doc_id", strings.recode(d, "ascii", "ascii").alias("ascii"), F.length(strings.recode(d, "utf-8", "latin-1")).cast("long").alias("latin_chars"))


@query("SELECT c_custkey, c_name || ' ' || c_mktsegment || ' ' AS connected, '%' || c_name || '%' AS both_ends, '%' || c_name AS left_end, c_name || '%' AS right_end, repeat(c_mktsegment, 3) AS thrice FROM customer")
def text_padding(t):
    return t("customer").select("c_custkey", strings.connect(C("c_name"), F.lit("  "), F.lit(None).cast("string"), C("c_mktsegment")).alias("connected"), strings.padded(C("c_name")).alias("both_ends"), strings.padded(C("c_name"), right="").alias("left_end"), strings.padded(C("c_name"), left="").alias("right_end"), strings.repeated(C("c_mktsegment"), 3).alias("thrice"))


@query("SELECT p_partkey, regexp_full_match(p_brand, '[0-9]+') AS digits, regexp_full_match(p_size::VARCHAR, '[0-9]+') AS size_digits, regexp_full_match(p_retailprice::VARCHAR, '-?[0-9]+(\\.[0-9]+)?') AS decimal_text, regexp_full_match(p_type, '[A-Za-z]+') AS letters, regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS two_digits, p_size % 3 = 0 AS blank, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE p_type END AS defaulted FROM part")
def text_tests(t):
    maybe = F.when(C("p_size") % 6 == 0, "  ").when(C("p_size") % 3 != 0, C("p_type"))
    return t("part").select("p_partkey", strings.is_digits(C("p_brand")).alias("digits"), strings.is_numeric(C("p_size").cast("string")).alias("size_digits"), strings.is_decimal(C("p_retailprice").cast("string")).alias("decimal_text"), strings.is_letters(C("p_type")).alias("letters"), strings.matches(C("p_brand"), "Brand#[0-9]{2}").alias("two_digits"), strings.is_blank(maybe).alias("blank"), strings.or_default(maybe, "none").alias("defaulted"))


@query("SELECT o_custkey, string_agg(o_orderkey, '-' ORDER BY o_orderkey) AS joined, count(*) AS n, sum(o_orderkey)::BIGINT AS total, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS again FROM orders GROUP BY o_custkey")
def join_and_split(t):
    o = t("orders").groupBy("o_custkey").agg(strings.join_items(F.array_sort(F.collect_list("o_orderkey")), "-").alias("joined"))
    parts, longs = strings.split_by(C("joined"), "-"), strings.csv_to_longs(F.replace(C("joined"), F.lit("-"), F.lit(",")))
    return o.select("o_custkey", "joined", F.size(parts).cast("long").alias("n"), F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), strings.join_items(parts, ",").alias("again"))


@query("SELECT page_id, regexp_extract(url, 'utm_source=([^&#]*)', 1) AS source, regexp_extract(url, 'page=([^&#]*)', 1) AS page, coalesce(string_agg(p, ';' ORDER BY p), '') AS pairs FROM (SELECT page_id, url, unnest(CASE WHEN contains(url, '?') THEN string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') ELSE [NULL] END) AS p FROM pages) GROUP BY page_id, url")
def query_pairs(t):
    m = strings.query_parameters(C("url"))
    at = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    pairs = F.when(F.instr("url", "?") > 0, strings.format_pairs(m, ";")).otherwise("")
    return t("pages").select("page_id", at("utm_source").alias("source"), at("page").alias("page"), pairs.alias("pairs"))


@query("SELECT page_id, list_aggregate(regexp_extract_all(url, '[0-9]+'), 'string_agg', ',') AS numbers, regexp_extract(url, '://([^/]*)/', 1) AS middle, regexp_replace(url, '^[^:]*:[^/]*/', '') AS behind FROM pages")
def pattern_parts(t):
    numbers = strings.all_matches(C("url"), "[0-9]+")
    return t("pages").select("page_id", F.when(F.size(numbers) > 0, F.array_join(numbers, ",")).alias("numbers"), strings.between_marks(C("url"), "://", "/").alias("middle"), strings.after_marks(C("url"), ":", "/").alias("behind"))


@query("SELECT p_partkey, regexp_replace(p_name, 'WIDGET', 'thing', 'gi') AS replaced, replace(p_name, ' ', '') AS tight, regexp_replace(p_brand, '[^a-zA-Z0-9]', '_', 'g') AS code, replace(p_brand, '#', '_') AS marks, '(' || p_type || ')' AS brackets, 'x' || p_size AS cut FROM part")
def text_replacement(t):
    between = strings.replace_between(F.concat(F.lit("<"), C("p_name"), F.lit(">"), C("p_size").cast("string")), "<", ">", "x")
    return t("part").select("p_partkey", strings.replace_text(C("p_name"), "WIDGET", "thing").alias("replaced"), strings.without_blanks(C("p_name")).alias("tight"), strings.clean_code(C("p_brand")).alias("code"), strings.clean_marks(C("p_brand")).alias("marks"), strings.plain_brackets(F.concat(F.lit("（"), C("p_type"), F.lit("）"))).alias("brackets"), between.alias("cut"))


@query("SELECT c_custkey, upper(c_mktsegment) AS half, length(c_name) + length(c_mktsegment) * 2 AS width FROM customer")
def text_width(t):
    plain = "".join(map(chr, range(0x41, 0x5B)))
    wide = F.translate(C("c_mktsegment"), plain, "".join(chr(0xFEE0 + ord(c)) for c in plain))
    return t("customer").select("c_custkey", strings.full_to_half(wide).alias("half"), strings.display_width(F.concat(C("c_name"), wide)).cast("long").alias("width"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18, 1)) AS VARCHAR) AS one_place, CASE WHEN c_acctbal > 0 AND c_custkey > 0 THEN c_custkey::VARCHAR ELSE '' END AS positive, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -1 END AS parsed, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE (c_custkey % 3)::VARCHAR END AS money FROM customer")
def number_texts(t):
    text = F.when(C("c_custkey") % 2 == 0, F.concat(F.lit(" "), C("c_custkey").cast("string"))).otherwise("none")
    return t("customer").select("c_custkey", strings.format_number(C("c_acctbal"), 1).alias("one_place"), strings.positive_text(F.when(C("c_acctbal") > 0, C("c_custkey")).otherwise(0)).alias("positive"), strings.number_or(text, "bigint", -1).alias("parsed"), strings.money_text((C("c_custkey") % 3).cast("double")).alias("money"))


@query("SELECT p_partkey, contains(p_name, 'cold') OR contains(p_name, 'old') AS has_any, p_type IN ('ECONOMY', 'STANDARD') AS listed, len(string_split(p_name, 'e')) - 1 AS found, CASE WHEN contains(p_name, 'e') THEN instr(p_name, 'e') END AS first FROM part")
def containment(t):
    places = strings.positions(C("p_name"), "e")
    return t("part").select("p_partkey", strings.contains_any(C("p_name"), ["cold", "old"]).alias("has_any"), strings.is_one_of(C("p_type"), ["ECONOMY", "STANDARD"]).alias("listed"), F.size(places).cast("long").alias("found"), F.try_element_at(places, F.lit(1)).cast("long").alias("first"))


@query("SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) || '@x.org' AS mail FROM customer")
def masked_mail(t):
    return t("customer").select("c_custkey", strings.mask_email(F.concat(C("c_name"), F.lit("@x.org"))).alias("mail"))


_AS_TEXT = "strftime(o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN '%Y%m%d' WHEN 1 THEN '%Y-%m-%d' WHEN 2 THEN '%Y/%m/%d' ELSE '%Y%m%d%H%M%S' END)"


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS any_ms, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE epoch_ms(o_orderdate) END AS english_ms, (o_orderdate::DATE)::VARCHAR AS day, strftime(o_orderdate, '%H:%M:%S') AS clock FROM orders")
def date_parsing(t):
    k, d = C("o_orderkey") % 4, C("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.unix_millis(d.cast("timestamp")).cast("string"))
    english = F.when(k == 0, F.date_format(d, "d MMM yyyy")).when(k == 1, F.upper(F.date_format(d, "MMMM d, yyyy"))).when(k == 2, F.date_format(d, "dd/MMM/yyyy")).otherwise("no date")
    day, clock = dates.local_parts(d)
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return t("orders").select("o_orderkey", ms(dates.parse_any(text)).alias("any_ms"), ms(dates.parse_english(english)).alias("english_ms"), day.cast("string").alias("day"), clock.alias("clock"))


@query("SELECT event_id, strftime(to_timestamp(event_id * 37) AT TIME ZONE 'UTC', '%H:%M:%S') AS clock, event_id * 37000 AS ms, ts::DATE = DATE '2024-01-15' AS today, ts::DATE = DATE '2024-01-14' AS yesterday, true AS dated, date_diff('second', ts::TIMESTAMP_S::TIMESTAMP, TIMESTAMP '2024-06-01') // 3600 AS hours, (date_diff('second', ts::TIMESTAMP_S::TIMESTAMP, TIMESTAMP '2024-06-01') // 86400) || ' days' AS age FROM events WHERE event_id * 37 < 86400 AND ts < TIMESTAMP '2024-05-30'")
def date_tests(t):
    now, clock = F.lit("2024-06-01 00:00:00").cast("timestamp"), dates.millis_to_time(C("event_id") * 37000)
    e = t("events").where("event_id * 37 < 86400 and ts < timestamp_ntz '2024-05-30 00:00:00'")
    ts = C("ts").cast("timestamp")
    second = dates.nearest_second(ts)  # as the SQL's cast to TIMESTAMP_S rounds it
    day = F.lit("2024-01-15").cast("date")
    return e.select("event_id", clock.alias("clock"), dates.time_to_millis(clock).alias("ms"), dates.is_same_day(ts, day).alias("today"), dates.is_same_day(ts, day, 1).alias("yesterday"), dates.is_date_time(F.date_format(ts, "yyyy-MM-dd")).alias("dated"), dates.difference_in("hour", now, second).alias("hours"), dates.readable_age(now, second).alias("age"))


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS hexed, c_name AS back, TRY_CAST(substr(c_name, 10) AS BIGINT) AS number, TRY_CAST(c_mktsegment AS BIGINT) AS none, CAST(round(CAST(c_acctbal AS DECIMAL(18, 2)), 1) AS DOUBLE) AS rescaled FROM customer")
def number_functions(t):
    hexed = bits.hex_of(C("c_name"))
    return t("customer").select("c_custkey", hexed.alias("hexed"), bits.from_hex(hexed).alias("back"), bits.coerce(F.substring("c_name", 10, 99), "bigint").alias("number"), bits.coerce(C("c_mktsegment"), "bigint").alias("none"), bits.rescale(C("c_acctbal"), 1).cast("double").alias("rescaled"))


@query("SELECT count(*) AS n, count(DISTINCT c_name) AS different FROM customer")
def hashed_rows(t):
    return t("customer").select(bits.hash64(C("c_name")).alias("h")).agg(F.count("h").alias("n"), F.count_distinct("h").alias("different"))


GLOBS = (["**/en/**", "*.html"], ["https://*/**"])


@query("SELECT page_id, NOT regexp_full_match(url, 'https://[^/]*/.*') AND regexp_full_match(url, '(.*/)?en/.*|[^/]*\\.html') AS passes, NOT regexp_full_match(url, 'https://[^/]*/.*') AS unless_secure FROM pages")
def glob_filter(t):
    include, exclude = GLOBS
    return t("pages").select("page_id", strings.path_passes(C("url"), include, exclude).alias("passes"), strings.path_passes(C("url"), [], exclude).alias("unless_secure"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS repeats FROM part")
def repeated_content(t):
    text = F.when(C("p_partkey") % 3 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 12)).when(C("p_partkey") % 3 == 1, F.concat("p_name", F.lit("-"), "p_type", F.lit("!")))
    # The table is few files, so its rows are dealt to all cores for the work on their texts.
    return t("part").repartition(3 * t.spark.sparkContext.defaultParallelism).select("p_partkey", strings.repeats_itself(text).alias("repeats"))
