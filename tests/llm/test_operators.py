"""The numbered operators against SQL, brute force, the tokenizers' own libraries, and hard rows."""

import html as html_lib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granum.llm import evidence, minhash_dedup, pivot_dedup, piece_codec, queries, quality_rules, shuffle_shards, site_quality, soft_mixing, sql, token_counts, url_filter, wrapper_induction
from granum.llm.common import forest
from granum.llm.components import components

DATA = "/root/testdata/sf0.001"
SPACE = re.compile("[\x20\x09-\x0d]+")
HARD = [None, "", " \t\n", "a", "a", "One two", "é ü\x00 \U0001f469", "x" * 30_000, "the end of " * 6_000, "a b c d e f g h " * 4, "l1\nl2\nl1\n \n", "\u2581 \u00a0 \x1c x"]


@pytest.fixture(scope="module")
def hard(spark):
    """Null ids and texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "s" if i % 2 else None, None, i) for i, t in enumerate(HARD)] + [(5, "One two", "s", None, 5), (None, "a", "s", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long").withColumn("kept", F.lit(7)).withColumn("id", F.lit("x")).withColumn("bucket", F.lit(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def duck(text):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.execute(text)
    return [d[0] for d in r.description], r.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    cols, want = duck(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, want))


def test_components_and_forest(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if n in got} and set(got) == {n for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    near = {(0, 2), (2, 3), (1, 4)}
    assert len(forest(5, lambda i, js: np.array([(i, j) in near for j in js]))) == 3


# 1


def brute_links(rows):
    good = {i: np.array(v, float) for i, (v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {(i, j) for i in good for j in good if i != j and rows[i][1] is not None and rows[i][1] == rows[j][1] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.98}


def test_vectors_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_dedup, "BLOCK", 8)  # many blocks for a list
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = rng.normal(size=64)
        rows += [((base + rng.normal(size=64) * s).tolist(), k % 3) for s in (0, 0.05, 0.14, 0.16, 0.18, 0.2)]
    rows += [rows[0], rows[0], ([0.0] * 64, 1), (None, 1), ([float("nan")] * 64, 1), ([1.0, None], 1), (rows[0][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([], 0)]
    df = spark.createDataFrame([(i, v, l, 1) for i, (v, l) in enumerate(rows)], "vec_id long, embedding array<float>, label int, n int")
    rows = [([float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, l) for v, l in rows]
    got = {r.vec_id: r for r in pivot_dedup.near_vectors(df).collect()}
    links = brute_links(rows)
    n = Counter(i for i, _ in links)
    assert {i: got[i].n_links for i in got} == {i: n[i] for i in range(len(rows))}  # recall 1
    comp = list(range(len(rows)))
    for _ in range(len(rows)):
        for i, j in links:
            comp[i] = min(comp[i], comp[j])
    assert [got[i].component_id for i in range(len(rows))] == comp
    assert all(got[i].kept == (comp[i] == i) for i in got)
    assert pivot_dedup.near_vectors(df.limit(0)).count() == 0


# 2 and 7


def test_site_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet"), spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in site_quality.judge_sites(docs, train, carry=["doc_id"]).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert len(got) == docs.count()
    assert sum((q == 1) == k for q, k in held) / len(held) > 0.93
    assert sum(k for q, k in held if q == 1) / sum(q == 1 for q, _ in held) > 0.97


def test_hard_rows_sites_and_mixing(hard, labels):
    a = site_quality.judge_sites(hard, labels)
    assert a.count() == hard.count() and set(hard.columns) <= set(a.columns)
    assert site_quality.judge_sites(hard.limit(0), labels, carry=["doc_id"]).count() == 0
    b = soft_mixing.mix_softly(hard, labels, carry=["doc_id"]).collect()
    assert len(b) == hard.count() and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in b)
    assert len({(r.rate, r.copies) for r in b if r.doc_id == 5}) == 1
    assert soft_mixing.mix_softly(hard.limit(0), labels, carry=["doc_id"]).count() == 0
    assert soft_mixing.mix_softly(hard, labels.limit(0), carry=["doc_id"]).where("copies = 1").count() == hard.count()


def test_rates_meet_targets(spark):
    rows = [(float(10 + i % 7), 0.9 if i % 3 else 0.1, 0.1 if i % 3 else 0.9) for i in range(300)]
    known = spark.createDataFrame(rows, "n_tokens double, p_a double, p_b double")
    rate, miss = soft_mixing.fit_rates(known, {"a": 0.5, "b": 0.5})
    assert max(map(abs, miss)) < 0.02
    got = known.withColumn("r", rate).agg(F.sum(F.expr("r * n_tokens * p_a")).alias("a"), F.sum(F.expr("r * n_tokens * p_b")).alias("b"), F.min("r").alias("least")).first()
    assert abs(got.a - got.b) < 0.03 * got.a and got.least >= 0
    assert soft_mixing.reachable(np.array([0.9, 0.1]), np.array([0.999, 0.001]), 4.0)[1] == pytest.approx(0.004)


def test_rates_meet_targets_of_overlapping_domains(spark):
    rng = np.random.default_rng(6)
    raw = rng.dirichlet([3.0, 0.8, 0.9], 2000) ** 2 + 1e-6
    raw /= raw.sum(1, keepdims=True)
    known = spark.createDataFrame([(float(n), *map(float, p)) for n, p in zip(rng.integers(5, 500, 2000), raw)], "n_tokens double, p_a double, p_b double, p_c double")
    sums = [F.sum(F.expr(f"r * n_tokens * p_{d}")).alias(d) for d in "abc"] + [F.sum("n_tokens").alias("n"), F.min("r").alias("least")]
    for targets in ({"a": 0.9, "b": 0.02, "c": 0.08}, {"a": 0.2, "b": 0.3, "c": 0.5}):
        rate, miss = soft_mixing.fit_rates(known, targets)
        got = known.withColumn("r", rate).agg(*sums).first()
        assert got.least >= 0 and max(map(abs, miss)) < 1e-3
        assert all(got[d] / got.n == pytest.approx(t, rel=1e-3) for d, t in targets.items())
    _, miss = soft_mixing.fit_rates(known, {"a": 0.01, "b": 0.01, "c": 0.98}, most_repeats=1.5)
    assert abs(miss[2]) > 0.2  # a lowered target is reported as missed
    even = known.withColumn("p_a", F.lit(0.9)).withColumn("p_b", F.lit(0.1))
    _, miss = soft_mixing.fit_rates(even, {"a": 0.5, "b": 0.5}, most_repeats=100.0)
    assert miss[0] > 0.5 and miss[1] < -0.5  # no rates meet these, and the misses say so


# 3


def test_counts_are_the_librarys(spark, hard):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    counter = token_counts.Counter(token_counts.grammar(path))
    rnd = random.Random(1)
    texts = [t for t in HARD if t] + ["it's we'll D!!'s ''s", "<|endoftext|> a<|startoftext|>b<|ENDOFTEXT|>", "\u0391\u03a3 \u0130x", "e\u0301te\u0301 \u1100\u1161 \u0301x", "a\x1cb \x85d\xa0e\u2003f", "12\u00b3\u00bd 3.14"]
    texts += ["".join(rnd.choice("abcdefghilnorstu'\u2019.,!\u00e9\u00df\u03a3\u65e5 \n0") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    for t in texts:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert counter.count(t) == n, t
        if len(t) < 100:
            assert all(counter.count(t, k) == n for k in (1, 2, 3, 7)), t  # chunks compose
    got = token_counts.token_counts(hard, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in hard.collect())
    assert token_counts.token_counts(hard.limit(0), path).count() == 0


# 4


def test_url_rules_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://M.Example.COM/en/1?x#y", "http://www.example.com/en/2", "http://xwww.example.com/en/", "https://a.net/es/", "https://net/fr/9", "x://a://b.com/", "http://notcom/x", "http://b.example.com?en/", "http://example.com./en/"]
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), (None, "org/"), ("block", None)]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u, "z", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, pid int"), spark.createDataFrame(rules, "verdict string, rule string")).collect()
    upper = {ord(a): b for a, b in zip(url_filter.UPPER, url_filter.LOWER)}

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host) :])[0], host.translate(upper)
        fits = [(len(r), r, v) for v, r in rules if v and r for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: want(u) for i, u in enumerate(urls)}


# 5


def test_shards(spark, hard):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = shuffle_shards.shard_rows(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" for r in got)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per.items())
    assert sorted(map(tuple, shuffle_shards.shard_rows(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    assert shuffle_shards.shard_rows(hard).count() == hard.count() and shuffle_shards.shard_rows(hard.limit(0)).count() == 0


def test_hypergeometric():
    rng = np.random.default_rng(1)
    draws = np.array([shuffle_shards.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(draws.mean() - 6) < 0.15 and abs(draws.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.25
    m = shuffle_shards.communication_matrix([5, 0, 9, 3_000_000_000], [3, 11, 2_999_999_990, 10], 4)
    assert [sum(r) for r in m] == [5, 0, 9, 3_000_000_000] and [sum(c) for c in zip(*m)] == [3, 11, 2_999_999_990, 10]


# 6


def test_measures_brute_force(hard):
    got = quality_rules.judge_quality(hard, carry=["doc_id", "text"]).collect()
    assert len(got) == hard.count()
    for r in got:
        t = r.text or ""
        w = [x for x in SPACE.split(t) if x]
        lines = [x for x in t.split("\n") if SPACE.sub("", x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        m = r.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in SPACE.sub("", t)), len(lines) - len(set(lines)), len(covered)), t[:40]
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(hard.limit(0)).count() == 0


def test_bad_host_takes_its_documents(spark):
    good, bad = " ".join(f"word{i}" for i in range(30)), "short text"
    rows = [(i, f"{good} {i}", f"h{i % 4}") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "junk") for i in range(100)] + [(2000, bad, "tiny"), (2001, good, "tiny2")]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(100)) and got[2001] and not got[2000]


# 8


def test_near_duplicates_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 6)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 900)
    rnd = random.Random(2)
    texts = [None, "", " ", "a", "A", "a b", "b a", "a b c", "A b\tc"]
    for _ in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(20, 120))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(1, 25)):
            v = list(base)
            for _ in range(rnd.randint(0, len(v) // 12)):
                v[rnd.randrange(len(v))] = f"x{rnd.randrange(50)}"
            texts.append(" ".join(v))
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)] + [(3, "a", 1, "q"), (None, "a", 1, "q")], "doc_id long, text string, component int, id string")
    for width, percent in ((2, 80), (5, 80)):
        sets = []
        for t in texts:
            w = (t or "").encode().lower().split()
            sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
        comp = list(range(len(texts)))
        links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        for _ in range(len(texts)):
            before = list(comp)
            for i, j in links:
                comp[i] = comp[j] = min(comp[i], comp[j])
            if before == comp:
                break
        got = minhash_dedup.near_duplicates(df, width, percent).collect()
        assert len(got) == len(texts) + 2
        assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id) for r in got if r.doc_id is not None)
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity():
    a = np.arange(1000, dtype=np.uint64)
    for shared in (200, 600, 900):
        s = [minhash_dedup._mix(a), minhash_dedup._mix(np.concatenate((a[:shared], a[shared:] + np.uint64(5000))))]
        planes = np.frombuffer(b"".join(minhash_dedup.signature(minhash_dedup.minima(x)) for x in s), np.uint8).reshape(2, -1)
        assert abs(minhash_dedup.estimate(planes, 0, np.array([1]))[0] - shared / (2000 - shared)) < 0.12


# 9


def test_articles_of_the_pages(spark):
    got = {r.page_id: r for r in queries.op9_wrapper_induction(spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h\d)>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (text, len(text))


def test_template_without_marks(spark):
    page = "<html><head><title>t</title></head><body><div class='x'>Site name</div><div class='y'><h2>{0}</h2><p>Story {0} &amp; <i>more</i> <br>\n of  it<p>Second {0}<ul><li>a{0}<li>b{0}</ul></div><form>Search</form><div id=comments><p>nice {0}</div><div class='z'>All rights kept</div><script>var x='<p>no</p>'</script></body>"
    rows = [(i, f"http://a.com/{i}", page.format(i), "q") for i in range(6)] + [(6, None, None, "q"), (7, "x", "", "q"), (8, "http://b.com/", "<p>1 < 2 <!-- c --> &lt;b&gt;<nav>menu</nav><p>end", "q"), (8, "http://b.com/", "plain", "q"), (None, "http://c.com", "<main>m<article class='comment'>no</article></main>out", "q")]
    got = [(r.page_id, r.text) for r in wrapper_induction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()]
    want = [(i, f"{i}\n\nStory {i} & more of it\n\nSecond {i}\n\na{i}\n\nb{i}") for i in range(6)] + [(6, ""), (7, ""), (8, "1 < 2 <b>\n\nend"), (8, "plain"), (None, "m")]
    assert Counter(got) == Counter(want)


def test_names_of_the_layout_take_no_page_away(spark):
    story = "<h2>Head {0}</h2><p>Story {0} of this page</p><p>and more {0} of it</p>"
    shells = [
        "<body class='no-sidebar'>@</body>",
        "<body><div class='content has-sidebar'>@</div></body>",
        "<body><article class='post share-enabled'>@</article></body>",
        "<body><div class='nav-open'><div id='wrap'>@</div></div></body>",
        "<body><form id='page'><div>@</div></form></body>",
        "<body><div class='share'>Story {0}</div></body>",
    ]
    rows = [(10 * k + i, f"http://h{k}.com/{i}", shell.replace("@", story).replace("</body>", "<div class='ad'>Buy {0}</div></body>" if "@" in shell else "</body>").format(i)) for k, shell in enumerate(shells) for i in range(4)]
    got = {r.page_id: r.text for r in wrapper_induction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * k + i: f"Head {i}\n\nStory {i} of this page\n\nand more {i} of it" if k < 5 else f"Story {i}" for k in range(6) for i in range(4)}


def test_wrapper_chooses_not_the_marks(spark):
    cards = "<body><div class='story'><p>Story {0}</p><p>more of it {0}</p></div><article class='card'>Read our best</article><article class='card'>Join us now</article></body>"
    chrome = "<body><article><p>Share this page with everyone whom you know and who may like to read it, as often as you can do so</p><p class='text'>Story {0}</p></article></body>"
    few = "<body><article>Story {0}</article><div>beside</div></body>"
    rows = [(10 * k + i, f"http://h{k}.com/{i}", page.format(i)) for k, page in enumerate((cards, chrome, few)) for i in range(5 if k < 2 else 2)]
    got = {r.page_id: r.text for r in wrapper_induction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\n\nmore of it {i}" for i in range(5)} | {10 + i: f"Story {i}" for i in range(5)} | {20 + i: f"Story {i}" for i in range(2)}


def test_templates_of_a_host(spark):
    plain = "<body><div id=top>menu</div><div id=content>story {0}</div><div id=bottom>rights</div></body>"
    bare = "<body><div>menu</div><div>story {0}</div><div>rights</div></body>"
    other = "<body><table class='t'><tr><td class='m'>menu</td></tr></table><section>story {0}<section>legal</section></section></body>"
    note = "<body><div id=top>menu</div><div class='flash'>Down on Sunday</div><div id=content>story {0}</div><div id=bottom>rights</div></body>"
    hosts = [[plain] * 5, [bare] * 5, [plain] * 4 + [other] * 9, [plain] * 9 + [other] * 3 + [note] * 3]
    rows = [(100 * k + i, f"http://h{k}.com/{i}", page.format(i)) for k, pages in enumerate(hosts) for i, page in enumerate(pages)]
    got = {r.page_id: r.text for r in wrapper_induction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * k + i: f"story {i}" for k, pages in enumerate(hosts) for i in range(len(pages))}


# 10


def test_codec(spark, hard):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    codec = piece_codec.Codec(piece_codec.pieces(path))
    words = {t.encode(): i for i, (t, k) in enumerate(zip(codec_pieces(path).text, codec_pieces(path).kind)) if k == "normal"}

    def best(text):  # plain dynamic program over all pieces
        data, low = text.encode(), codec.unknown_score
        score = {0: 0.0}
        for e in range(1, len(data) + 1):
            if e < len(data) and data[e] & 0xC0 == 0x80:
                continue
            options = [score[s] + codec.score[words[data[s:e]]] for s in score if data[s:e] in words]
            start = max(s for s in score)
            if data[start:e] not in words:
                options.append(score[start] + low)
            score[e] = max(options)
        return score[len(data)]

    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghilnorstu'\u2019.,!\u00e9\u00df\u03a3\u65e5   \n\t0\U0001f469") for _ in range(rnd.randint(1, 24))) for _ in range(300)]
    for t, ids in zip(texts, codec.encode_many(texts)):
        ids = np.frombuffer(ids, np.int32).tolist()
        assert codec.decode(ids) == t
        marked = piece_codec.MARK + t.replace(" ", piece_codec.MARK)
        byte_chars = sum(not c.encode() in words for c in marked)
        own = sum(codec.score[i] for i in ids if not codec.is_byte[i]) + byte_chars * codec.unknown_score
        assert own == pytest.approx(best(marked)), t
    coded = piece_codec.decode(piece_codec.encode(hard, path), path).collect()
    assert len(coded) == hard.count()
    plain = lambda t: (t or "").replace(piece_codec.MARK, " ")
    assert Counter((r.doc_id, r.decoded) for r in coded) == Counter((r.doc_id, plain(r.text)) for r in hard.collect())
    assert piece_codec.encode(hard.limit(0), path).count() == 0


def codec_pieces(path, known={}):
    if path not in known:
        known[path] = piece_codec.pieces(path)
    return known[path]


def test_codec_scores_are_log_probabilities(spark):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    lib, p = sentencepiece.SentencePieceProcessor(model_file=path), codec_pieces(path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    score, normal = np.array(p.score), np.array([k == "normal" for k in p.kind])
    assert np.exp(score[normal]).sum() == pytest.approx(1)
    ranks = np.array([-lib.get_score(i) for i in range(len(score))])
    first = np.argsort(ranks[normal])
    assert (np.diff(score[normal][first]) <= 0).all()  # the likelier the earlier merged
    mine = sum(len(r.ids) for r in piece_codec.encode(docs, path).collect())
    theirs = sum(len(lib.encode(r.text or "")) for r in docs.collect())
    assert abs(mine - theirs) < 0.02 * theirs
    words = spark.createDataFrame([(i, "the data of the house") for i in range(3)], "doc_id long, text string")
    assert [p.text[i] for i in piece_codec.encode(words, path).first().ids] == ["▁the", "▁data", "▁of", "▁the", "▁house"]
    codec = piece_codec.Codec(p)
    for t in ["y" * 200 + "é" * 60, "short words only"]:
        one, many = codec.viterbi(piece_codec.MARK + t.replace(" ", piece_codec.MARK)), codec.encode_many([t, t])
        assert [np.frombuffer(m, np.int32).tolist() for m in many] == [one, one]
    assert all(len(k.encode()) <= piece_codec.BATCHED for k in codec)  # long segments aren't kept


def test_decoding_beside_encoding(spark, hard):
    """In one pass the ids decode as they do in a second one; the pipeline and op10 need one Python worker a task for both."""
    path = queries.tokenizer_file("piece_bpe_32k.model")
    rows = lambda df: Counter((r.doc_id, tuple(r.ids), r.n_byte_pieces, r.decoded) for r in df.collect())
    once = piece_codec.encode(hard, path, decoded="decoded")
    assert rows(once) == rows(piece_codec.decode(piece_codec.encode(hard, path), path))
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    plan = queries.QUERIES["op10_piece_codec"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
