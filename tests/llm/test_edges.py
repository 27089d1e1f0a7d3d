"""Rows that are many, long or missing, for the operators on single rows and for shards."""

import time
from collections import Counter

import pytest

from granum.llm import queries, shuffle_shards, token_counts, url_filter


def test_urls_on_odd_tables(spark):
    rules = spark.createDataFrame([("block", "a.com/"), ("block", "a.com/")], "verdict string, rule string")
    long = "http://x." + "y." * 50_000 + "a.com/" + "p" * 100_000
    rows = [(1, long, 0, "z"), (1, long, 0, "z"), (2, None, 0, "z"), (None, "http://a.com", 0, "z"), (3, "http://a.com/", 0, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int, verdict string")
    got = Counter((r.page_id, len(r.host), len(r.path), r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == Counter({(1, len(long) - 7 - 100_001, 100_001, "a.com/", "block"): 2, (2, 0, 0, None, "allow"): 1, (None, 5, 0, None, "allow"): 1, (3, 5, 1, "a.com/", "block"): 1})
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("unit,n", [("中", 300_000), ("ab cd ", 200_000), ("x", 400_000)])
def test_tokens_of_long_texts(unit, n):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    text, counter = unit * n, token_counts.Counter(token_counts.grammar(path))
    began = time.time()
    got = counter.count(text)
    assert time.time() - began < 60
    part = 20_000 // len(unit)
    assert counter.count(unit * part) == len(Tokenizer.from_file(path).encode(unit * part, add_special_tokens=False).ids)
    assert got == counter.count(text, 1 << 30)  # one chunk


def test_maps_compose_in_any_order():
    counter = token_counts.Counter(token_counts.grammar(queries.tokenizer_file("word_bpe_49k.json")))
    parts = [counter.chunk(x) for x in ("ab", "cd e", "", " ", "fg", "h ij", "k")]
    left = parts[0]
    for p in parts[1:]:
        left = counter.compose(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = counter.compose(p, right)
    assert left == right == counter.reduce(parts)


def test_shards_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(shuffle_shards, "COPIES", 100)
    df = spark.range(3000).selectExpr("cast(if(id < 2000, null, id % 700) as long) as doc_id", "if(id % 2 = 0, 'same', 'same') as text", "id as shard", "'x' as bucket", "1 as copy")
    got = shuffle_shards.shard_rows(df).collect()
    per = Counter(r.shard for r in got)
    assert len(got) == 3000 and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per.items())
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
    spread = Counter(r.shard for r in got if r.doc_id is None)
    assert max(spread.values()) < 2 * min(spread.values())
    assert sorted(map(str, got)) == sorted(map(str, shuffle_shards.shard_rows(df.repartition(5)).collect()))
