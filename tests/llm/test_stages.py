"""Operators 2 and 7 and the pipeline's stages against plain computations, with clashing columns, nulls and empty tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granum.llm import evidence, minhash_dedup, piece_codec, quality_rules, queries, site_quality, soft_mixing
from tests.llm.test_operators import DATA

CLASHES = ["kept", "m", "rate", "n", "_doc", "document", "_id", "_host", "evidence", "copies", "base_failed", "component_id"]


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents with repeated rows, an id of two texts, nulls, and columns that bear the operators' names."""
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(3, "another text of id three", "en", "a"), (3, None, None, None), (None, "a b c", None, "a"), (None, None, None, None), (900, "", "", ""), (901, "word " * 40_000, "en", None)], "doc_id long, text string, lang string, source string")
    d = d.union(d.where("doc_id < 4")).union(odd)
    return d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def features(spark, df, marked):
    return [(r, [r.f[x] for x in site_quality.FEATURES]) for r in df.select("*", evidence.style(F.col("text"), marked).alias("f")).collect()]


def test_site_posteriors_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    docs = docs.union(docs.where("doc_id % 7 = 0").withColumn("source", F.lit(None).cast("string"))).withColumn("source", F.when(F.col("doc_id") % 11 != 0, F.col("source")).otherwise(F.concat(F.lit("h"), F.col("doc_id"))))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    marked = evidence.marking_words(docs.join(labels, "doc_id").select("text", (F.col("quality") == 0).alias("low")), "low")
    rows = features(spark, docs, marked)
    have = [(x, quality[r.doc_id] == 0) for r, x in rows if r.doc_id in quality]
    w = evidence.fit_logistic(np.array([x for x, _ in have]), np.array([float(y) for _, y in have]), ridge=1e-5)
    z = [min(max(w[0] + float(np.dot(w[1:], x)), -30), 30) for _, x in rows]
    e = [1 / (1 + math.exp(-v)) for v in z]

    def prior(groups, mean):
        n = [len(g) for g in groups]
        total, k = sum(n), len(groups)
        if total <= k:
            return 1e6
        within = max(sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g in groups), 0) / (total - k)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, mean))
        between = (between - (k - 1) * within) / max(total - sum(x * x for x in n) / total, 1e-9)
        return min(max(within / between, 5.0), 1e6) if between > 1e-12 else 1e6

    mean = sum(e) / len(e)
    hosts, paths = defaultdict(list), defaultdict(list)
    for (r, _), x in zip(rows, e):
        hosts[r.source].append(x)
        paths[r.source, r.lang].append(x)
    a = prior(list(hosts.values()), [mean] * len(hosts))
    host_rate = {h: (sum(g) + a * mean) / (len(g) + a) for h, g in hosts.items()}
    b = prior(list(paths.values()), [host_rate[h] for h, _ in paths])
    want = []
    for (r, _), v, x in zip(rows, z, e):
        g = paths[r.source, r.lang]
        path_rate = min(max((sum(g) - x + b * host_rate[r.source]) / (len(g) - 1 + b), 1e-6), 1 - 1e-6)
        p = 1 / (1 + math.exp(-(v - math.log(mean / (1 - mean)) + math.log(path_rate / (1 - path_rate)))))
        want.append((r.doc_id, r.source or "", x, host_rate[r.source], p))
    key = lambda x: (x[0], x[1])
    for twice in (True, False):
        got = [(r.doc_id, r.source or "", r.evidence, r.host_rate, r.p_low) for r in site_quality.judge_sites(docs, labels, twice=twice).collect()]
        for x, y in zip(sorted(got, key=key), sorted(want, key=key)):
            assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-7)


def test_mixing_is_the_least_squares_fit(spark, docs):
    """All of the query: targets are met as declared, and the rates are the nearest to 1 that do it."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    source = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    targets = {"clean": 0.6, "toxic": 0.3, "low": 0.1}
    got = soft_mixing.mix_softly(source, spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet"), targets).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in source.collect()}
    assert all(r.n_tokens == words[r.doc_id] for r in got)
    p, n, rate = np.array([[r[f"p_{d}"] for d in targets] for r in got]), np.array([float(r.n_tokens) for r in got]), np.array([r.rate for r in got])
    assert p.sum(1) == pytest.approx(1)
    share = (rate * n) @ p / n.sum()
    assert share == pytest.approx(np.array(list(targets.values())), rel=2e-4)  # no target is lowered
    assert [got[0][f"miss_{d}"] for d in targets] == pytest.approx(share / np.array(list(targets.values())) - 1, abs=1e-9)
    # Optimal for sum n (r - 1)^2 under r >= 0 and these totals: r = max(0, 1 + p . multipliers) for some multipliers.
    on = rate > 1e-9
    pull, *_ = np.linalg.lstsq(p[on], rate[on] - 1, rcond=None)
    assert np.maximum(0, 1 + p @ pull) == pytest.approx(rate, abs=1e-6)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    mixed = soft_mixing.mix_softly(docs, labels)
    assert mixed.count() == docs.count() and set(CLASHES) <= set(mixed.columns)
    assert mixed.where("doc_id = 901").first().n_tokens == 40_000


def plain(df):
    return Counter(map(repr, df.select("doc_id", "text", "lang", "source", *CLASHES).collect()))


def test_stages_on_odd_rows(spark, docs):
    """Each stage's decisions, by the operator on the plain columns; other columns come through untouched."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bare = docs.select("doc_id", "text", "lang", "source")
    judged = site_quality.judge_sites(bare, labels).where("kept").select(bare.columns)
    got = corpus_pipeline.classify(spark, docs, DATA)
    assert got.columns == docs.columns and Counter(got.select(bare.columns).collect()) == Counter(judged.collect())
    assert plain(got) == Counter({k: v for k, v in plain(docs).items() if k in plain(got)})

    got = corpus_pipeline.rules(spark, docs, DATA)
    base = quality_rules.judge_quality(bare).where("kept").select(bare.columns)
    assert got.columns == docs.columns and Counter(got.select(bare.columns).collect()) == Counter(base.collect())
    for r in got.collect():
        assert len((r.text or "").split()) >= 20

    got = corpus_pipeline.dedup(spark, docs, DATA)
    assert got.columns == docs.columns
    want = {r.component_id for r in minhash_dedup.near_duplicates(bare).collect() if r.doc_id is not None}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2
    assert set(plain(got)) <= set(plain(docs))

    got = corpus_pipeline.mix(spark, docs, DATA)
    copies = Counter()
    for r in soft_mixing.mix_softly(bare, labels, most_repeats=corpus_pipeline.MOST_REPEATS).collect():
        copies[r.doc_id, r.text, r.lang, r.source] += r.copies
    assert got.columns == docs.columns and Counter((r.doc_id, r.text, r.lang, r.source) for r in got.collect()) == +copies

    got = corpus_pipeline.pieces(spark, docs, DATA)
    codec = piece_codec.Codec(piece_codec.pieces(queries.tokenizer_file("piece_bpe_32k.model")))
    import zlib

    text = Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.decoded_crc32) for r in got.collect()) == text
    assert all(codec.decode(r.ids) is not None and r.n_pieces == len(r.ids) for r in got.limit(5).collect())


def test_stages_on_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_keep_clean_documents(spark):
    folder = f"{DATA}/../sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    label = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [i for i, v in label.items() if v == (1, 0)]
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, docs, folder).collect()}
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix(spark, docs, folder).collect())
    assert sum(mixed[i] > 0 for i in clean) > 0.97 * len(clean)


def test_run_is_the_stages_in_a_row(spark):
    x = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, DATA)
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == x.columns and Counter(map(repr, got.collect())) == Counter(map(repr, x.collect()))
