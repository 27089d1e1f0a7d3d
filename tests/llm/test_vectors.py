"""Operator 1 and the components: recall on the given vectors, blocks, hubs, repeated ids, odd numbers."""

import random
from collections import Counter

import numpy as np
import pytest

from granum.llm import components as parts
from granum.llm import pivot_dedup
from tests.llm.test_operators import brute_links


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(parts, "HUB", 5)
    rnd = random.Random(8)
    edges = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(501, 560)] + [(30, 530)] + [(2000 - i, 1999 - i) for i in range(40)] + [(rnd.randrange(3000, 3100), rnd.randrange(3000, 3100)) for _ in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in parts.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def answers(rows, links):
    """Per row links and component, by row number; ids may repeat."""
    n = Counter(i for i, _ in links)
    comp = list(range(len(rows)))
    for _ in rows:
        before = list(comp)
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], n[i], None if rows[i][0] is None else least[comp[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [24, 4096])
def test_recall_is_whole_on_near_vectors(spark, monkeypatch, block):
    """Groups of near vectors around the limit, one of them large; every link within is found."""
    monkeypatch.setattr(pivot_dedup, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(50):
        base = rng.normal(size=48)
        rows += [(len(rows) + x, (base + rng.normal(size=48) * s).tolist(), k % 2) for x, s in enumerate([0.02, 0.1, 0.13, 0.14, 0.15] if k else [0.1] * 60)]
    got = pivot_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = brute_links([(v, l) for _, v, l in rows])
    assert len(links) > 1500
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == answers(rows, links)


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(7, a, "x"), (7, b, "x"), (7, a, "x"), (3, [x * 1e200 for x in a], "x"), (4, [x * 1e-300 for x in a], "x"), (5, b, "y"), (None, a, "x"), (6, a, None), (8, [0.0, -0.0, 0.0], "x"), (9, a + [1.0], "x"), (2, b, "x"), (1, [float("inf"), 1.0, 1.0], "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, node int, n int")
    got = pivot_dedup.near_vectors(df).collect()
    named = [(v if i is not None else None, l) for i, v, l in rows]
    links = [(i, j) for i, j in ((i, j) for i in range(len(rows)) for j in range(len(rows))) if i != j and named[i][0] and named[j][0] and named[i][1] is not None and named[i][1] == named[j][1] and len(named[i][0]) == len(named[j][0]) and all(np.isfinite(named[x][0]).all() and any(named[x][0]) for x in (i, j)) and np.dot(*(np.array(named[x][0]) / max(map(abs, named[x][0])) / np.linalg.norm(np.array(named[x][0]) / max(map(abs, named[x][0]))) for x in (i, j))) >= 0.98]
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == answers(rows, links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert pivot_dedup.near_vectors(df.limit(0)).count() == 0


def test_number_of_pivots():
    assert pivot_dedup.pivots_for(10) == 128 and pivot_dedup.pivots_for(800_000) == 512 and pivot_dedup.pivots_for(10**12) == 2048
