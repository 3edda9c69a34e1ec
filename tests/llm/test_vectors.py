"""Vector operators against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import components, embedding_dedup, exact_topk

COLUMNS = "vec_id long, embedding array<float>, label int, id string, v string, n string, unit string, score string"


def sample():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + i, [float(x) for x in centre + rng.standard_normal(16) * 0.25], c % 3) for i in range(40)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)] + [(1100, rows[7][1], 2)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [math.nan] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, [math.inf] * 16, 1), (2006, rows[7][1], None), (2050, [1.0, 2.0], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], COLUMNS).repartition(3)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("sizes", [{}, {"block": 8}, {"group": 5}])
def test_near_vectors(spark, sizes):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in sample()]
    use = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if good(v) and any(v) and lab is not None]
    up, n = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, (a, x, la) in enumerate(use):
        for b, y, lb in use[:k]:
            if la == lb and len(x) == len(y) and x @ y >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    got = {r.vec_id: (r.n_links, r.component) for r in embedding_dedup.near_vectors(frame(spark, rows), **sizes).collect()}
    assert got == {i: (n[i], root(i)) for i, _, _ in rows}


def test_top_k_with_ties_and_repeats(spark):
    rows = sample()
    ints = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _ in rows if good(v)}
    got = {}
    for r in exact_topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, block=32, query_block=3, pivots=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for q, x in ints.items():
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ints.items() if i != q and len(x) == len(y))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_pivots_spare_most_work():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.standard_normal((40, 8))[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 8))))
    table = exact_topk.PivotTable(np.arange(4000), x, exact_topk.spread_pivots(x, 24))
    table.search(3, x[3], 5)
    assert table.evaluated < 1000


def test_empty_tables(spark):
    empty = frame(spark, sample()).limit(0)
    assert embedding_dedup.near_vectors(empty).count() == 0
    assert exact_topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(9, 9), (None, 3)]
    up = {k: k for e in edges for k in e}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {k for a, b in edges if a is not None and a != b for k in (a, b)}
    assert got == {k: root(k) for k in linked}


def test_pairs_at_the_threshold_meet():
    """Recall of tables and sign distance on pairs of cosine 0.93, by brute force, at several sizes."""
    rng = np.random.default_rng(9)
    for n in (1000, 10**6):
        bits, tables, limit = embedding_dedup.plan(n, 0.93, 2e-5)
        plane = embedding_dedup.planes(64, tables, bits, 7)
        x, y = rng.standard_normal((2, 3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        differ = (x @ plane > 0) != (y @ plane > 0)
        met = ~differ.reshape(3000, tables, bits).any(2)
        assert (met.any(1) & (differ.sum(1) <= limit)).mean() >= 0.999
    assert embedding_dedup.plan(10**6, 0.93, 2e-5)[0] > embedding_dedup.plan(1000, 0.93, 2e-5)[0]


def test_repeated_ids_and_huge_components(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 2), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 0, None)], key=str)
    huge = spark.createDataFrame([(50, [1e18, 1.0], 1), (2, [1e18, 1.0], 1), (3, [-1e18, 0.0], 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.rank: (r.vec_id, r.score) for r in exact_topk.top_k(huge, F.col("vec_id") % 50 == 0).collect()}
    assert got == {1: (2, 2**63 - 1024), 2: (3, -(2**63 - 1024))}
