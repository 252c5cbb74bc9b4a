"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest

from vicinal.llm import topk as T

NAN, INF = float("nan"), float("inf")


def brute(queries, rows, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = {i: [math.floor(1024 * x) for x in v] for i, v in queries if i is not None and ok(v)}
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, a in whole.items():
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in held if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, asked, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string").repartition(3)
    queries = df.filter("vec_id % 10 = 0" if asked is None else asked)
    got = T.top_k(queries, df, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute([r for r in rows if r[0] is not None and r[0] % 10 == 0], rows, options.get("k", 10))


def vectors(n, width, seed, ties=False):
    rnd = random.Random(seed)
    return [(i, [rnd.choice([0.0, 0.5, -0.25]) if ties else rnd.gauss(0, 0.3) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"query_block": 4}, {"levels": (2, 5)}])
def test_equals_brute_force(spark, options):
    check(spark, vectors(150, 16, 1), None, **options)


def test_ties_nulls_and_odd_vectors(spark):
    rows = vectors(60, 4, 2, ties=True)
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [NAN, 0.0, 0.0, 0.0]), (103, [INF, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (104, []), (110, []), (105, [1.0, 2.0]), (120, [1.0, 2.0]), (7, rows[7][1]), (10, rows[10][1])]
    check(spark, rows, None)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**30 + i), float(-(2**29) - 3 * i), 1.0]) for i in range(30)]
    check(spark, [(i, [x / 1024 for x in v]) for i, v in rows], None)


def test_fewer_rows_than_k_and_empty_tables(spark):
    check(spark, vectors(4, 3, 3), None)
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert T.top_k(df, df).count() == 0


def test_integers_beyond_floats(spark):
    """Products over 2**53, and over 2**63 whose sums fit 64 bits."""
    rows = [(i, [float(2**30 + i), float(-(2**30) + 3 * i), 2.0**20]) for i in range(30)]
    check(spark, [(i, [x / 1024 for x in v]) for i, v in rows], None, k=4)
    rows = [(0, [2.0**40, 3.0, 1.0])] + [(i, [float(i), 2.0**40 + 4096 * (i % 4), float(-i)]) for i in range(1, 10)]
    check(spark, [(i, [x / 1024 for x in v]) for i, v in rows], None, k=4)


def test_few_pairs_are_scored_on_clustered_vectors():
    """Exact scores are computed for survivors of the bounds alone; the answers are those of brute force."""
    rng = np.random.default_rng(4)
    shapes = np.repeat(rng.normal(size=(20, 16)), 4, axis=1)  # segments with means of their own
    m = np.floor(1024 * (shapes[rng.integers(0, 20, 6000)] + 0.15 * rng.normal(size=(6000, 64))))
    ids, asked = np.arange(6000), np.arange(0, 6000, 100)
    search = T.Search(asked, m[asked], 10, T.LEVELS)
    for a in range(0, 6000, 1000):
        search.add(ids[a : a + 1000], m[a : a + 1000])
    for r, q in enumerate(asked):
        score = m @ m[q]
        score[q] = -np.inf
        assert search.best[r] == [(-int(score[i]), int(i)) for i in np.lexsort((ids, -score))[:10]]
    assert search.pairs == 60 * 6000 and search.scored < 0.25 * search.pairs
    seeded = T.Search(asked, m[asked], 10, T.LEVELS, search.least)
    seeded.add(ids, m)
    assert seeded.best == search.best and seeded.scored < search.scored


@pytest.mark.parametrize("rows", [T.BLOCK_ROWS, 7])
def test_blocks_products_and_gathered_pairs_agree(monkeypatch, rows):
    """Whether bounds let much pass or little, in blocks of any size, with ties and in any order of rows."""
    monkeypatch.setattr(T, "BLOCK_ROWS", rows)
    monkeypatch.setattr(T, "BLOCK_PAIRS", 50)
    rng = np.random.default_rng(8)
    near = np.floor(100 * (np.repeat(rng.normal(size=(5, 4)), 4, axis=1)[rng.integers(0, 5, 400)] + 0.1 * rng.normal(size=(400, 16))))
    for m in (near, rng.integers(-2, 3, (400, 16)).astype(float)):
        search = T.Search(np.arange(0, 400, 40), m[::40], 6, (1, 4, 8))
        for a in rng.permutation(np.arange(0, 400, 50)):
            search.add(np.arange(a, a + 50), m[a : a + 50])
        for q, best in zip(range(0, 400, 40), search.best, strict=True):
            score = m @ m[q]
            score[q] = -np.inf
            assert best == [(-int(score[i]), int(i)) for i in np.lexsort((np.arange(400), -score))[:6]]
