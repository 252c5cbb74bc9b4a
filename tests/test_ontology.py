"""Graphs against plain walks: deep, dense, with cycles, empty."""

import random

import pytest

from vicinal import errors as X
from vicinal.operators import ontology as O


def frame(spark, edges):
    return spark.createDataFrame([*edges], "parent bigint, child bigint").repartition(3)


def walks(edges, root):
    """Ancestors of every term, and shortest and longest routes from the root, of a graph without cycles."""
    up, terms = {}, {x for e in edges for x in e}
    for p, c in edges:
        up.setdefault(c, set()).add(p)

    def above(t):
        return set().union(*({p} | held[p] for p in up.get(t, ())))

    held, lengths, depth = {}, {}, {}
    left = sorted(terms)
    while left:
        ready = [t for t in left if all(p in held for p in up.get(t, ()))]
        for t in ready:
            held[t] = above(t)
            depth[t] = max((depth[p] + 1 for p in up.get(t, ())), default=0)
            routes = [lengths[p] for p in up.get(t, ()) if p in lengths]
            if t == root:
                lengths[t] = (0, 0)
            elif routes:
                lengths[t] = (min(a for a, _ in routes) + 1, max(b for _, b in routes) + 1)
        left = [t for t in left if t not in held]
    return held, lengths, depth


def random_dag(n, links, seed):
    rnd = random.Random(seed)
    return {(min(a, b), max(a, b)) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(links)) if a != b}


@pytest.mark.parametrize("edges", [random_dag(60, 90, 1), random_dag(40, 600, 2), {(0, 1)}, {(i, i + 1) for i in range(17)} | {(0, 9), (3, 16)}, {(0, 1), (5, 6), (6, 1), (5, 9)}])
def test_equals_walks(spark, edges):
    df = frame(spark, [*edges, *edges])
    held, lengths, depth = walks(edges, 0)
    assert sorted(tuple(r) for r in O.closure(df).collect()) == sorted((t, a) for t, above in held.items() for a in above)
    assert {r.term: r.length for r in O.shortest_paths(df, 0).collect()} == ({t: a for t, (a, _) in lengths.items()} or {0: 0})
    assert {r.term: r.length for r in O.longest_paths(df, 0).collect()} == ({t: b for t, (_, b) in lengths.items()} or {0: 0})
    got = [(r.depth, r.term) for r in O.topological(df).collect()]
    assert got == sorted(got) and dict((t, d) for d, t in got) == depth


def test_a_chain_of_thousands_takes_few_rounds(spark):
    n = 5000
    df = spark.range(1, n).selectExpr("id - 1 as parent", "id as child")
    sc = spark.sparkContext
    begun = []
    inner = O.staged
    try:
        O.staged = lambda *a: (begun.append(1), inner(*a))[1]
        sc.setJobGroup("chain", "closure of a chain")
        pairs = O.closure(df)
        jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    finally:
        O.staged = inner
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(begun) <= 30 and jobs <= 130
    got = pairs.selectExpr("count(*) n", "sum(term - ancestor) s", "min(term - ancestor) least").first()
    assert tuple(got) == (n * (n - 1) // 2, sum(k * (n - k) for k in range(1, n)), 1)
    assert O.topological(df).selectExpr("count(*) n", "count_if(depth = term) same").first() == (n, n)
    assert O.longest_paths(df, 4000).selectExpr("count(*) n", "count_if(length = term - 4000) same").first() == (1000, 1000)


def test_cycles(spark):
    with pytest.raises(X.OntologyError):
        O.closure(frame(spark, [(1, 1)]))
    ring = [(0, 1), (1, 2), (2, 3), (3, 1)]
    for f in (O.closure, O.topological, lambda e: O.longest_paths(e, 0)):
        with pytest.raises(X.OntologyError, match="cycle"):
            f(frame(spark, ring))
    assert {r.term: r.length for r in O.shortest_paths(frame(spark, ring), 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    # A ring that leads to what the root reaches is not the root's.
    far = [(0, 1), (1, 2), (8, 9), (9, 8), (9, 2)]
    assert {r.term: r.length for r in O.longest_paths(frame(spark, far), 0).collect()} == {0: 0, 1: 1, 2: 2}
    with pytest.raises(X.OntologyError):
        O.topological(frame(spark, far))


def test_no_edges(spark):
    none = frame(spark, [])
    assert O.closure(none).count() == 0 and O.topological(none).count() == 0
    assert [tuple(r) for r in O.shortest_paths(none, 3).collect()] == [(3, 0)] == [tuple(r) for r in O.longest_paths(none, 3).collect()]
