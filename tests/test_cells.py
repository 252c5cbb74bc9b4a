"""Trees of centroids and the served index against plain descent and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import errors as X
from vicinal.operators import cells as C
from vicinal.operators import search as N

RNG = np.random.default_rng(9)
CENTRES = RNG.normal(size=(60, 8)) * 5
CLUSTERED = CENTRES[RNG.integers(0, 60, 4000)] + RNG.normal(size=(4000, 8))


def frame(spark, m, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(m)], "id bigint, embedding array<double>").repartition(parts)


def asked(spark, m):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(m)], "query_cell_id string, embedding array<double>")


@pytest.fixture(scope="module")
def tree(spark):
    return C.trained_tree(frame(spark, CLUSTERED), 200)


def test_a_tree_has_about_the_leaves_that_are_asked_for(spark, tree):
    rows = tree.collect()
    children = [c for r in rows for c in r.children]
    inner = {r.node for r in rows}
    leaves = sorted(x for r in rows for x in r.leaves if x >= 0)
    assert leaves == list(range(len(leaves))) and 130 <= len(leaves) <= 210
    assert {c for r in rows for c, x in zip(r.children, r.leaves, strict=True) if x < 0} == inner - {0}
    assert len(set(children)) == len(children) and len(next(r for r in rows if r.node == 0).children) == 15
    assert all(len(r.centroids) == r.width * len(r.children) for r in rows)
    assert all(r.top == (r.node if r.node <= C.FANOUT else (r.node - 1) // C.FANOUT) for r in rows)


def test_training_is_repeatable(spark, tree):
    again = C.trained_tree(frame(spark, CLUSTERED, 7), 200)
    assert sorted((r.node, tuple(r.centroids)) for r in again.collect()) == sorted((r.node, tuple(r.centroids)) for r in tree.collect())


def descent(blocks, v):
    node = 0
    while True:
        children, leaves, m = blocks[node]
        best = int(np.lexsort((np.arange(len(m)), np.round(np.sqrt(((m - v) ** 2).sum(1)), 9)))[0])
        if leaves[best] >= 0:
            return int(leaves[best])
        node = int(children[best])


@pytest.mark.parametrize("most_bytes", [C.MOST_BYTES, 2000, 1])
def test_assignment_goes_down_whether_the_tree_is_whole_or_in_chunks(spark, tree, most_bytes):
    m = [*CLUSTERED[:300], None, [1.0] * 7 + [None], [float("nan")] * 8]
    assert len(C.chunks(tree, most_bytes)) == (1 if most_bytes > 10**6 else len(C.chunks(tree, most_bytes))) and (most_bytes > 10**6 or len(C.chunks(tree, most_bytes)) > 3)
    got = {r.id: r.partition_id for r in C.assigned_by_tree(frame(spark, m), tree, most_bytes=most_bytes).collect()}
    blocks = C._blocks(tree)
    assert got == {i: descent(blocks, np.array(v)) if i < 300 else -1 for i, v in enumerate(m)}


def test_hot_cells_grow_deeper(spark):
    """Half of all rows are nearly one vector: its cell is divided again, and equal vectors make no endless tree."""
    m = np.concatenate([np.zeros((3000, 4)) + RNG.normal(size=(3000, 4)) * 1e-3, np.ones((1500, 4)), RNG.normal(size=(1500, 4)) * 10])
    t = C.trained_tree(frame(spark, m), 5000, points=16)
    nodes = [r.node for r in t.collect()]
    assert max(nodes) > C.FANOUT and len(nodes) < 5000
    sizes = C.assigned_by_tree(frame(spark, m), t).groupBy("partition_id").count().agg(F.max("count")).first()[0]
    assert 1500 <= sizes < 1600


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_all_probes_are_exact(spark, tmp_path, metric):
    rows, queries = frame(spark, [*CLUSTERED[:900], None]), asked(spark, RNG.normal(size=(15, 8)) * 4)
    index = C.create_served(rows, str(tmp_path / "i"), 90, metric, groups=7, file_rows=50)
    want = N.exact_neighbours(queries, rows.withColumnRenamed("id", "cas_cell_index"), 6, metric)
    key = lambda r: (r.query_cell_id, r["rank"])
    for options in ({}, {"query_block": 4}, {"most_bytes": 500}):
        got = index.search(queries, 6, 10_000, breadth=10_000, **options)
        assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_few_probes_reach_their_recall_and_read_their_groups_only(spark, tmp_path):
    rows, queries = frame(spark, CLUSTERED), asked(spark, CLUSTERED[::80] + 0.01)
    C.create_served(rows, str(tmp_path / "i"), 200, groups=50, file_rows=60)
    index = C.ServedIndex.open(spark, str(tmp_path / "i"))
    pairs = lambda df: {(r.query_cell_id, r.cas_cell_index) for r in df.collect()}
    want = pairs(N.exact_neighbours(queries, rows.withColumnRenamed("id", "cas_cell_index"), 5, "l2"))
    few = index.leaves // 20
    assert len(pairs(index.search(queries, 5, few)) & want) >= 0.9 * len(want)
    # Two searches share the index; one query reads one group or a few.
    one = index.search(queries.filter("query_cell_id = 'q3'"), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell_group" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(partition_id" in plan
    held = index.probed([0, 1])
    assert {r.partition_id for r in held.select("partition_id").distinct().collect()} <= {0, 1}
    assert held.select(F.input_file_name()).distinct().count() <= 2 * 60
    assert len(held.inputFiles()) > 0 and one.count() == 5


def test_files_of_a_large_group_are_several(spark, tmp_path):
    index = C.create_served(frame(spark, np.ones((500, 3))), str(tmp_path / "i"), 4, file_rows=100)
    assert index.leaves == 1 and len(index.rows.inputFiles()) >= 3


def test_errors(spark, tmp_path, tree):
    with pytest.raises(X.IndexConfigurationError):
        C.trained_tree(frame(spark, [None]), 4)
    with pytest.raises(X.IndexConfigurationError):
        C.ServedIndex.open(spark, str(tmp_path / "none"))
    with pytest.raises(X.IndexConfigurationError):
        C.create_served(frame(spark, CLUSTERED[:5]), str(tmp_path / "x"), 4, "dot_product")
    with pytest.raises(X.IndexConfigurationError):
        C.probes(frame(spark, CLUSTERED[:5]).withColumnRenamed("embedding", "v"), tree, 0)
