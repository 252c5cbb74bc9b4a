"""Searches against brute force, index building and streaming upserts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import errors as X
from vicinal.operators import embedding as M
from vicinal.operators import index_build as I
from vicinal.operators import search as N
from vicinal.sources import readers as R
from vicinal.streaming.upsert import compacted, current, upsert_stream

RNG = np.random.default_rng(0)
ROWS = np.round(RNG.normal(size=(300, 8)), 1)
ROWS[50] = ROWS[51] = ROWS[7]
ROWS[60] = 0


@pytest.fixture
def index(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ROWS)], "cas_cell_index bigint, embedding array<double>").repartition(3)


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in ROWS[i]]) for i in (7, 60, 100, 200)], "query_cell_id string, embedding array<double>")


def brute(metric, k):
    out = []
    for q in (7, 60, 100, 200):
        a, n = ROWS[q], np.maximum(np.sqrt((ROWS * ROWS).sum(1)), 1e-12)
        d = {"cosine": np.abs(1 - ROWS @ a / (n * n[q])), "l2": np.sqrt(((ROWS - a) ** 2).sum(1)), "dot_product": -(ROWS @ a)}[metric]
        d = np.round(d, 9) + 0.0
        out += [(f"q{q}", r + 1, int(i), float(d[i])) for r, i in enumerate(np.lexsort((np.arange(len(d)), d))[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot_product"])
@pytest.mark.parametrize("options", [{}, {"query_block": 2}])
def test_exact(index, queries, metric, options):
    got = sorted(tuple(r) for r in N.exact_neighbours(queries, index, 6, metric, **options).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in brute(metric, 6)]
    assert [d for *_, d in got] == pytest.approx([d for *_, d in brute(metric, 6)], abs=2e-9)


def test_probing_all_partitions_is_exact(index, queries):
    rows = index.withColumn("partition_id", (F.col("cas_cell_index") % 5).cast("int"))
    centroids = I.mean_centroids(rows, F.col("partition_id"))
    flat = sorted(tuple(r)[:3] for r in N.exact_neighbours(queries, index, 5, "l2").collect())
    assert sorted(tuple(r)[:3] for r in N.probed_neighbours(queries, rows, centroids, 5, 5, "l2").collect()) == flat
    near = N.probed_neighbours(queries, rows, centroids, 5, 1, "l2")
    assert near.join(rows, "cas_cell_index").groupBy("query_cell_id").agg(F.count_distinct("partition_id").alias("n")).filter("n > 1").isEmpty()


@pytest.mark.parametrize("bad", [{"index_uri": " "}, {"index_type": "TREE"}, {"distance_metric": "COSINE"}, {"index_type": "ivf_flat"}, {"index_type": "IVF_FLAT", "nprobe": 0}, {"index_type": "VAMANA", "l_search": True}, {"num_neighbors": 0}])
def test_settings(bad):
    with pytest.raises(X.IndexConfigurationError):
        N.IndexSettings(**{"index_uri": "u", "embedding_dimension": 8, "num_neighbors": 3} | bad)


def test_search_checks_and_shapes(spark, index, queries):
    flat = N.IndexSettings("u", 8, 3, "flat", nprobe=None, memory_budget=5)
    got = N.search(queries, index, flat)
    assert N.checked_response(queries, got).count() == 12
    nested = {r.query_cell_id: r.neighbors for r in N.nested(got).collect()}
    assert nested["q7"][0].cas_cell_index == 7 and nested["q7"][0].distance == 0
    assert N.search(queries.limit(0), index, flat).count() == 0 and N.search(queries, index, N.IndexSettings("u", 8, 3, "vamana", l_search=4)).count() == 12
    with pytest.raises(X.SearchError):
        N.search(queries, index, N.IndexSettings("u", 9, 3))
    with pytest.raises(X.SearchError):
        N.checked_response(queries, got.filter("query_cell_id <> 'q7'"))
    models = spark.createDataFrame([(1, "m", 8), (2, "none", 8), (3, "odd", 9)], "id bigint, model_name string, embedding_dimension int")
    indexes = spark.createDataFrame([(i, "n", None, 8, 3, "u", "FLAT", "l2", None, None, None, i) for i in (1, 3)], "id bigint, index_name string, description string, embedding_dimension int, num_neighbors int, index_uri string, index_type string, distance_metric string, nprobe int, l_search int, memory_budget bigint, model_id bigint")
    assert N.settings_of(models, indexes, "m").num_neighbors == 3
    for name in ("none", "odd"):
        with pytest.raises(X.IndexConfigurationError):
            N.settings_of(models, indexes, name)


def test_index_is_built_and_searched(spark, index, queries, tmp_path):
    rows = index.withColumnRenamed("cas_cell_index", "id")
    for _ in range(2):  # the second build replaces the first
        centroids = I.create_index(rows, f"{tmp_path}/index", metric="l2", normalise=False, partitions=4)
    held = spark.read.parquet(f"{tmp_path}/index")
    assert held.count() == 300 and centroids.count() == 4
    got = N.probed_neighbours(queries, held, centroids, 1, 4, "l2", index_id="id")
    assert {r.query_cell_id: r.distance for r in got.collect()} == {"q7": 0, "q60": 0, "q100": 0, "q200": 0}
    with pytest.raises(X.IndexConfigurationError):
        I.build_metric("dot_product")


def test_normalise(index):
    norms = [float(np.sqrt(np.square(r.embedding).sum())) for r in I.prepared(index, True).orderBy("cas_cell_index").collect()]
    assert norms[60] == 0 and [n for i, n in enumerate(norms) if i != 60] == pytest.approx([1.0] * 299, abs=1e-5)


def test_training_batches(spark):
    batches = spark.createDataFrame([(i, 40) for i in range(5)], "batch int, n_rows int")
    assert [r.batch for r in I.training_batches(batches, 100).collect()] == [0, 1, 2]
    assert I.estimated_total(100, 3, 10) == 333


def test_upserts(spark, tmp_path):
    schema = "id bigint, value string, ts bigint"
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    b = spark.createDataFrame([(2, "late", 0), (1, "new", 2), (3, "c", 2)], schema)
    want = {(1, "new", 2), (2, "b", 1), (3, "c", 2)}
    assert {tuple(r) for r in I.upserted(a, b).collect()} == want
    at = str(tmp_path)
    for rows in (a, b):
        rows.write.mode("append").parquet(f"{at}/in")
        upsert_stream(spark, f"{at}/in", a.schema, f"{at}/out", f"{at}/state", chunk=1).awaitTermination()
    assert {tuple(r) for r in current(spark, f"{at}/out").collect()} == want
    compact, centroids = I.consolidated(spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(20)], "id bigint, embedding array<double>, ts bigint"), 2)
    assert compact.count() == 20 and centroids.count() == 2


def test_files_and_matrices(spark, tmp_path):
    spark.createDataFrame([("0,0.1,0.2",), ("1,0.3,0.4",), ("2,0.5,0.6",)], "value string").coalesce(1).write.option("compression", "gzip").text(f"{tmp_path}/b")
    got = R.embedding_batches(spark, f"{tmp_path}/b", 2).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2] and got[2].embedding == pytest.approx([0.5, 0.6])
    sparse = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)], "query_cell_id string, feature_index int, value float")
    assert {r.query_cell_id: r.x for r in R.densified(sparse, 3).collect()} == {"a": [1, 0, 3], "b": [0, 2, 0]}
    matrix = spark.createDataFrame([("a", 1.0, [1.0, 2.0]), ("b", 1.0, [3.0, 4.0])], "query_cell_id string, total_mrna_umis float, x array<float>")
    got = {r.query_cell_id: r.embedding for r in M.embed(R.checked_matrix(matrix), M.linear_model(np.eye(2) * 2), 2).collect()}
    assert got == {"a": [2, 4], "b": [6, 8]}
    for bad in (matrix.drop("total_mrna_umis"), matrix.withColumn("x", F.col("x").cast("array<double>")), matrix.withColumn("total_mrna_umis", F.lit(1.0))):
        with pytest.raises(X.InputError):
            R.checked_matrix(bad)


def test_plans(index, queries):
    """The index is read in one pass; k rows a query are kept before the one shuffle. Probing joins by partition id."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    exact = plan(N.exact_neighbours(queries, index.coalesce(2), 5))
    assert exact.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in exact and "Join" not in exact
    rows = index.withColumn("partition_id", (F.col("cas_cell_index") % 5).cast("int"))
    probed = plan(N.probed_neighbours(queries, rows, I.mean_centroids(rows, F.col("partition_id")), 5, 2, "l2"))
    assert "WindowGroupLimit" in probed and "Cartesian" not in probed and "NestedLoop" not in probed


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot_product"])
@pytest.mark.parametrize(("offset", "spread"), [(1e4, 1e-3), (-3e6, 1.0), (0.0, 1e-9), (0.0, 1e9), (1e-3, 1e-6)])
def test_exact_for_vectors_of_any_size(spark, metric, offset, spread):
    rng = np.random.default_rng(5)
    m = offset + spread * rng.normal(size=(400, 16))
    m[40:44] = m[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cas_cell_index bigint, embedding array<double>").repartition(3)
    asked = df.filter("cas_cell_index % 40 = 7 or cas_cell_index = 40").withColumnRenamed("cas_cell_index", "query_cell_id")
    got = sorted(tuple(r) for r in N.exact_neighbours(asked, df, 6, metric).collect())
    want = []
    for q in [*range(7, 400, 40), 40]:
        d = N.distances(metric, m[q], m)
        want += [(q, r + 1, int(i), float(d[i])) for r, i in enumerate(np.lexsort((np.arange(400), d))[:6])]
    assert got == sorted(want)


def test_vectors_that_take_no_part(spark, index, queries):
    """NaN, infinite, overlarge and null components, null vectors and null ids: no row of a batch suffers from another."""
    bad = [(900, [float("nan")] * 8), (901, [float("inf")] + [0.0] * 7), (902, [None] + [0.0] * 7), (903, None), (None, [0.0] * 8), (904, [1e300] * 8)]
    more = index.unionByName(spark.createDataFrame(bad, "cas_cell_index bigint, embedding array<double>")).coalesce(1)
    asked = queries.unionByName(spark.createDataFrame([("qnan", [float("nan")] * 8), ("qnull", None), (None, [0.0] * 8)], "query_cell_id string, embedding array<double>"))
    for metric in ("cosine", "l2", "dot_product"):
        got = N.exact_neighbours(asked, more, 6, metric)
        assert [tuple(r)[:3] for r in sorted(got.collect())] == [r[:3] for r in brute(metric, 6)]
    with pytest.raises(X.SearchError):
        N.checked_response(asked.dropna(subset=["query_cell_id"]), got)
    with pytest.raises(Exception, match="does not have 8 components"):
        N.exact_neighbours(queries, index.unionByName(spark.createDataFrame([(950, [1.0])], "cas_cell_index bigint, embedding array<double>")), 2).collect()
    placed = I.assigned(more.select("cas_cell_index", "embedding"), I.mean_centroids(index, F.col("cas_cell_index") % 3))
    assert {r.cas_cell_index: r.partition_id for r in placed.filter("partition_id < 0").collect()} == {i: -1 for i, _ in bad if i != None and i >= 900}  # noqa: E711


def test_steps_of_assignment_shrink_with_the_centroids():
    rng = np.random.default_rng(1)
    x, m = 1e5 + rng.normal(size=(50, 4)), 1e5 + rng.normal(size=(70_000, 4))
    got = N.closest("l2", x, m)
    assert got.tolist() == [int(np.argmin(N.distances("l2", v, m))) for v in x]


def test_trained_index_reaches_its_recall(spark, tmp_path):
    """Clustered vectors, k-means centroids, an eighth of the partitions probed: recall against the exact search is 0.9 or more."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    m = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, embedding array<double>").repartition(4)
    centroids = N.Centroids.read(I.create_index(rows, f"{tmp_path}/i", metric="l2", normalise=False, partitions=32, sample_size=2000))
    held, asked = spark.read.parquet(f"{tmp_path}/i"), rows.filter("id % 40 = 0").withColumnRenamed("id", "query_cell_id")
    for _ in range(2):  # centroids are read once and serve every search
        got = {(r.query_cell_id, r.id) for r in N.probed_neighbours(asked, held, centroids, 10, 4, "l2", index_id="id").collect()}
    want = {(r.query_cell_id, r.id) for r in N.exact_neighbours(asked, rows, 10, "l2", index_id="id").collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_life_of_an_index(spark, tmp_path):
    rows = [(b, i, [float(i), float(b)]) for b in range(6) for i in range(b * 10, b * 10 + 15)]  # batches overlap: the later counts
    batches, at = spark.createDataFrame(rows, "batch int, id bigint, embedding array<double>"), f"{tmp_path}/index"
    want = {i: [float(i), float(b)] for b, i, _ in rows}
    for chunk in (1, 2, 50):
        I.build_index(batches, at, metric="L2", normalise=False, sample_size=20, partitions=3, chunk=chunk)
        held, centroids = I.read_index(spark, at)
        assert {r.id: r.embedding for r in held.collect()} == want and centroids.count() == 3 and len(I.versions(spark, at)) == 1
    I.write_update(spark.createDataFrame([(3, [9.0, 9.0]), (500, [1.0, 1.0])], "id bigint, embedding array<double>"), centroids, at, I.versions(spark, at)[-1], 1, "l2")
    want |= {3: [9.0, 9.0], 500: [1.0, 1.0]}
    assert {r.id: r.embedding for r in I.read_index(spark, at)[0].collect()} == want
    I.consolidate(spark, at, metric="L2", partitions=3)
    assert {r.id: r.embedding for r in I.read_index(spark, at)[0].collect()} == want and len(I.versions(spark, at)) == 1
    with pytest.raises(X.IndexConfigurationError):
        I.read_index(spark, f"{tmp_path}/none")


def test_deltas_are_folded(spark, tmp_path):
    at = str(tmp_path)
    for k in range(3):
        spark.createDataFrame([(1, f"v{k}", 5), (10 + k, "own", k)], "id bigint, value string, ts bigint").coalesce(1).write.mode("append").parquet(f"{at}/in")
        upsert_stream(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema, f"{at}/out", f"{at}/state").awaitTermination()
        if k == 1:
            compacted(spark, f"{at}/out")
    want = {(1, "v2", 5), (10, "own", 0), (11, "own", 1), (12, "own", 2)}
    assert {tuple(r) for r in current(spark, f"{at}/out").collect()} == want
    compacted(spark, f"{at}/out")
    assert {tuple(r) for r in current(spark, f"{at}/out").collect()} == want and current(spark, f"{at}/none") is None


def test_staged_tables_are_discarded(spark):
    import os

    from vicinal.sources.shared import discard, staged

    df = staged(spark.range(3), "x")
    assert df.count() == 3 and os.path.isdir(df.staged_at)
    discard(df, spark.range(3), None)
    assert not os.path.isdir(df.staged_at)
