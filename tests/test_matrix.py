"""The sparse matrix source against what was written."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vicinal import errors as X
from vicinal.sources import matrix as M
from vicinal.sources import readers as R

RNG = np.random.default_rng(1)
KIND = "query_cell_id string, total_mrna_umis float, n int, ok boolean, feature_indices array<int>, feature_values array<float>"


def rows(n, width=7):
    out = []
    for i in range(n):
        held = RNG.permutation(width)[: RNG.integers(0, width)].tolist()
        out.append((None if i % 11 == 3 else f"zelle é {i}", float(i) / 2, None if i % 5 == 0 else i, i % 2 == 0, held, [float(np.float32(j + i / 8)) for j in held]))
    return [*out, ("none", 1.0, 1, None, None, None), ("", 1.0, 1, True, [], [])]


@pytest.fixture(scope="module", params=["csr", "csc"])
def matrix(spark, tmp_path_factory, request):
    at, held = str(tmp_path_factory.mktemp("m")) + "/x", rows(230)
    M.write_matrix(spark.createDataFrame(held, KIND).repartition(3), at, layout=request.param, rowsPerPart=40, width=9)
    return at, held


def dense(r, width=9):
    x = [0.0] * width
    for i, v in zip(r[4] or [], r[5] or [], strict=True):
        x[i] = v
    return x


def test_round_trip_in_ranges(spark, matrix):
    at, held = matrix
    df = M.read_matrix(spark, at, rowsPerPartition=16)
    assert df.columns == ["row", "query_cell_id", "total_mrna_umis", "n", "ok", "feature_indices", "feature_values"]
    assert df.rdd.getNumPartitions() > len(held) // 16
    got = df.collect()
    assert sorted(r.row for r in got) == list(range(len(held)))
    key = lambda r: (r[0] or "", r[1])
    want = [(*r[:4], *(map(list, zip(*sorted(zip(r[4], r[5], strict=True)), strict=True)) if r[4] else ([], []))) for r in held]
    assert sorted((tuple(r)[1:] for r in got), key=key) == sorted(want, key=key)


def test_dense_rows_are_a_query_matrix(spark, matrix):
    at, held = matrix
    df = R.checked_matrix(M.read_matrix(spark, at, ["query_cell_id", "total_mrna_umis", "x"], rowsPerPartition=50))
    assert sorted((r[0] or "", r[1], r[2]) for r in df.collect()) == sorted((r[0] or "", r[1], dense(r)) for r in held)


def test_only_what_is_asked_for_is_opened(spark, matrix, monkeypatch):
    at, held = matrix
    opened, inner = [], M.Part.slice
    monkeypatch.setattr(M.Part, "slice", lambda self, name, a=0, z=None: (opened.append((name, z and z - a)), inner(self, name, a, z))[1])
    source = M.SparseMatrix({"path": at, "rowsPerPartition": "10"})
    reader = source.reader(M.T.StructType.fromDDL("n int, row bigint"))
    assert sum(b.num_rows for b in reader.read(reader.partitions()[1])) == 10
    assert {n.partition(".")[2] for n, _ in opened} == {"n"} and max(k for _, k in opened) == 10
    opened.clear()
    reader = source.reader(M.T.StructType.fromDDL("feature_values array<float>"))
    list(reader.read(reader.partitions()[0]))
    layout = json.load(open(f"{at}/_matrix.json"))["parts"][0]["layout"]
    assert layout == "csc" or max(k for _, k in opened) <= 70
    assert sorted(r.n or 0 for r in M.read_matrix(spark, at, ["n"]).collect()) == sorted(r[2] or 0 for r in held)


def test_comparisons_of_rows_leave_out_ranges(spark, matrix):
    at, _ = matrix
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = M.read_matrix(spark, at, ["row"], rowsPerPartition=10).filter("row >= 35 and row < 58")
        assert df.rdd.getNumPartitions() <= 4 and sorted(r.row for r in df.collect()) == list(range(35, 58))
        assert M.read_matrix(spark, at, ["row"]).filter("row in (3, 5, 9999)").count() == 2
        assert M.read_matrix(spark, at, ["row"]).filter("row = -1").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("schema", ["nothing int", "n bigint", "x array<double>"])
def test_schema_is_checked_first(spark, matrix, schema):
    spark.dataSource.register(M.SparseMatrix)
    with pytest.raises(Exception, match="matrix has no column|is int, not bigint|is array<float>, not array<double>"):
        spark.read.format("sparse_matrix").schema(schema).load(matrix[0]).collect()
    with pytest.raises(X.InputError):
        M.read_matrix(spark, matrix[0], ["nothing"])


@pytest.mark.parametrize(
    "row, options",
    [(([1], [1.0, 2.0]), {}), (([1, 1], [1.0, 2.0]), {}), (([-1], [1.0]), {}), (([9], [1.0]), {"width": 9}), (([None], [1.0]), {}), (([1], [None]), {}), (([1], [1.0]), {"layout": "coo"})],
)
def test_bad_rows_publish_nothing(spark, tmp_path, row, options):
    df = spark.createDataFrame([("a", [0], [1.0]), ("b", *row)], "k string, feature_indices array<int>, feature_values array<float>")
    with pytest.raises(Exception, match="index|values|null|csr"):
        M.write_matrix(df.repartition(2), str(tmp_path / "m"), **options)
    assert not os.path.exists(tmp_path / "m" / "_matrix.json")
    with pytest.raises(X.InputError):
        M.read_matrix(spark, str(tmp_path / "m"), ["row"])


def test_append_overwrite_and_empty(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    df = spark.createDataFrame([(1, [0, 4], [1.0, 2.0]), (2, [], [])], "k bigint, feature_indices array<int>, feature_values array<float>")
    M.write_matrix(df.limit(0), at)
    assert M.read_matrix(spark, at).count() == 0
    for _ in range(2):
        M.write_matrix(df, at, mode="append")
    assert sorted((r.row, r.k, r.x) for r in M.read_matrix(spark, at, ["row", "k", "x"]).collect())[2] [0] == 2
    assert M.read_matrix(spark, at).count() == 4
    with pytest.raises(Exception, match="other columns"):
        M.write_matrix(df.withColumnRenamed("k", "j"), at, mode="append")
    M.write_matrix(df, at)
    assert M.read_matrix(spark, at).count() == 2
    assert len([f for f in os.listdir(tmp_path / "m") if f.endswith(".npz")]) <= 2


@pytest.mark.parametrize("layout", ["csr", "csc"])
def test_small_ranges_of_a_large_matrix_share_tasks(spark, tmp_path, monkeypatch, layout):
    rows = spark.range(500).select(F.array((F.col("id") % 7).cast("int")).alias("feature_indices"), F.array(F.col("id").cast("float")).alias("feature_values"))
    M.write_matrix(rows, str(tmp_path / "m"), layout=layout, width=7, rowsPerPart=20)
    monkeypatch.setattr(M, "MOST_TASKS", 9)
    reader = M.Reader(str(tmp_path / "m"), StructType.fromDDL("row bigint, feature_values array<float>"), M.manifest_of(str(tmp_path / "m")), 3)
    tasks = reader.partitions()
    assert len(tasks) <= 9
    got = [v for t in tasks for b in reader.read(t) for v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert [r for r, _ in got] == list(range(500)) and sorted(v for _, v in got) == [[float(i)] for i in range(500)]
