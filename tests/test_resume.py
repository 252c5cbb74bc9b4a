"""A build that fails goes on behind its last finished step."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import index_build as I

M = np.random.default_rng(2).normal(size=(240, 4))


def batches(spark, sign=1):
    rows = [(i % 7, i if i < 200 else i - 200, [float(x) for x in sign * v]) for i, v in enumerate(M)]
    return spark.createDataFrame(rows, "batch int, id bigint, embedding array<double>").repartition(3)


def build(spark, path, **options):
    I.build_index(batches(spark), path, **{"sample_size": 1, "partitions": 5, "chunk": 2, "metric": "L2"} | options)


def content(spark, path):
    rows, _ = I.read_index(spark, path)
    return sorted((r.id, tuple(np.round(r.embedding, 9))) for r in rows.collect())


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def stop_at(monkeypatch, step):
    """Fail before the given update is written; the updates that were begun are returned as they come."""
    begun, inner = [], I.write_update

    def write(rows, centroids, path, version, update, metric):
        begun.append((version, update))
        if (version, update) == step:
            raise RuntimeError("lost")
        inner(rows, centroids, path, version, update, metric)

    monkeypatch.setattr(I, "write_update", write)
    return begun


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole")) + "/i"
    build(spark, at)
    return content(spark, at)


@pytest.mark.parametrize("step", [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)])
def test_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, undisturbed, step):
    at = str(tmp_path / "i")
    stop_at(monkeypatch, step)
    with pytest.raises(RuntimeError, match="lost"):
        build(spark, at)
    monkeypatch.undo()
    before = files(at)
    begun = stop_at(monkeypatch, None)
    trained = []
    monkeypatch.setattr(I, "trained_centroids", lambda *a, f=I.trained_centroids, **k: (trained.append(1), f(*a, **k))[1])
    kept = {}
    monkeypatch.setattr(I, "consolidate", lambda *a, f=I.consolidate, **k: (kept.update(files(at)), f(*a, **k))[1])
    build(spark, at)
    if step[0] == 0:
        assert begun == [(0, k) for k in range(step[1], 4)] + [(1, 0)] and len(trained) == 1
        assert {k: v for k, v in kept.items() if k in before and "/update=" in k} == {k: v for k, v in before.items() if "/update=" in k}
    assert content(spark, at) == undisturbed
    assert not os.path.exists(f"{at}/version={I.versions(spark, at)[-1]}/build")


def test_other_batches_or_settings_begin_anew(spark, tmp_path, monkeypatch, undisturbed):
    at = str(tmp_path / "i")
    stop_at(monkeypatch, (0, 2))
    with pytest.raises(RuntimeError):
        build(spark, at, partitions=4)
    monkeypatch.undo()
    begun = stop_at(monkeypatch, None)
    build(spark, at)
    assert begun[0] == (0, 0) and content(spark, at) == undisturbed


def test_an_entry_that_was_not_put_in_place_does_not_count(spark, tmp_path):
    sizes = batches(spark).groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))
    log = I.BuildLog(spark, str(tmp_path / "v"), sizes, (1,))
    log.add("trained")
    half = tmp_path / "v" / "build" / f"update-0.{log.mark}.half"
    half.write_text("")
    again = I.BuildLog(spark, str(tmp_path / "v"), sizes.repartition(5), (1,))
    assert again.done("trained") and not again.done("update-0")
    assert not I.BuildLog(spark, str(tmp_path / "v"), sizes, (2,)).done("trained") and not os.path.exists(half)
