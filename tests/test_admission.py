"""Ordered admission and the lifecycle of requests, against plain loops."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from vicinal.operators import activity as A
from vicinal.streaming.lifecycle import STORE, lifecycle_stream, statuses
from vicinal.streaming.upsert import compacted

RND = random.Random(6)
NAN = float("nan")


def fold(requests, left):
    out, rest = {}, dict(left)
    for user, t, i, c in sorted(requests, key=lambda r: (str(r[0]), r[1], r[2])):
        if user in rest:
            fits = c is not None and 0 <= c <= rest[user]
            rest[user] -= c if fits else 0
            out[i] = fits
    return out


def admitted(spark, requests, left, batch=10_000):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, "x") for r in requests], "user_id bigint, t int, id bigint, cell_count double, of string").repartition(5)
        got = A.admitted_in_order(df, spark.createDataFrame(left, "user_id bigint, remaining double"), order=["t", "id"])
        assert got.columns == [*df.columns, "remaining", "admitted"]
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.remaining for r in rows} <= {x for _, x in left}
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.admitted for r in rows}


@pytest.mark.parametrize("batch", [10_000, 7])
def test_each_request_meets_what_is_left_of_those_before(spark, batch):
    left = [(u, float(RND.choice([0, 10, 55, 100, 1e6]))) for u in range(20)]
    requests = [(RND.choice([*range(22), None]), RND.randrange(40), i, RND.choice([0.0, 1.0, 5.5, 30.0, 60.0, 1e4, -3.0, NAN, None])) for i in range(1500)]
    assert admitted(spark, requests, left, batch) == fold(requests, left)


def test_two_of_a_kind_that_do_not_fit_together(spark):
    assert admitted(spark, [(1, 0, 1, 60.0), (1, 1, 2, 60.0), (1, 2, 3, 40.0)], [(1, 100.0)]) == {1: True, 2: False, 3: True}


def test_a_hot_user(spark):
    """Most rows are one user's; what is too large or fits with all others never comes into order."""
    requests = [(7 if i % 10 else i, i, i, float(i % 17)) for i in range(40_000)]
    left = [(7, 9_000.0)] + [(i, 3.0) for i in range(0, 40_000, 10)]
    assert admitted(spark, requests, left) == fold(requests, left)


def test_empty_and_clashing(spark):
    assert admitted(spark, [], [(1, 5.0)]) == {} and admitted(spark, [(1, 0, 1, 1.0)], []) == {}
    with pytest.raises(ValueError, match="admitted"):
        A.admitted_in_order(spark.createDataFrame([(1, True)], "user_id bigint, admitted boolean"), None, order=[])


T0 = dt.datetime(2024, 1, 1)
KIND = "request_id string, event string, cell_count double, finished_time timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.05)


def run(spark, folder, **options):
    options = {"timeout": dt.timedelta(minutes=30), "chunk": 1} | options
    lifecycle_stream(spark, f"{folder}/in", spark.createDataFrame([], KIND).schema, f"{folder}/out", f"{folder}/state", **options).awaitTermination()
    found = statuses(spark, f"{folder}/out")
    return {} if found is None else {r.request_id: (r.status, r.n_rows) for r in found.collect()}


def test_the_stream_ends_where_the_batch_query_does(spark, tmp_path):
    """Random logs in order of time; the second half comes after a stop, and goes on from the checkpoint."""
    rows = sorted(((f"r{RND.randrange(60)}", RND.choice(["STARTED", "STARTED", "STARTED", "SUCCEEDED", "FAILED"]), RND.choice([None, 1.0, 7.0]), at(RND.randrange(4000) / 10)) for _ in range(150)), key=lambda r: r[3])
    rows += [("s1", "STARTED", 1.0, at(399.95)), ("s2", "STARTED", 1.0, at(399.97))]
    before = spark.conf.get(STORE, None)
    for part in (rows[:50], rows[50:90]):
        put(spark, tmp_path, part)
    first = run(spark, str(tmp_path))
    assert len(first) == len({r[0] for r in rows[:90]})
    for part in (rows[90:120], [*rows[120:], (None, "FAILED", 1.0, at(1)), ("x", "STARTED", 1.0, None)]):
        put(spark, tmp_path, part)
    got = run(spark, str(tmp_path))
    df = spark.createDataFrame(rows, KIND)
    want = A.request_status_with_timeout(df, F.expr("interval 30 minutes"), F.lit(rows[-1][3]))
    assert got == {r.request_id: (r.status, r.n_rows) for r in want.collect()}
    assert {s for s, _ in got.values()} == {"STARTED", "SUCCEEDED", "FAILED"}
    compacted(spark, f"{tmp_path}/out", id_col="request_id", order="changes", by_turn=True)
    assert {r.request_id: (r.status, r.n_rows) for r in statuses(spark, f"{tmp_path}/out").collect()} == got
    assert spark.conf.get(STORE, None) == before


def test_a_timer_ends_a_request_and_late_rows_are_dropped(spark, tmp_path):
    put(spark, tmp_path, [("a", "STARTED", 1.0, at(0)), ("b", "STARTED", 1.0, at(20))])
    put(spark, tmp_path, [("c", "STARTED", 1.0, at(40))])
    assert run(spark, str(tmp_path)) == {"a": ("FAILED", 1), "b": ("STARTED", 1), "c": ("STARTED", 1)}
    put(spark, tmp_path, [("a", "SUCCEEDED", 1.0, at(10)), ("b", "SUCCEEDED", 1.0, at(45)), ("c", "SUCCEEDED", 1.0, at(90))])
    assert run(spark, str(tmp_path)) == {"a": ("FAILED", 1), "b": ("SUCCEEDED", 2), "c": ("FAILED", 2)}


def test_a_delay_lets_rows_come_out_of_order(spark, tmp_path):
    put(spark, tmp_path, [("a", "SUCCEEDED", 1.0, at(70)), ("b", "FAILED", 1.0, at(60))])
    put(spark, tmp_path, [("a", "STARTED", 1.0, at(50))])
    assert run(spark, str(tmp_path), delay=dt.timedelta(minutes=30)) == {"a": ("SUCCEEDED", 2), "b": ("FAILED", 1)}


def test_states_go_and_requests_begin_anew(spark, tmp_path):
    options = {"keep": dt.timedelta(minutes=60)}
    put(spark, tmp_path, [("a", "FAILED", 1.0, at(0))])
    put(spark, tmp_path, [("b", "SUCCEEDED", 1.0, at(100))])
    assert run(spark, str(tmp_path), **options) == {"a": ("FAILED", 1), "b": ("SUCCEEDED", 1)}
    put(spark, tmp_path, [("a", "SUCCEEDED", 1.0, at(110)), ("b", "FAILED", 1.0, at(111))])
    assert run(spark, str(tmp_path), **options) == {"a": ("SUCCEEDED", 1), "b": ("FAILED", 2)}


def test_a_state_that_is_gone_is_not_continued_in_the_same_run(spark, tmp_path):
    """What the watermark says holds before the rows of the next micro-batch, and a fold of deltas changes nothing."""
    for minute, request, event in ((0, "a", "FAILED"), (100, "b", "SUCCEEDED"), (110, "a", "SUCCEEDED"), (120, "c", "STARTED"), (200, "b", "STARTED")):
        put(spark, tmp_path, [(request, event, 1.0, at(minute))])
    assert run(spark, str(tmp_path), keep=dt.timedelta(minutes=60)) == {"a": ("SUCCEEDED", 1), "b": ("SUCCEEDED", 2), "c": ("FAILED", 1)}


def test_deltas_are_folded_as_they_come(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vicinal.streaming.lifecycle.FOLDED", 2)
    for minute, event in enumerate(["STARTED", "STARTED", "STARTED", "STARTED", "SUCCEEDED"]):
        put(spark, tmp_path, [("a", event, 1.0, at(minute)), (f"r{minute}", "STARTED", 1.0, at(minute))])
    assert run(spark, str(tmp_path))["a"] == ("SUCCEEDED", 5)
    assert len([p for p in (tmp_path / "out").iterdir()]) <= 3
