"""Quotas, activity, catalog and backfills."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vicinal import errors as X
from vicinal.operators import activity as A
from vicinal.operators import backfill as B
from vicinal.operators import catalog as C

NOW = dt.datetime(2024, 1, 31, 15, 0)  # a Wednesday
USERS = "user_id bigint, created_at timestamp_ntz, cells_processed bigint, requests_processed bigint, cell_quota bigint, lifetime_cell_quota bigint, quota_increased boolean"
LOG = "user_id bigint, request_id string, cell_count bigint, event string, finished_time timestamp_ntz"


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, NOW, 0, 2, 100_000, 200_000, False), (2, NOW, 190_000, 0, 100_000, 200_000, True), (3, dt.datetime(2024, 1, 5), 0, 0, 50, None, False), (4, NOW, 0, 0, 10, 10, False)], USERS)


@pytest.fixture
def log(spark):
    rows = [
        (1, "r1", 50_000, "STARTED", NOW), (1, "r1", 50_000, "SUCCEEDED", NOW), (1, "r2", 25_000, "STARTED", NOW), (1, "r3", 9, "STARTED", NOW), (1, "r3", 9, "FAILED", NOW), (1, None, 7, "STARTED", NOW), (1, "old", 25_000, "SUCCEEDED", NOW - dt.timedelta(30)),
        (3, "r4", 20, "SUCCEEDED", dt.datetime(2024, 1, 26)), (3, "r5", 20, "SUCCEEDED", dt.datetime(2024, 1, 25, 23)), (4, "r6", 30, "SUCCEEDED", NOW),
    ]
    return spark.createDataFrame(rows, LOG)


def test_quota_report(log, users):
    got = {r.user_id: r for r in A.quota_report(log, users, F.lit(NOW)).collect()}
    assert [(got[i].remaining_weekly_quota, got[i].remaining_lifetime_quota) for i in (1, 2, 3, 4)] == [(25_000, 125_000), (10_000, 10_000), (30, None), (0, -20)]
    assert got[1].quota_reset_date == dt.datetime(2024, 2, 7)  # on the anchor's weekday a week later
    assert got[3].quota_reset_date == dt.datetime(2024, 2, 5)  # Wednesday past Friday: kept as clients know it


def test_week_and_next_anchor(users):
    row = users.filter("user_id = 3").select(A.week_start(F.lit(NOW)).alias("s"), A.next_anchor(F.lit(NOW), F.col("created_at")).alias("n")).first()
    assert (row.s, row.n) == (dt.datetime(2024, 1, 26), dt.datetime(2024, 2, 2))


def test_admission(spark, log, users):
    left = A.quota_report(log, users, F.lit(NOW)).select("user_id", F.col("remaining_weekly_quota").alias("remaining"))
    fits = spark.createDataFrame([(1, 25_000), (3, 30)], "user_id bigint, cell_count bigint")
    assert A.require_quota(fits, left).count() == 2
    with pytest.raises(X.QuotaExceeded):
        A.require_quota(spark.createDataFrame([(1, 25_001)], fits.schema), left)


def test_status_and_lifetime(log, users):
    assert {r.request_id: r.status for r in A.request_status(log).collect()} == {"r1": "SUCCEEDED", "r2": "STARTED", "r3": "FAILED", "old": "SUCCEEDED", "r4": "SUCCEEDED", "r5": "SUCCEEDED", "r6": "SUCCEEDED"}
    assert {r.user_id: (r.total_cells, r.total_requests) for r in A.lifetime(log, users).collect()} == {1: (75_000, 4), 2: (190_000, 0), 3: (40, 2), 4: (30, 1)}


def test_increase_once(users):
    once = A.increased_once(users, F.col("user_id") <= 2)
    assert {r.user_id: (r.lifetime_cell_quota, r.quota_increased) for r in once.collect()} == {1: (200_000, True), 2: (200_000, True), 3: (None, False), 4: (10, False)}


def test_activity_rows(spark):
    df = spark.createDataFrame([(1, "abc/def;o=1", "m", "x", 5), (2, "bad", "m", "x", 6)], "user_id bigint, trace_header string, model_name string, method string, cell_count bigint")
    assert [(r.request_id, r.event) for r in A.activity_rows(df, "STARTED", F.lit(NOW)).orderBy("user_id").collect()] == [("abc", "STARTED"), (None, "STARTED")]


def test_catalog(spark):
    models = spark.createDataFrame([(1, "open", False, True, 1), (2, "closed", True, False, 9)], "id bigint, model_name string, admin_use_only boolean, is_default_model boolean, cell_info_metadata_id bigint")
    assert C.visible(models, False).count() == 1 and C.visible(models, True).count() == 2
    assert C.authorised(models, "closed", True).id == 2
    with pytest.raises(X.AccessDenied):
        C.authorised(models, "closed", False)
    with pytest.raises(X.NotFound):
        C.authorised(models, "none", True)
    with pytest.raises(LookupError):
        C.one(models, F.lit(True), unique=True)
    assert {r.model_name: r.is_default_model for r in C.with_default(models, "closed").collect()} == {"open": False, "closed": True}
    metadata = spark.createDataFrame([(1, "meta")], "id bigint, name string")
    columns = spark.createDataFrame([(2, 1, "b"), (1, 1, "a")], "id bigint, cell_info_metadata_id bigint, column_name string")
    got = {r.id: r for r in C.with_relations(models, metadata, columns).collect()}
    assert [c.column_name for c in got[1].ontological_columns] == ["a", "b"] and got[2].cell_info_metadata is None
    with pytest.raises(X.NotFound):
        C.browsed(models, "users", {"model_name__eq": "open"})


def test_backfills(spark):
    target = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, v string")
    source = spark.createDataFrame([(1, None), (3, "z")], "k bigint, w string")
    assert {r.k: r.v for r in B.update_from(target, source, "k", {"v": "w"}).collect()} == {1: None, 2: "y"}
    users = spark.createDataFrame([(50_000, 200_000, False), (7, 1, True)], "cell_quota int, lifetime_cell_quota int, quota_increased boolean")
    assert [tuple(r) for r in B.marked_increased(B.raised_default_quota(users)).collect()] == [(100_000, 200_000, True), (7, 1, True)]
    assert [r.id for r in B.with_ids(target, "v").collect()] == [1, 2]
    assert B.parsed_json(spark.createDataFrame([('{"a": 1}',)], "j string"), "j").selectExpr("variant_get(j, '$.a', 'int') as a").first().a == 1
