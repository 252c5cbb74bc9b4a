"""Database tables, retries and quarantined lines."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from vicinal import errors as X
from vicinal import retry as Y
from vicinal.operators import index_build as I
from vicinal.sources import database as D
from vicinal.sources import readers as R


@pytest.fixture(scope="module")
def url(tmp_path_factory):
    return f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"


def rows(spark, n, sign=1):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * sign).cast("double").alias("v"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("näme 'x' "), "id")).alias("name"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("t"), (F.col("id") % 2 == 0).alias("even"))


def test_round_trip_in_partitions(spark, url):
    df = rows(spark, 1000)
    assert D.upsert_table(df, url, "round", ["k"], "first", batch_rows=100)
    got = D.read_table(spark, url, "round", "k", rows_per_partition=150)
    assert got.rdd.getNumPartitions() == 7 and got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    few = got.filter("v >= 900 and name is not null").select("k")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(v,900.0)" in plan.replace("*", "") and "ReadSchema: struct<k:bigint>" in plan
    assert few.count() == sum(i % 3 > 0 for i in range(900, 1000))


def test_a_write_again_writes_nothing(spark, url):
    assert D.upsert_table(rows(spark, 50), url, "twice", ["k"], "w1")
    assert D.upsert_table(rows(spark, 80, -1).filter("k >= 40"), url, "twice", ["k"], "w2")
    assert not D.upsert_table(rows(spark, 50), url, "twice", ["k"], "w1")
    got = {r.k: r.v for r in D.read_table(spark, url, "twice", "k").collect()}
    assert got == {i: float(i if i < 40 else -i) for i in range(80)}


def test_a_write_that_fails_leaves_nothing_and_can_be_repeated(spark, url, monkeypatch):
    assert D.upsert_table(rows(spark, 10), url, "broken", ["k"], "b0")
    with pytest.raises(Exception, match="duplicate key|STAGE|stage"):
        D.upsert_table(rows(spark, 5).union(rows(spark, 5)), url, "broken", ["k"], "b1")
    inner, calls = D.execute, []

    def lost(link, sql, *values):
        calls.append(sql)
        if sql.startswith("insert into") and "select" in sql:
            raise ConnectionError("lost")
        return inner(link, sql, *values)

    monkeypatch.setattr(D, "execute", lost)
    with pytest.raises(ConnectionError):
        D.upsert_table(rows(spark, 20, -1), url, "broken", ["k"], "b2")
    monkeypatch.undo()
    assert {r.k: r.v for r in D.read_table(spark, url, "broken", "k").collect()} == {i: float(i) for i in range(10)}
    assert Y.Retry(2, 0, 0).call(lambda: D.upsert_table(rows(spark, 20, -1), url, "broken", ["k"], "b2"))
    assert {r.k: r.v for r in D.read_table(spark, url, "broken", "k").collect()} == {i: float(-i) for i in range(20)}
    assert not any(D.exists(spark, url, f"stage_b{k}") for k in (0, 2))


def test_names_and_types_are_checked(spark, url):
    for bad in ("x; drop", 'a"b', ""):
        with pytest.raises(X.InputError):
            D.upsert_table(rows(spark, 1), url, bad, ["k"], "n1")
    for keys, write_id in ((["nothing"], "n2"), ([], "n2"), (["k"], "no-id")):
        with pytest.raises(X.InputError):
            D.upsert_table(rows(spark, 1), url, "names", keys, write_id)
    with pytest.raises(X.InputError):
        D.upsert_table(rows(spark, 1).withColumn("a", F.array("k")), url, "names", ["k"], "n3")
    D.create_table(spark, url, "none", rows(spark, 1).schema, ["k"])
    assert D.read_table(spark, url, "none", "k").count() == 0


def flaky(spark, at, times, error):
    """A source whose task fails until it has failed `times` times."""
    def run(batches):
        n = len(os.listdir(at))
        if n < times:
            open(f"{at}/{n}", "w").close()
            raise error
        yield from batches

    return spark.range(5, numPartitions=1).mapInArrow(run, "id bigint")


def test_a_source_that_fails_twice_succeeds(spark, tmp_path):
    waits = []
    policy = Y.Retry(4, 1, 3)
    got = policy.frame(lambda: flaky(spark, tmp_path, 2, ConnectionResetError("away")), "flaky", sleep=waits.append)
    assert got.count() == 5 and waits == [1, 2] and len(os.listdir(tmp_path)) == 2


def test_errors_of_data_fail_at_once(spark, tmp_path):
    waits = []
    (tmp_path / "bad.csv").write_text("1,2.0\n1,x\n")
    bad = lambda: R.embedding_batches(spark, str(tmp_path / "bad.csv"), 1)
    for make in (bad, lambda: spark.range(1).select("nothing"), lambda: spark.read.parquet(str(tmp_path / "none")), lambda: flaky(spark, tmp_path, 99, ValueError("TimeoutError is only a word here"))):
        with pytest.raises(Exception):  # noqa: B017
            Y.BUILD.frame(make, "bad", sleep=waits.append)
    assert waits == []
    with pytest.raises(X.SearchError):
        Y.SEARCH.call(lambda: (_ for _ in ()).throw(X.SearchError("TimeoutError")), sleep=waits.append)
    assert waits == []


def test_policies(spark):
    assert [*Y.BUILD.waits()] == [10, 20, 40, 60] and Y.BUILD.attempts == 5
    assert all(a <= w <= a + 2 for a, w in zip([1, 2], Y.SEARCH.waits(), strict=True))
    calls = []
    with pytest.raises(TimeoutError):
        Y.Retry(3, 0, 0).call(lambda: (calls.append(1), (_ for _ in ()).throw(TimeoutError()))[1], sleep=lambda _: None)
    assert len(calls) == 3
    for bad in ({"attempts": 0}, {"first": -1}, {"factor": 0.5}):
        with pytest.raises(ValueError):
            Y.Retry(**{"attempts": 1, "first": 1, "most": 1} | bad)
    error = spark._jvm.java.lang.RuntimeException("outer", spark._jvm.java.net.ConnectException("refused"))
    assert Y.is_transport(type("E", (Exception,), {"_origin": error})()) and not Y.is_transport(type("E", (Exception,), {"_origin": spark._jvm.java.io.FileNotFoundException("x")})())


def test_steps_of_a_build_are_tried_again(spark, tmp_path, monkeypatch):
    batches = spark.createDataFrame([(i % 3, i, [float(i), 1.0]) for i in range(60)], "batch int, id bigint, embedding array<double>")
    inner, failed = I.write_update, []

    def write(*a):
        if len(failed) < 2:
            failed.append(a[4])
            raise ConnectionError("away")
        inner(*a)

    monkeypatch.setattr(I, "write_update", write)
    I.build_index(batches, str(tmp_path / "i"), metric="L2", sample_size=1, partitions=3, chunk=1, retry=Y.Retry(3, 0, 0))
    assert failed == [0, 0] and I.read_index(spark, str(tmp_path / "i"))[0].count() == 60


@pytest.mark.parametrize("split", [1 << 27, 4000])
def test_bad_lines_are_put_apart(spark, tmp_path, split):
    rnd = random.Random(1)
    good, bad = set(), set()
    for f in range(3):
        lines = []
        for n in range(1, 701):
            kind = rnd.random()
            if kind < 0.96:
                lines.append(f"{f * 1000 + n},{n / 4},-1.5e3,{f}")
                good.add((f * 1000 + n, n / 4, -1500.0, float(f)))
            else:
                text, why = rnd.choice([("x,1,2,3", "not a number"), (f"{n},1,2", "2 components of 3"), (f"{n},1,2,3,4", "4 components of 3"), (",1,2,3", "no id"), (f"{n},1,,3", "an empty component"), (f"{n},1,zwei,3", "not a number"), ("", None), ("   ", None)])
                lines.append(text)
                if why:
                    bad.add((f, n, text, why))
        data = ("\n".join(lines) + "\n" * (f > 0)).encode()
        if f == 2:
            with gzip.open(tmp_path / "b2.csv.gz", "wb") as out:
                out.write(data)
        else:
            (tmp_path / f"b{f}.csv").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, lines = R.quarantined_batches(spark, str(tmp_path), 3)
        assert {(r.id, *r.embedding) for r in rows.collect()} == good
        assert {(int(r.file.split("/b")[-1][0]), r.line, r.value, r.reason) for r in lines.collect()} == bad and lines.count() == len(bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quarantined_lines_keep_the_order_of_ids(spark, tmp_path):
    """Enough rows for the sort that a writer adds by its partitions to lose the order of ids."""
    from vicinal.plans.queries import QUERIES

    e = spark.range(12_000).repartition(7).select(F.col("id").alias("vec_id"), (F.xxhash64("id") % 5 + 5).cast("int").alias("label"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["csv_quarantine_bad"](spark, str(tmp_path)).collect()))
    turns, want, why = {}, [], {7: "not a number", 33: "60 components of 64", 58: "no id"}
    for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "label").orderBy("vec_id").collect():
        turns[r.label] = turns.get(r.label, 0) + 1
        if r.vec_id % 100 in why:
            want.append((f"label_{r.label}", turns[r.label], why[r.vec_id % 100]))
    assert got == sorted(want)


def test_an_embedded_database_of_a_cluster_goes_by_files(spark, tmp_path, monkeypatch):
    """No executor may open it: reads and writes by JDBC are errors here, as they are between processes."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    odd = ["", " a ", 'say ""x"', "a,b", "two\nlines", None, "näme", '"', ",", "\\"]
    df = rows(spark, 900).withColumn("name", F.array(*map(F.lit, odd))[(F.col("k") % 10).cast("int")]).withColumn("v", F.when(F.col("k") % 4 > 0, F.col("v") / 7 * 1e12))
    want = sorted(map(str, map(tuple, df.collect())))
    monkeypatch.setattr(D, "apart", lambda spark, url: True)
    monkeypatch.setattr(type(df.write), "save", None)
    assert D.upsert_table(df.filter("k < 500"), url, "t", ["k"], "w1") and not D.upsert_table(df, url, "t", ["k"], "w1")
    assert D.upsert_table(df.filter("k >= 300"), url, "t", ["k"], "w2") and D.upsert_table(df.limit(0), url, "t", ["k"], "w3")
    got = D.read_table(spark, url, "t", "k", rows_per_partition=200)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, map(tuple, got.select(df.columns).collect()))) == want
    with pytest.raises(Exception, match="duplicate key|STAGE|stage"):
        D.upsert_table(df.union(df), url, "t", ["k"], "w4")
    assert D.read_table(spark, url, "t", "k").count() == 900
