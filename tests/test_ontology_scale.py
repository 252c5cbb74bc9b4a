"""Work and plans of ontologies that grow."""

import pytest
from pyspark.sql import functions as F

from vicinal import errors as X
from vicinal.operators import ontology as O
from vicinal.sources import readers as R


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def test_names_of_a_document_are_joined_and_not_searched(spark):
    doc = O.resource(spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "term string, name string"), edges(spark, [("a", "b"), ("a", "c")]), "a")
    terms = R.resource_terms(doc.withColumn("cell_ontology_term_id_to_cell_type", F.expr("map('a', 'A', 'b', 'B', 'c', 'C')")))
    assert sorted(map(tuple, terms.collect())) == [(0, "a", "A"), (1, "b", "B"), (2, "c", "C")]
    assert "element_at" not in terms._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(X.OntologyError):
        R.resource_terms(doc)


def test_closure_with_one_parent_each_makes_nothing_distinct(spark):
    chain = spark.range(1, 200).select(F.when(F.col("id") % 70 > 0, F.col("id") - 1).otherwise(F.lit(1000)).alias("parent"), F.col("id").alias("child"))
    got = O.closure(chain.unionByName(chain))  # an edge that comes twice is one
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    up = {r.child: r.parent for r in chain.collect()}
    want = []
    for t in up:
        a = t
        while a in up:
            a = up[a]
            want.append((t, a))
    assert sorted(map(tuple, got.select("term", "ancestor").collect())) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_cycles_of_one_parent_each(spark, n):
    with pytest.raises(X.OntologyError):
        O.closure(edges(spark, [(str(i), str((i + 1) % n)) for i in range(n)] + [("0", "below"), ("below", "lower")]))


def test_paths_and_closures_broadcast_nothing(spark, monkeypatch):
    plans = []
    inner = O.staged

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df, name)

    monkeypatch.setattr(O, "staged", kept)
    dense = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("b", "e")])
    assert {(r.term, r.depth) for r in O.topological(dense).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert O.closure(dense).count() == 9 and O.closure(edges(spark, [("a", "b"), ("b", "c")])).count() == 3
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
