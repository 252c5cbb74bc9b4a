"""Consensus strategies and the ontology on a small graph with known results."""

import pytest

from vicinal import errors as X
from vicinal.operators import consensus as K
from vicinal.operators import lookup as L
from vicinal.operators import ontology as O
from vicinal.sources import readers as R
from vicinal.sources import writers as W

# A part of the public cell ontology, its terms in document order, and its edges.
TERMS = [
    ("CL:0000000", "cell"), ("CL:0000003", "native cell"), ("CL:0000548", "animal cell"), ("CL:0000988", "hematopoietic cell"), ("CL:0002371", "somatic cell"), ("CL:0000738", "leukocyte"), ("CL:0000084", "T cell"),
    ("CL:0000542", "lymphocyte"), ("CL:0000226", "single nucleate cell"), ("CL:0000219", "motile cell"), ("CL:0002242", "nucleate cell"), ("CL:0000255", "eukaryotic cell"), ("CL:0000842", "mononuclear cell"), ("CL:0000789", "alpha-beta T cell"),
]
CHILDREN = {
    "CL:0000000": ["CL:0000003"], "CL:0000003": ["CL:0000219", "CL:0000255", "CL:0002242", "CL:0002371"], "CL:0000084": ["CL:0000789"], "CL:0000219": ["CL:0000738"], "CL:0000226": ["CL:0000842"], "CL:0000255": ["CL:0000548"], "CL:0000542": ["CL:0000084"],
    "CL:0000548": ["CL:0000988"], "CL:0000738": ["CL:0000842"], "CL:0000789": [], "CL:0000842": ["CL:0000542"], "CL:0000988": ["CL:0000738"], "CL:0002242": ["CL:0000226", "CL:0000738"], "CL:0002371": ["CL:0000988"],
}
SHORTEST = {"CL:0000000": 0, "CL:0000003": 1, "CL:0000084": 6, "CL:0000219": 2, "CL:0000226": 3, "CL:0000255": 2, "CL:0000542": 5, "CL:0000548": 3, "CL:0000738": 3, "CL:0000789": 7, "CL:0000842": 4, "CL:0000988": 3, "CL:0002242": 2, "CL:0002371": 2}
LONGEST = {"CL:0000000": 0, "CL:0000003": 1, "CL:0000084": 8, "CL:0000219": 2, "CL:0000226": 3, "CL:0000255": 2, "CL:0000542": 7, "CL:0000548": 3, "CL:0000738": 5, "CL:0000789": 9, "CL:0000842": 6, "CL:0000988": 4, "CL:0002242": 2, "CL:0002371": 2}


@pytest.fixture
def graph(spark):
    terms = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(TERMS)], "ord int, term string, name string")
    return terms, spark.createDataFrame([(p, c) for p, cs in CHILDREN.items() for c in cs], "parent string, child string")


@pytest.fixture
def near(spark):
    rows = [("q", 1, 48033450, 0.9), ("q", 2, 1384010152, 0.87)]
    meta = [(48033450, "alpha-beta T cell", "CL:0000789"), (1384010152, "T cell", "CL:0000084")]
    return spark.createDataFrame(rows, "query_cell_id string, rank bigint, cas_cell_index bigint, distance double"), spark.createDataFrame(meta, "cas_cell_index bigint, cell_type string, cell_type_ontology_term_id string")


def test_ontology_aware(spark, graph, near):
    terms, edges = graph
    rows = L.with_metadata(*near, ["cell_type", "cell_type_ontology_term_id"])
    got = K.ontology_scores(rows, terms, O.closure(edges), prune_threshold=0.1).orderBy("position").collect()
    assert [(r.cell_type_ontology_term_id, r.cell_type) for r in got] == TERMS
    assert [r.score for r in got] == pytest.approx([1.0] * 13 + [0.4915262351434047])
    t = K.totals(K.weighted(rows, terms)).first()
    assert (t.total_weight, t.total_neighbors, t.total_neighbors_unrecognized) == (pytest.approx(0.7358645669875553), 2, 0)
    nested = K.as_response(K.ontology_scores(rows, terms, O.closure(edges)), ["score", "cell_type_ontology_term_id", "cell_type"]).first()
    assert [m.cell_type for m in nested.matches] == [n for _, n in TERMS]
    assert K.ontology_scores(rows, terms, O.closure(edges), prune_threshold=0.5).count() == 13


def test_unknown_terms_count_in_the_total(spark, graph, near):
    terms, edges = graph
    meta = near[1].replace({"CL:0000084": "CL:9"}).union(spark.createDataFrame([(5, "none", None)], near[1].schema))
    rows = L.with_metadata(near[0].union(spark.createDataFrame([("q", 3, 5, 0.88)], near[0].schema)), meta, ["cell_type", "cell_type_ontology_term_id"])
    got = {r.cell_type_ontology_term_id: r.score for r in K.ontology_scores(rows, terms, O.closure(edges), prune_threshold=0).collect()}
    assert len(got) == 14 and 0.3 < got["CL:0000000"] == got["CL:0000789"] < 0.4
    assert K.totals(K.weighted(rows, terms)).first().total_neighbors_unrecognized == 2


def test_median_of_zero_gives_null(spark, graph, near):
    terms, edges = graph
    rows = L.with_metadata(near[0].selectExpr("query_cell_id", "rank", "cas_cell_index", "0.0d as distance"), near[1], ["cell_type_ontology_term_id"])
    assert {r.score for r in K.ontology_scores(rows, terms, O.closure(edges), prune_threshold=0).collect()} == {None} or K.weighted(rows, terms).first().weight is None


def test_summary_statistics(near):
    got = K.summarize("summary_statistics", L.with_metadata(*near, ["cell_type"])).orderBy("position").collect()
    assert [(r.cell_type, r.cell_count, r.min_distance, r.p25_distance, r.median_distance, r.p75_distance, r.max_distance) for r in got] == [("alpha-beta T cell", 1, 0.9, 0.9, 0.9, 0.9, 0.9), ("T cell", 1, 0.87, 0.87, 0.87, 0.87, 0.87)]


def test_metadata(spark, near):
    with pytest.raises(X.MetadataError):
        L.requested_ids(spark, [])
    with pytest.raises(X.MetadataError):
        L.with_metadata(near[0], near[1].limit(1), ["cell_type"])
    ids = L.requested_ids(spark, [1384010152, 7, 48033450, 1384010152])
    assert [r.cas_cell_index for r in L.metadata_by_ids(ids, near[1], ["cas_cell_index", "cell_type"]).collect()] == [1384010152, 48033450, 1384010152]


def test_graph(graph):
    terms, edges = graph
    pairs = O.closure(edges)
    assert pairs.count() == 74
    assert {r.term: r.children for r in O.children(terms, edges).collect()} == CHILDREN
    assert {r.term: r.length for r in O.shortest_paths(edges).collect()} == SHORTEST
    assert {r.term: r.length for r in O.longest_paths(edges).collect()} == LONGEST
    found = {r.term: r.ancestors for r in O.ancestors(terms, pairs).collect()}
    assert found["CL:0000000"] == [] and found["CL:0000226"] == ["CL:0000000", "CL:0000003", "CL:0002242"]


def test_cycles_and_unreachable_terms(spark, graph):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    for f in (O.closure, lambda e: O.longest_paths(e, "a")):
        with pytest.raises(X.OntologyError):
            f(loop)
    far = graph[1].union(spark.createDataFrame([("CL:9999998", "CL:9999999")], graph[1].schema))
    assert "CL:9999999" not in {r.term for r in O.shortest_paths(far).collect()} | {r.term for r in O.longest_paths(far).collect()}


def test_document(spark, graph, tmp_path):
    terms, edges = graph
    W.write_document(O.resource(terms, edges), f"{tmp_path}/doc")
    doc = R.ontology_resource(spark, f"{tmp_path}/doc")
    served = O.served(doc).first()
    assert served.cl_names == sorted(t for t, _ in TERMS) and "ancestors_dictionary" not in served.asDict()
    assert served.longest_path_lengths_from_cell_root == LONGEST
    assert R.resource_closure(doc).count() == 74 and R.resource_terms(doc).count() == 14
    spark.createDataFrame([('{"ancestors_dictionary": {}}',)], "value string").write.text(f"{tmp_path}/bad")
    with pytest.raises(X.OntologyError):
        R.ontology_resource(spark, f"{tmp_path}/bad")


def test_classes(spark):
    rows = [(0, "CL_0000000", ["cell"]), (1, "CL_1", ["a", "b"]), (2, "GO_1", ["x"]), (3, "CL_2", []), (4, "CL_0000000", ["later"]), (5, "CL_CL_3", ["y"])]
    got = {r.term: r.label for r in R.ontology_classes(spark.createDataFrame(rows, "ord int, name string, labels array<string>")).collect()}
    assert got == {"CL:0000000": "cell", "CL:CL_3": "y"}
    edges = O.edges_of(spark.createDataFrame([("a",), ("b",)], "term string"), *(spark.createDataFrame(x, "parent string, child string") for x in ([("a", "b"), ("a", "z")], [("a", "b"), ("z", "b")])))
    assert [tuple(r) for r in edges.collect()] == [("a", "b")]
    with pytest.raises(X.OntologyError):
        O.require_column(spark.createDataFrame([(1, "cell_type")], "cell_info_metadata_id bigint, column_name string"), 1, "tissue")
