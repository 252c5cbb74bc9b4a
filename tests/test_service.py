"""Annotation from start to end, sources of models, ontologies and batches, and the command line."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import errors as X
from vicinal import build_index as CLI
from vicinal.operators import activity as A
from vicinal.operators import annotate as S
from vicinal.operators import embedding as M
from vicinal.operators import index_build as I
from vicinal.operators import ontology as O
from vicinal.operators import search as N
from vicinal.sources import readers as R
from vicinal.sources.shared import copied



def now():
    return F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")


@pytest.fixture
def service(spark, tmp_path):
    users = spark.createDataFrame([(1, 100, None), (2, 3, 50)], "user_id bigint, cell_quota bigint, lifetime_cell_quota bigint").withColumns({"created_at": now(), "cells_processed": F.lit(0), "requests_processed": F.lit(0), "quota_increased": F.lit(False)})
    models = spark.createDataFrame([("open", False), ("closed", True)], "model_name string, admin_use_only boolean")
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "cas_cell_index bigint, embedding array<double>")
    metadata = index.select("cas_cell_index", F.when(F.col("cas_cell_index") < 10, "low").otherwise("high").alias("cell_type"))
    return S.Service(models, users, f"{tmp_path}/log", metadata, index, N.IndexSettings("u", 2, 3, "FLAT", "l2"))


def test_annotation_and_its_log(spark, service, tmp_path):
    np.save(f"{tmp_path}/w.npy", np.array([[1.0, 0.0], [0.0, 1.0]]))
    model = M.checkpoint_model(spark, f"{tmp_path}/w.npy")
    matrix = spark.createDataFrame([(f"q{i}", 1.0, [float(i), 1.0]) for i in (2, 15, 7)], "query_cell_id string, total_mrna_umis float, x array<float>")
    call = lambda **k: S.annotate(service, matrix, model, **{"user_id": 1, "model_name": "open", "trace_header": "abc/1", "now": now()} | k)
    got = {(r.query_cell_id, r.cell_type): r.cell_count for r in call().collect()}
    assert got == {("q2", "low"): 3, ("q15", "high"): 3, ("q7", "low"): 3}
    log = lambda: sorted((r.user_id, r.request_id, r.event, r.cell_count) for r in A.read_log(spark, service.log).collect())
    assert log() == [(1, "abc", "STARTED", 3), (1, "abc", "SUCCEEDED", 3)]
    for error, options in ((X.AccessDenied, {"model_name": "closed"}), (X.NotFound, {"model_name": "none"})):
        with pytest.raises(error):
            call(**options)
    assert len(log()) == 2
    with pytest.raises(Exception, match="the model gave"):
        S.annotate(service, matrix, lambda x, total: x[:, :1], user_id=2, model_name="open", trace_header="dd/1", now=now())
    assert log()[2:] == [(2, "dd", "FAILED", 3), (2, "dd", "STARTED", 3)]
    call(user_id=2, trace_header="ee/1")  # what failed costs nothing: 3 of 3 are left
    with pytest.raises(X.QuotaExceeded):
        call(user_id=2, trace_header="ff/1")
    assert [r for r in log() if r[1] == "ff"] == []
    with pytest.raises(X.InputError):
        M.checkpoint_model(spark, _saved(tmp_path, np.zeros(3)))


def _saved(tmp_path, x):
    np.save(f"{tmp_path}/x.npy", x)
    return f"{tmp_path}/x.npy"


OWL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Ontology rdf:about="http://x/cl.owl"/>
<owl:Class rdf:about="http://x/CL_0"><rdfs:label>cell</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/CL_1"><rdfs:label>a</rdfs:label><rdfs:subClassOf rdf:resource="http://x/CL_0"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="http://x/CL_2"><rdfs:label>b</rdfs:label><rdfs:subClassOf rdf:resource="http://x/CL_1"/><rdfs:subClassOf rdf:resource="http://x/CL_0"/></owl:Class>
<owl:Class rdf:about="http://x/GO_1"><rdfs:label>one</rdfs:label><rdfs:label>two</rdfs:label></owl:Class>
<owl:Class><rdfs:label>none</rdfs:label></owl:Class></rdf:RDF>"""


def test_owl_and_topological_order(spark, tmp_path):
    (tmp_path / "cl.owl").write_text(OWL)
    copied(spark, f"{tmp_path}/cl.owl", f"{tmp_path}/store/cl.owl")
    classes = R.owl_classes(spark, f"{tmp_path}/store/cl.owl")
    assert [tuple(r) for r in R.ontology_classes(classes).orderBy("term").collect()] == [("CL:0", "cell"), ("CL:1", "a"), ("CL:2", "b")]
    assert [(r.name, r.parents) for r in classes.orderBy("ord").collect()] == [("CL_0", []), ("CL_1", ["CL_0"]), ("CL_2", ["CL_1", "CL_0"]), ("GO_1", [])]
    edges = classes.select(F.explode("parents").alias("parent"), F.col("name").alias("child"))
    assert [(r.term, r.depth) for r in O.topological(edges).collect()] == [("CL_0", 0), ("CL_1", 1), ("CL_2", 2)]
    with pytest.raises(X.OntologyError):
        O.topological(edges.union(spark.createDataFrame([("CL_2", "CL_1")], "parent string, child string")))


def test_command_line_and_strict_batches(spark, tmp_path):
    for b in range(3):
        with gzip.open(tmp_path / f"batch_{b}.csv.gz", "wt") as f:
            f.write("".join(f"{10 * b + i},{i}.5,{b}\n" for i in range(12)))  # the last two ids come again in the next batch
    CLI.main(["--embeddings-prefix", str(tmp_path), "--index-path", f"{tmp_path}/index", "--total-batches", "3", "--embedding-dim", "2", "--training-sample-size", "15", "--distance-metric", "L2", "--no-normalize", "--update-chunk-size", "1"])
    rows, centroids = I.read_index(spark, f"{tmp_path}/index")
    assert {r.id: list(r.embedding) for r in rows.collect()} == {10 * b + i: [i + 0.5, float(b)] for b in range(3) for i in range(12)} and centroids.count() > 0
    with pytest.raises(SystemExit):
        CLI.main(["--embeddings-prefix", "x", "--index-path", "y", "--total-batches", "1", "--embedding-dim", "2", "--distance-metric", "DOT"])
    (tmp_path / "bad.csv").write_text("1,0.5,0.5\n2,x,1\n")
    with pytest.raises(Exception, match="[Mm]alformed"):
        R.embedding_batches(spark, f"{tmp_path}/bad.csv", 2).collect()
