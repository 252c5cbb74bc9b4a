"""The driver's queries on its synthetic tables, each with SQL that says the same.

Stand-ins: `embeddings` is the index (vec_id: id, label: term) and, where vec_id % 50 = 0, the queries; `part` is metadata; labels 0-7
form a tree with parent (label - 1) // 2, labels 8 and 9 are unknown terms; `events` is the activity log.
"""

from __future__ import annotations

import datetime
import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import activity as A
from ..operators import backfill as B
from ..operators import catalog as C
from ..operators import cells as Y
from ..operators import consensus as K
from ..operators import embedding as M
from ..operators import graph as G
from ..operators import index_build as I
from ..operators import lookup as L
from ..operators import ontology as O
from ..operators import search as N
from ..sources import database as D
from ..sources import matrix as X
from ..sources import readers as R
from ..sources import writers as W
from ..sources.shared import new_path, staged
from ..streaming.lifecycle import lifecycle_stream, statuses
from ..streaming.upsert import current, upsert_stream
from . import templates as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table_query(name: str, table: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query of one table."""
    query(name, sql)(lambda spark, d: build(R.table(spark, d, table)))


# Filters and projections

for _name, _table, _filters, _columns, _sql in [
    ("filter_eq", "part", {"p_type__eq": "ECONOMY"}, ["p_partkey", "p_type"], "p_type = 'ECONOMY'"),
    ("filter_not_eq", "orders", {"o_orderstatus__not_eq": "O"}, ["o_orderkey", "o_orderstatus"], "o_orderstatus <> 'O'"),
    ("filter_in", "part", {"p_brand__in": ["Brand#1", "Brand#2"]}, ["p_partkey", "p_brand"], "p_brand in ('Brand#1', 'Brand#2')"),
    ("filter_not_in", "part", {"p_size__not_in": [1, 2, 3, 4, 5]}, ["p_partkey", "p_size"], "p_size not in (1, 2, 3, 4, 5)"),
    ("filter_gt", "lineitem", {"l_quantity__gt": 45}, ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity > 45"),
    ("filter_gte", "lineitem", {"l_discount__gte": 0.09}, ["l_orderkey", "l_linenumber", "l_discount"], "l_discount >= 0.09"),
    ("filter_lt", "part", {"p_retailprice__lt": 950.5}, ["p_partkey", "p_retailprice"], "p_retailprice < 950.5"),
    ("filter_lte", "part", {"p_size__lte": 3}, ["p_partkey", "p_size"], "p_size <= 3"),
    ("filter_and_combo", "lineitem", {"l_returnflag__eq": "A", "l_quantity__lt": 10, "l_linestatus__not_eq": "O", "l_linenumber__in": [1, 2]}, ["l_orderkey", "l_linenumber", "l_quantity"], "l_returnflag = 'A' and l_quantity < 10 and l_linestatus <> 'O' and l_linenumber in (1, 2)"),
]:
    table_query(_name, _table, f"select {', '.join(_columns)} from {_table} where {_sql}", functools.partial(lambda df, f, c: P.select(df.filter(P.where(f)), c), f=_filters, c=_columns))

table_query("select_dedup_lower", "part", "select p_partkey, p_type from part", lambda df: P.select(df, ["P_PARTKEY", "p_type", "p_partkey"]))
table_query("select_star", "region", "select * from region", lambda df: P.select(df, []))
table_query("strip_alias", "part", "select p_partkey, p_brand from part", lambda df: P.select_bare(df.alias("c"), ["c.p_partkey", "c.p_brand"]))
table_query("required_columns", "part", "select p_partkey as cas_cell_index, p_brand as cas_ingest_id, p_type from part", lambda df: P.select_bare(df.withColumnsRenamed({"p_partkey": "cas_cell_index", "p_brand": "cas_ingest_id"}).alias("c"), P.with_required(["c.p_type"])))
table_query("shorten_value", "customer", "select c_custkey, case when v is null then '' when length(v) > 20 then v[1:20] || '...' else v end as short from (select c_custkey, case when c_custkey % 3 > 0 then c_name || '-' || c_mktsegment when c_custkey % 2 > 0 then c_mktsegment end as v from customer)", lambda df: df.select("c_custkey", S.shortened(F.when(F.col("c_custkey") % 3 > 0, F.concat("c_name", F.lit("-"), "c_mktsegment")).when(F.col("c_custkey") % 2 > 0, F.col("c_mktsegment"))).alias("short")))


@query("template_join_group_limit", "select o_orderpriority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R' and o_orderstatus in ('F', 'O') group by 1 order by 1 limit 10")
def template_join_group_limit(spark: SparkSession, d: str) -> DataFrame:
    names = {}
    for name in ("orders", "lineitem"):
        names[name] = f"{name}_{uuid.uuid4().hex[:8]}"
        R.table(spark, d, name).createOrReplaceTempView(names[name])
    text = "{select}, count(*) as n\nfrom {orders} o join {lineitem} l on o.o_orderkey = l.l_orderkey\n{where}\ngroup by 1 order by 1 limit 10"
    q = T.render(text, select=["o_orderpriority"], filters={"l_returnflag__eq": "R", "o_orderstatus__in": ["F", "O"]}, **names)
    T.validate(spark, q)
    return q.run(spark)


@query("list_feature_schemas", "select * from (values ('genes_a'), ('genes_b'), ('genes_c')) t(schema_name)")
def list_feature_schemas(spark: SparkSession, d: str) -> DataFrame:
    db, at = f"features_{uuid.uuid4().hex[:8]}", new_path(spark, "features")
    spark.sql(f"create database {db} location '{at}'")
    for name in ("genes_a", "genes_b", "genes_c"):
        R.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("index"), F.col("p_name").alias("feature_name")).write.saveAsTable(f"{db}.{name}")
    return C.feature_schemas(spark, db)


@query("feature_schema_ordered", "select cast(p_partkey as integer) as index, p_name as feature_name from part order by 1")
def feature_schema_ordered(spark: SparkSession, d: str) -> DataFrame:
    name = f"genes_{uuid.uuid4().hex[:8]}"
    R.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("index"), F.col("p_name").alias("feature_name")).createOrReplaceTempView(name)
    return C.features(spark, name)


# Metadata

for _name, _ids in (("metadata_lookup_ordered", [17, 3, 120, 64, 9]), ("metadata_lookup_missing_ids", [5, -1, 8, 99_999_999, 2]), ("metadata_lookup_duplicates", [7, 7, 1, 7, 3])):

    def _lookup(spark: SparkSession, d: str, ids=_ids) -> DataFrame:
        part = R.table(spark, d, "part").withColumnRenamed("p_partkey", "cas_cell_index")
        return L.metadata_by_ids(L.requested_ids(spark, ids), part, ["cas_cell_index", "p_type", "p_brand"])

    _values = ", ".join(f"({i}, {x})" for i, x in enumerate(_ids))
    query(_name, f"select cast(pos as bigint) as pos, p_partkey as cas_cell_index, p_type, p_brand from (values {_values}) v(pos, id) join part on p_partkey = id order by pos")(_lookup)


# Vectors and search

K_NEAREST, EVERY = 10, 50


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries and index."""
    e = R.table(spark, d, "embeddings")
    return e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding"), e.withColumnRenamed("vec_id", "neighbor_id")


def neighbours(spark: SparkSession, d: str, metric: str = "cosine", k: int = K_NEAREST) -> DataFrame:
    q, e = vectors(spark, d)
    return N.exact_neighbours(q, e, k, metric, query_id="query_id", index_id="neighbor_id")


DISTANCES = {
    "cosine": "round(abs(1 - list_dot_product(v, qv) / (greatest(sqrt(list_dot_product(v, v)), 1e-12) * greatest(sqrt(list_dot_product(qv, qv)), 1e-12))), 9)",
    "l2": "round(list_distance(v, qv), 9)",
    "dot_product": "round(-list_dot_product(v, qv), 9) + 0.0",
}


def knn_sql(metric: str, k: int = K_NEAREST) -> str:
    return f"""
e as (select vec_id, label, embedding::double[] as v from embeddings),
q as (select vec_id as query_id, v as qv from e where vec_id % {EVERY} = 0),
{metric}_d as (select query_id, vec_id as neighbor_id, label, {DISTANCES[metric]} as distance from q cross join e),
{metric}_r as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from {metric}_d),
{metric}_k as (select query_id, rank, neighbor_id, label, distance from {metric}_r where rank <= {k})"""


for _m in V.METRICS:
    _short = {"dot_product": "dot"}.get(_m, _m)
    query(f"knn_exact_{_short}", f"with {knn_sql(_m)} select query_id, rank, neighbor_id, distance from {_m}_k")(lambda spark, d, m=_m: neighbours(spark, d, m))

@query("knn_shifted_l2", f"with {knn_sql('l2')} select query_id, rank, neighbor_id, round(distance, 6) as distance from l2_k".replace("embedding::double[] as v", "list_transform(embedding, lambda x: x::double / 64 + 4096) as v"))
def knn_shifted_l2(spark: SparkSession, d: str) -> DataFrame:
    """Vectors moved by a common offset and shrunk: a product of matrices alone gets their distances wrong."""
    move = lambda df: df.withColumn("embedding", F.transform(V.doubles("embedding"), lambda x: x / 64 + 4096))
    q, e = (move(df) for df in vectors(spark, d))
    return N.exact_neighbours(q, e, K_NEAREST, "l2", query_id="query_id", index_id="neighbor_id").withColumn("distance", F.round("distance", 6))


query("knn_unique_neighbor_ids", f"with {knn_sql('cosine')} select distinct neighbor_id from cosine_k")(lambda spark, d: N.unique_ids(neighbours(spark, d), index_id="neighbor_id"))
_l2 = "l2_d" + knn_sql("l2").split(",\nl2_d", 1)[1]
query("match_concat", f"with {knn_sql('cosine')},\n{_l2} select query_id, rank, neighbor_id, distance from cosine_k union all select query_id, rank, neighbor_id, distance from l2_k")(lambda spark, d: N.concatenated(neighbours(spark, d), neighbours(spark, d, "l2")))


@query("nn_search_nested", f"with {knn_sql('cosine')} select query_id, string_agg(cast(neighbor_id as varchar), ',' order by rank) as neighbors, count(*) as n from cosine_k group by query_id")
def nn_search_nested(spark: SparkSession, d: str) -> DataFrame:
    q, e = vectors(spark, d)
    settings = N.IndexSettings("memory", 64, K_NEAREST, "vamana", "cosine", l_search=16)
    found = N.checked_response(q, N.search(q, e, settings, query_id="query_id", index_id="neighbor_id"), query_id="query_id")
    rows = N.nested(found, query_id="query_id", index_id="neighbor_id")
    return rows.select("query_id", F.array_join(F.transform("neighbors", lambda x: x["neighbor_id"].cast("string")), ",").alias("neighbors"), F.size("neighbors").cast("long").alias("n"))


def graph_search(spark: SparkSession, d: str, metric: str, l_search: int) -> DataFrame:
    q, e = vectors(spark, d)
    graphs = staged(G.build_graphs(e, metric, id_col="neighbor_id"), "graphs")
    settings = N.IndexSettings("memory", 64, K_NEAREST, "VAMANA", metric, l_search=l_search)
    found = staged(N.search(q, e, settings, graphs=graphs, query_id="query_id", index_id="neighbor_id"), "found")
    return N.exact_neighbours(q, e, K_NEAREST, metric, query_id="query_id", index_id="neighbor_id", dimension=64, found=found)


# Beams miss some on larger tables; an exact check within what they found follows. Tests measure the recall of the beams alone.
for _name, _m, _beam in (("knn_graph_l2", "l2", 64), ("knn_graph_cosine", "cosine", 64)):
    query(_name, f"with {knn_sql(_m)} select query_id, rank, neighbor_id, distance from {_m}_k")(lambda spark, d, m=_m, beam=_beam: graph_search(spark, d, m, beam))


CENTROIDS_SQL = """
e as (select vec_id, label, embedding::double[] as v from embeddings),
p as (select label, unnest(v) as x, generate_subscripts(v, 1) as pos from e),
m as (select label, pos, avg(x) as m from p group by label, pos),
c as (select label, list(m order by pos) as qv from m group by label)"""
IVF_SQL = """with {c},
q as (select vec_id as query_id, v as v from e where vec_id % 50 = 0),
pr as (select query_id, label, row_number() over (partition by query_id order by round(list_distance(v, qv), 9), label) as n from q cross join c),
d as (select query_id, e.vec_id as neighbor_id, round(list_distance(e.v, q.v), 9) as distance from pr join q using (query_id) join e on e.label = pr.label where n <= {nprobe}),
r as (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from d)
select query_id, rank, neighbor_id, distance from r where rank <= 5"""


def ivf(spark: SparkSession, d: str, nprobe: int) -> DataFrame:
    q, e = vectors(spark, d)
    centroids = I.mean_centroids(e, F.col("label"))
    settings = N.IndexSettings("memory", 64, 5, "IVF_FLAT", "l2", nprobe=nprobe)
    return N.search(q, e.withColumn("partition_id", F.col("label")), settings, centroids, query_id="query_id", index_id="neighbor_id")


query("knn_ivf_l2", IVF_SQL.format(c=CENTROIDS_SQL, nprobe=3))(lambda spark, d: ivf(spark, d, 3))
query("knn_ivf_all_probes_equals_flat", f"with {knn_sql('l2', 5)} select query_id, rank, neighbor_id, distance from l2_k")(lambda spark, d: ivf(spark, d, 10))

ASSIGN_SQL = f"with {CENTROIDS_SQL}, a as (select vec_id, label, row_number() over (partition by vec_id order by round(list_distance(v, qv), 9), c_label) as n, c_label from e cross join (select label as c_label, qv from c)) "


@query("ivf_partition_assign", ASSIGN_SQL + "select vec_id, c_label as partition_id from a where n = 1")
def ivf_partition_assign(spark: SparkSession, d: str) -> DataFrame:
    e = R.table(spark, d, "embeddings")
    return I.assigned(e.select("vec_id", "embedding"), I.mean_centroids(e, F.col("label"))).select("vec_id", "partition_id")


TWO_LEVEL_SQL = """with e as (select vec_id, label, vec_id % 4 as part, embedding::double[] as v from embeddings),
p as (select vec_id, label, part, unnest(v) as x, generate_subscripts(v, 1) as pos from e),
cm as (select label, pos, avg(x) as m from p group by label, pos), c as (select label, list(m order by pos) as qv from cm group by label),
lm as (select label, part, pos, avg(x) as m from p group by label, part, pos), l as (select label, label * 4 + part as leaf, list(m order by pos) as qv from lm group by label, part),
a as (select vec_id, v, c.label, row_number() over (partition by vec_id order by round(list_distance(v, qv), 9), c.label) as n from e cross join c),
b as (select vec_id, leaf, row_number() over (partition by vec_id order by round(list_distance(v, qv), 9), leaf) as n from a join l on l.label = a.label where n = 1)
select vec_id, cast(leaf as int) as partition_id from b where n = 1"""


def two_levels(e: DataFrame) -> DataFrame:
    """A tree of cells by label, each with four partitions."""
    cells = I.mean_centroids(e, F.col("label")).select(F.col("partition_id").alias("cell"), F.lit(None).cast("int").alias("partition_id"), "centroid")
    leaves = I.mean_centroids(e, F.col("label") * 4 + F.col("vec_id") % 4).select(F.floor(F.col("partition_id") / 4).cast("int").alias("cell"), "partition_id", "centroid")
    return Y.tree_of(cells.unionByName(leaves))


@query("two_level_assign", TWO_LEVEL_SQL)
def two_level_assign(spark: SparkSession, d: str) -> DataFrame:
    e = R.table(spark, d, "embeddings")
    return Y.assigned_by_tree(e.select("vec_id", "embedding"), staged(two_levels(e), "tree")).select("vec_id", "partition_id")


# Training, assignment, files and two searches of one served index, all of whose partitions are probed: nothing is missed.
@query("knn_served_all_probes", f"with {knn_sql('l2')} select query_id, rank, neighbor_id, distance from l2_k")
def knn_served_all_probes(spark: SparkSession, d: str) -> DataFrame:
    q, e = vectors(spark, d)
    index = Y.create_served(e, new_path(spark, "served"), 100, id_col="neighbor_id")
    even, odd = (index.search(q.filter(F.col("query_id") % (2 * EVERY) == r), K_NEAREST, index.leaves, breadth=index.leaves, query_id="query_id", index_id="neighbor_id") for r in (0, EVERY))
    return even.unionByName(odd)


query("ivf_partition_sizes", ASSIGN_SQL + "select c_label as partition_id, count(*) as n from a where n = 1 group by 1")(lambda spark, d: ivf_partition_assign(spark, d).groupBy("partition_id").agg(F.count(F.lit(1)).alias("n")))
table_query("partition_count_chooser", "orders", "with t as (select o_orderkey, cast(greatest(4096, least(65536, (o_orderkey * 7919) // 1000)) as double) as t from orders), p as (select *, pow(2.0::double, ceil(log2(t))) as a from t) select o_orderkey, cast(case when a - t <= t - a / 2 then a else a / 2 end as bigint) as partitions from p", lambda df: df.select("o_orderkey", S.partition_count(F.col("o_orderkey") * 7919).alias("partitions")))
table_query("l2_normalize", "embeddings", "with e as (select vec_id, embedding::double[] as v from embeddings), n as (select vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) as u from e) select vec_id, round(u[1], 6) as first, round(u[64], 6) as last, round(sqrt(list_dot_product(u, u)), 6) as norm from n", lambda df: I.prepared(df, True).select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"), F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm")))


# Consensus

NEAR_TYPES = f"with {knn_sql('cosine')}, t as (select query_id, rank, distance, p_type as cell_type from cosine_k join part on p_partkey = neighbor_id) "


@query(
    "consensus_summary_stats",
    NEAR_TYPES
    + """, g as (select query_id, cell_type, count(*) as cell_count, round(min(distance), 6) as min_distance, round(quantile_cont(distance, 0.25), 6) as p25_distance, round(median(distance), 6) as median_distance,
  round(quantile_cont(distance, 0.75), 6) as p75_distance, round(max(distance), 6) as max_distance, min(rank) as first_rank from t group by query_id, cell_type)
select query_id, row_number() over (partition by query_id order by cell_count desc, first_rank) as position, cell_type, cell_count, min_distance, p25_distance, median_distance, p75_distance, max_distance from g""",
)
def consensus_summary_stats(spark: SparkSession, d: str) -> DataFrame:
    meta = R.table(spark, d, "part").select(F.col("p_partkey").alias("neighbor_id"), F.col("p_type").alias("cell_type"))
    near = L.with_metadata(neighbours(spark, d), meta, ["cell_type"], id_col="neighbor_id")
    return _rounded_stats(K.summarize("summary_statistics", near, query_id="query_id"))


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.select("query_id", "position", "cell_type", "cell_count", *(F.round(c, 6).alias(c) for c in ("min_distance", "p25_distance", "median_distance", "p75_distance", "max_distance")))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: nearest neighbours and their statistics, with labels as types."""
    near = neighbours(spark, d).join(R.table(spark, d, "embeddings").select(F.col("vec_id").alias("neighbor_id"), F.col("label").cast("string").alias("cell_type")), "neighbor_id")
    return _rounded_stats(K.summarize("summary_statistics", near, query_id="query_id"))


def tree(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Terms and edges of the labels' tree."""
    terms = spark.range(8).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("T:"), "id").alias("term"), F.concat(F.lit("label "), "id").alias("name"))
    edges = spark.range(1, 8).select(F.concat(F.lit("T:"), F.floor((F.col("id") - 1) / 2)).alias("parent"), F.concat(F.lit("T:"), "id").alias("child"))
    return terms, edges


def near_terms(spark: SparkSession, d: str) -> DataFrame:
    labels = R.table(spark, d, "embeddings").select(F.col("vec_id").alias("neighbor_id"), F.concat(F.lit("T:"), "label").alias("term_id"))
    return L.with_metadata(neighbours(spark, d), labels, ["term_id"], id_col="neighbor_id")


TREE_SQL = """t as (select range::int as node, case when range > 0 then cast(floor((range - 1) / 2.0) as int) end as par from range(8)),
cl(node, anc) as (select node, node from t union all select cl.node, t.par from cl join t on cl.anc = t.node where t.par is not null)"""
WEIGHTS_SQL = "w as (select *, exp(-{p} * distance / nullif(median(distance) over (partition by query_id), 0)) as weight from cosine_k)"


def scores_sql(prefactor: float, threshold: float) -> str:
    base = f"with recursive {TREE_SQL}, {knn_sql('cosine')}, {WEIGHTS_SQL.format(p=prefactor)}, tw as (select query_id, sum(weight) as tw from w group by query_id), s as (select query_id, anc, sum(weight) as s from w join cl on label = node group by query_id, anc)"
    if threshold > 0:
        return base + f" select query_id, cast(anc as bigint) as position, 'T:' || anc as term, 'label ' || anc as cell_type, round(s / tw, 6) as score from s join tw using (query_id) where s / tw >= {threshold}"
    return base + " select tw.query_id, cast(node as bigint) as position, 'T:' || node as term, 'label ' || node as cell_type, round(coalesce(s.s, 0) / tw, 6) as score from tw cross join t left join s on s.query_id = tw.query_id and s.anc = t.node"


def scores(spark: SparkSession, d: str, prefactor: float, threshold: float) -> DataFrame:
    terms, edges = tree(spark)
    got = K.summarize("ontology_aware", near_terms(spark, d), terms=terms, pairs=O.closure(edges), query_id="query_id", term_col="term_id", prefactor=prefactor, prune_threshold=threshold)
    return got.select("query_id", "position", F.col("cell_type_ontology_term_id").alias("term"), "cell_type", F.round("score", 6).alias("score"))


for _name, _p, _t in (("consensus_ontology_scores", 1.0, 0.0), ("consensus_ontology_scores_pruned", 1.0, 0.1), ("consensus_ontology_scores_prefactor2", 2.0, 0.0)):
    query(_name, scores_sql(_p, _t))(lambda spark, d, p=_p, t=_t: scores(spark, d, p, t))


@query("consensus_totals", f"with {knn_sql('cosine')}, {WEIGHTS_SQL.format(p=1.0)} select query_id, round(sum(weight), 6) as total_weight, count(*) as total_neighbors, cast(sum(case when label > 7 then 1 else 0 end) as bigint) as total_neighbors_unrecognized from w group by query_id")
def consensus_totals(spark: SparkSession, d: str) -> DataFrame:
    terms, _ = tree(spark)
    got = K.totals(K.weighted(near_terms(spark, d), terms, query_id="query_id", term_col="term_id"), query_id="query_id")
    return got.withColumn("total_weight", F.round("total_weight", 6))


# Ontology

def customer_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Terms and edges over all customers: the parent of k is k // 8, of every third k // 64 too; where k % 50 = 7 there is none, so that what lies below is out of the root's reach."""
    c = R.table(spark, d, "customer").filter("c_custkey is not null")
    name = lambda x: F.concat(F.lit("T:"), F.floor(x).cast("string"))
    linked = c.filter("c_custkey > 0 and c_custkey % 50 <> 7")
    own = linked.select(name(F.col("c_custkey") / 8).alias("parent"), name(F.col("c_custkey")).alias("child"))
    short = linked.filter("c_custkey >= 64 and c_custkey % 3 = 0").select(name(F.col("c_custkey") / 64).alias("parent"), name(F.col("c_custkey")).alias("child"))
    return c.select(name(F.col("c_custkey")).alias("term"), F.col("c_name").alias("name")), staged(own.unionByName(short), "edges")


GRAPH_SQL = """with recursive k as (select c_custkey as k, c_name as name from customer where c_custkey is not null),
g(parent, child) as (select 'T:' || k // 8, 'T:' || k from k where k > 0 and k % 50 <> 7 union all select 'T:' || k // 64, 'T:' || k from k where k >= 64 and k % 3 = 0 and k % 50 <> 7),
cl(term, ancestor) as (select child, parent from g union select cl.term, g.parent from cl join g on g.child = cl.ancestor),
w(term, n) as (select 'T:0', 0 union select g.child, n + 1 from w join g on g.parent = w.term)
"""


@query("ontology_ancestors", GRAPH_SQL + "select 'T:' || k as term, coalesce(string_agg(ancestor, ',' order by ancestor), '') as ancestors from k left join cl on cl.term = 'T:' || k group by k")
def ontology_ancestors(spark: SparkSession, d: str) -> DataFrame:
    terms, edges = customer_graph(spark, d)
    return O.ancestors(terms, O.closure(edges)).select("term", F.array_join("ancestors", ",").alias("ancestors"))


@query("ontology_children", GRAPH_SQL + "select 'T:' || k as term, coalesce(string_agg(distinct child, ',' order by child), '') as children from k left join g on parent = 'T:' || k group by k")
def ontology_children(spark: SparkSession, d: str) -> DataFrame:
    terms, edges = customer_graph(spark, d)
    return O.children(terms, edges).select("term", F.array_join("children", ",").alias("children"))


query("ontology_shortest_path", GRAPH_SQL + "select term, cast(min(n) as integer) as length from w group by term")(lambda spark, d: O.shortest_paths(customer_graph(spark, d)[1], "T:0"))
query("ontology_longest_path", GRAPH_SQL + "select term, cast(max(n) as integer) as length from w group by term")(lambda spark, d: O.longest_paths(customer_graph(spark, d)[1], "T:0"))


@query("ontology_unreachable", GRAPH_SQL + "select 'T:' || k as term from k where 'T:' || k not in (select term from w)")
def ontology_unreachable(spark: SparkSession, d: str) -> DataFrame:
    terms, edges = customer_graph(spark, d)
    return terms.select("term").join(O.shortest_paths(edges, "T:0"), "term", "left_anti")


query("ontology_topological_depth", GRAPH_SQL.split("cl(term")[0] + "w(term, n) as (select distinct parent, 0 from g where parent not in (select child from g) union select g.child, n + 1 from w join g on g.parent = w.term) select term, cast(max(n) as integer) as depth from w group by term")(lambda spark, d: O.topological(customer_graph(spark, d)[1]))


def customer_chains(spark: SparkSession, d: str, length: int) -> DataFrame:
    """Edges from each customer to the next, in chains of `length`."""
    return R.table(spark, d, "customer").filter(F.col("c_custkey") % length > 0).select((F.col("c_custkey") - 1).alias("parent"), F.col("c_custkey").alias("child"))


query("ontology_closure_of_chains", "select a.c_custkey as term, b.c_custkey as ancestor from customer a join customer b on b.c_custkey < a.c_custkey and b.c_custkey // 300 = a.c_custkey // 300")(lambda spark, d: O.closure(customer_chains(spark, d, 300)))
query("ontology_depth_of_a_chain", "select c_custkey as term, cast(c_custkey as integer) as depth from customer")(lambda spark, d: O.topological(customer_chains(spark, d, 1 << 62)))


def customer_tree(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a tree over all customers: the parent of k is k // 8."""
    return R.table(spark, d, "customer").filter("c_custkey >= 8").select(F.floor(F.col("c_custkey") / 8).alias("parent"), F.col("c_custkey").alias("child"))


CUSTOMER_SQL = "with recursive g as (select c_custkey // 8 as parent, c_custkey as child from customer where c_custkey >= 8)"
query("ontology_closure_of_customers", CUSTOMER_SQL + ", cl(term, ancestor) as (select child, parent from g union all select cl.term, g.parent from cl join g on g.child = cl.ancestor) select term, ancestor from cl")(lambda spark, d: O.closure(customer_tree(spark, d)))


@query("ontology_edges_of_known_classes", "with k as (select c_custkey as term from customer where c_custkey % 5 <> 0), g as (select c_custkey // 8 as parent, c_custkey as child from customer where c_custkey >= 8) select parent, child from g where parent in (select term from k) and child in (select term from k)")
def ontology_edges_of_known_classes(spark: SparkSession, d: str) -> DataFrame:
    edges = customer_tree(spark, d)
    known = R.table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("term"))
    return O.edges_of(known, edges.filter("child % 2 = 0"), edges)


@query("ontology_classes_first_label", "select 'CL:' || k as term, arg_min(c_name, c_custkey) as label from (select c_custkey % 50 as k, c_custkey, c_name from customer where c_custkey % 3 = 0) group by k")
def ontology_classes_first_label(spark: SparkSession, d: str) -> DataFrame:
    """Of classes named CL_ with one label, the first of each id."""
    labels = F.when(F.col("c_custkey") % 3 == 0, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment"))
    return R.ontology_classes(R.table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("CL_"), (F.col("c_custkey") % 50).cast("string")).alias("name"), labels.alias("labels")))


@query("densified_matrix", "with c as (select l_orderkey as id, l_linenumber as i, max(l_quantity) as q from lineitem group by 1, 2) select id as query_cell_id, " + ", ".join(f"coalesce(max(q) filter (where i = {i}), 0)::float::double as x{i}" for i in range(8)) + " from c group by id")
def densified_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_cell_id"), F.col("l_linenumber").cast("int").alias("feature_index")).agg(F.max("l_quantity").cast("float").alias("value"))
    return R.densified(cells, 8).select("query_cell_id", *(F.col("x")[i].cast("double").alias(f"x{i}") for i in range(8)))


def order_matrix(spark: SparkSession, d: str, layout: str) -> str:
    """Orders as rows and line numbers as features of a sparse matrix in the shared folder."""
    path = new_path(spark, "matrix")
    cells = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_cell_id"), F.col("l_linenumber").cast("int").alias("i")).agg(F.max("l_quantity").cast("float").alias("q"))
    rows = cells.groupBy("query_cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("held"), F.sum("q").cast("float").alias("total_mrna_umis"))
    X.write_matrix(rows.select("query_cell_id", "total_mrna_umis", F.col("held.i").alias("feature_indices"), F.col("held.q").alias("feature_values")), path, layout=layout, width=8, rowsPerPart=4000)
    return path


for _name, _layout in (("sparse_matrix_rows", "csr"), ("sparse_matrix_columns", "csc")):

    @query(_name, "with c as (select l_orderkey as id, l_linenumber as i, max(l_quantity) as q from lineitem group by 1, 2) select id as query_cell_id, sum(q)::float::double as total, " + ", ".join(f"coalesce(max(q) filter (where i = {i}), 0)::float::double as x{i}" for i in range(8)) + " from c group by id")
    def sparse_matrix(spark: SparkSession, d: str, layout: str = _layout) -> DataFrame:
        """Read again as dense rows, in ranges of a part."""
        rows = R.checked_matrix(X.read_matrix(spark, order_matrix(spark, d, layout), ["query_cell_id", "total_mrna_umis", "x"], rowsPerPartition=1500))
        return rows.select("query_cell_id", F.col("total_mrna_umis").cast("double").alias("total"), *(F.col("x")[i].cast("double").alias(f"x{i}") for i in range(8)))


@query("activity_log_appended", f"with a as (select user_id, event_id from events where user_id is not null) select user_id, cast(count(*) as bigint) as started, cast(sum(case when event_id % 3 = 0 then 1 else 0 end) as bigint) as failed from a group by user_id")
def activity_log_appended(spark: SparkSession, d: str) -> DataFrame:
    """Two writes to a log, read again."""
    path = new_path(spark, "log")
    requests = R.table(spark, d, "events").filter("user_id is not null").select("user_id", "event_id", F.concat(F.lit("ab/"), F.hex("event_id")).alias("trace_header"), F.lit("m").alias("model_name"), F.lit("x").alias("method"), F.lit(1).cast("bigint").alias("cell_count"))
    W.append(A.activity_rows(requests, "STARTED", at(NOW)), path)
    W.append(A.activity_rows(requests.filter("event_id % 3 = 0"), "FAILED", at(NOW)), path)
    count = lambda e: F.count_if(F.col("event") == e).cast("long")
    return A.read_log(spark, path).groupBy("user_id").agg(count("STARTED").alias("started"), count("FAILED").alias("failed"))


@query(
    "ontology_resource_json_roundtrip",
    GRAPH_SQL
    + """, a as (select term, string_agg(ancestor, ',' order by ancestor) as x from cl group by term), c as (select parent, string_agg(distinct child, ',' order by child) as x from g group by parent),
l as (select term, cast(min(n) as integer) as least, cast(max(n) as integer) as most from w group by term)
select 'T:' || k as term, name, coalesce(a.x, '') as ancestors, coalesce(c.x, '') as children, least as shortest, most as longest from k left join a on a.term = 'T:' || k left join c on parent = 'T:' || k left join l on l.term = 'T:' || k""",
)
def ontology_resource_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    terms, edges = customer_graph(spark, d)
    path = new_path(spark, "ontology")
    W.write_document(O.resource(terms, edges, "T:0"), path)
    doc = R.ontology_resource(spark, path)
    names = R.resource_terms(doc).select("term", "name")
    ancestors = R.resource_closure(doc).groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("ancestor")), ",").alias("ancestors"))
    served = O.served(doc)
    held = lambda c, value, kind: served.select(F.explode(c).alias("term", value)).withColumn(value, kind(F.col(value)))
    same, joined = (lambda c: c), (lambda c: F.array_join(c, ","))
    parts = [held("children_dictionary", "children", joined), held("shortest_path_lengths_from_cell_root", "shortest", same), held("longest_path_lengths_from_cell_root", "longest", same)]
    out = served.select(F.explode("cl_names").alias("term")).join(names, "term").join(ancestors, "term", "left").withColumn("ancestors", F.coalesce("ancestors", F.lit("")))
    for p in parts:
        out = out.join(p, "term", "left")
    return out


# Activity and quotas

NOW = "2024-01-30 12:00:00"
ACTIVITY_SQL = """a as (select user_id, props->>'$.k' as request_id, value as cell_count, ts as finished_time, case event_type when 'error' then 'FAILED' when 'purchase' then 'SUCCEEDED' else 'STARTED' end as event from events),
u as (select user_id, min(ts) as created_at, user_id % 7 as cells_processed, user_id % 3 as requests_processed, 2000 as cell_quota, case when user_id % 3 > 0 then 2500 end as lifetime_cell_quota, user_id % 4 = 0 as quota_increased from events where user_id is not null group by user_id)"""
USAGE_SQL = ACTIVITY_SQL + """,
ws as (select user_id, {start} as week_start from u),
rq as (select a.user_id, request_id, max(cell_count) as cells, bool_or(event = 'FAILED') as failed from a join ws on ws.user_id = a.user_id and finished_time >= week_start where request_id is not null group by all),
us as (select u.user_id, coalesce(sum(cells), 0) as used from u left join (select * from rq where not failed) rq on rq.user_id = u.user_id group by u.user_id),
lf as (select u.user_id, any_value(cells_processed) + coalesce(sum(cell_count), 0) as total_cells, any_value(requests_processed) + count(a.user_id) as total_requests from u left join (select * from a where event = 'SUCCEEDED') a on a.user_id = u.user_id group by u.user_id)"""
FIXED_START = "timestamp '2024-01-22 00:00:00'"
ANCHORED = f"cast(cast(timestamp '{NOW}' as date) - cast(((isodow(timestamp '{NOW}') - isodow(created_at)) + 7) % 7 as integer) as timestamp)"


def log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Activity and users."""
    e = R.table(spark, d, "events")
    event = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCEEDED").otherwise("STARTED")
    rows = e.select("user_id", F.get_json_object("props", "$.k").alias("request_id"), F.col("value").alias("cell_count"), F.col("ts").alias("finished_time"), event.alias("event"))
    users = e.filter("user_id is not null").groupBy("user_id").agg(F.min("ts").alias("created_at")).withColumns({
        "cells_processed": F.col("user_id") % 7, "requests_processed": F.col("user_id") % 3, "cell_quota": F.lit(2000), "lifetime_cell_quota": F.when(F.col("user_id") % 3 > 0, F.lit(2500)), "quota_increased": F.col("user_id") % 4 == 0,
    })
    return rows, users


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


query("weekly_usage_all_users", f"with {USAGE_SQL.format(start=FIXED_START)} select user_id, round(used, 6) as used from us")(lambda spark, d: A.weekly_usage(*log(spark, d), at("2024-01-22 00:00:00")).withColumn("used", F.round("used", 6)))
query("weekly_usage_anchored", f"with {USAGE_SQL.format(start=ANCHORED)} select user_id, round(used, 6) as used from us")(lambda spark, d: A.weekly_usage(*log(spark, d), A.week_start(at(NOW))).withColumn("used", F.round("used", 6)))
query("lifetime_cells", f"with {USAGE_SQL.format(start=ANCHORED)} select user_id, round(total_cells, 6) as total_cells from lf")(lambda spark, d: A.lifetime(*log(spark, d)).select("user_id", F.round("total_cells", 6).alias("total_cells")))
query("lifetime_requests", f"with {USAGE_SQL.format(start=ANCHORED)} select user_id, total_requests from lf")(lambda spark, d: A.lifetime(*log(spark, d)).select("user_id", "total_requests"))
REMAINING = "greatest(least(2000 - used, coalesce(lifetime_cell_quota - total_cells, 2000 - used)), 0)"


def report(spark: SparkSession, d: str) -> DataFrame:
    return A.quota_report(*log(spark, d), at(NOW))


query("remaining_quota", f"with {USAGE_SQL.format(start=ANCHORED)} select user_id, cast(round({REMAINING}, 6) as double) as remaining, cast(round(lifetime_cell_quota - total_cells, 6) as double) as remaining_lifetime from u join us using (user_id) join lf using (user_id)")(lambda spark, d: report(spark, d).select("user_id", F.round("remaining_weekly_quota", 6).alias("remaining"), F.round("remaining_lifetime_quota", 6).alias("remaining_lifetime")))


@query("quota_admission", f"with {USAGE_SQL.format(start=ANCHORED)} select user_id, user_id * 20 as cell_count, user_id * 20 <= {REMAINING} as admitted from u join us using (user_id) join lf using (user_id)")
def quota_admission(spark: SparkSession, d: str) -> DataFrame:
    left = report(spark, d).select("user_id", F.col("remaining_weekly_quota").alias("remaining"))
    asked = log(spark, d)[1].select("user_id", (F.col("user_id") * 20).alias("cell_count"))
    return A.admitted(asked, left).select("user_id", "cell_count", "admitted")


IN_ORDER_SQL = f"""with recursive {USAGE_SQL.format(start=ANCHORED)},
lf2 as (select user_id, round({REMAINING}, 6)::double as remaining from u join us using (user_id) join lf using (user_id)),
rq2 as materialized (select user_id, event_id, value as cells, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null),
fold(user_id, n, event_id, admitted, rest) as (
  select user_id, 0::bigint, null::bigint, false, remaining from lf2
  union all select f.user_id, r.n, r.event_id, coalesce(r.cells >= 0 and r.cells <= f.rest, false), case when r.cells >= 0 and r.cells <= f.rest then f.rest - r.cells else f.rest end
  from fold f join rq2 r on r.user_id = f.user_id and r.n = f.n + 1)
select event_id, user_id, admitted from fold where n > 0"""


@query("quota_admission_in_order", IN_ORDER_SQL)
def quota_admission_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests, in order of time: each against what those admitted before it have left."""
    left = report(spark, d).select("user_id", F.round("remaining_weekly_quota", 6).alias("remaining"))
    asked = R.table(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("cell_count"))
    return A.admitted_in_order(asked, left, order=["ts", "event_id"]).select("event_id", "user_id", "admitted")


LIFECYCLE_SQL = """with a as (
  select user_id || '-' || (props->>'$.k') as request_id, value as cell_count, ts, case event_type when 'error' then 'FAILED' when 'purchase' then 'SUCCEEDED' else 'STARTED' end as event from events),
b as (
  select request_id, min(ts) filter (event = 'STARTED') as start, min(ts) filter (event <> 'STARTED') as stop, bool_or(event = 'FAILED') as failed, bool_or(event = 'SUCCEEDED') as succeeded, max(cell_count) as cell_count, count(*) as n_rows
  from a where request_id is not null group by request_id),
n as (select max(ts) as now from a where request_id is not null)
select request_id, case when failed or coalesce(coalesce(stop, now) > start + interval 6 hour, false) then 'FAILED' when succeeded then 'SUCCEEDED' else 'STARTED' end as status, cell_count, n_rows from b, n"""


def request_log(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)[0]
    return rows.filter("user_id is not null and request_id is not null").select(F.concat_ws("-", "user_id", "request_id").alias("request_id"), "event", "cell_count", "finished_time")


@query("request_lifecycle_stream", LIFECYCLE_SQL)
def request_lifecycle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log in four files in order of time, through the stream; a request without an end has failed after six hours."""
    at = new_path(spark, "lifecycle")
    rows = request_log(spark, d)
    edges = rows.select(F.percentile_approx(F.unix_micros(F.col("finished_time").cast("timestamp")), [0.25, 0.5, 0.75, 1.0]).alias("e")).first().e
    quarter = F.size(F.filter(F.lit(edges[:3]), lambda x: x < F.unix_micros(F.col("finished_time").cast("timestamp"))))
    for k in range(4):
        rows.filter(quarter == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    lifecycle_stream(spark, f"{at}/in", rows.schema, f"{at}/out", f"{at}/state", timeout=datetime.timedelta(hours=6), keep=datetime.timedelta(days=3650), chunk=1).awaitTermination()
    return statuses(spark, f"{at}/out")


query("request_status_with_timeout", LIFECYCLE_SQL)(lambda spark, d: A.request_status_with_timeout(request_log(spark, d), F.expr("interval 6 hours"), F.lit(request_log(spark, d).agg(F.max("finished_time")).first()[0])))
query("quota_reset_date", f"with {ACTIVITY_SQL}, x as (select user_id, isodow(timestamp '{NOW}') - isodow(created_at) as n from u) select user_id, cast(cast(timestamp '{NOW}' as date) + cast(case when n <= 0 then n + 7 else n end as integer) as timestamp) as quota_reset_date from x")(lambda spark, d: report(spark, d).select("user_id", "quota_reset_date"))
query("request_lifecycle_status", f"with {ACTIVITY_SQL} select request_id, case when bool_or(event = 'FAILED') then 'FAILED' when bool_or(event = 'SUCCEEDED') then 'SUCCEEDED' else 'STARTED' end as status, max(cell_count) as cell_count, count(*) as n_rows from a where request_id is not null group by request_id")(lambda spark, d: A.request_status(log(spark, d)[0]))


@query("increase_quota_once", f"with {ACTIVITY_SQL} select user_id, case when user_id % 2 = 0 and not quota_increased then 200000 else coalesce(lifetime_cell_quota, -1) end as lifetime_cell_quota, quota_increased or user_id % 2 = 0 as quota_increased from u")
def increase_quota_once(spark: SparkSession, d: str) -> DataFrame:
    once = A.increased_once(log(spark, d)[1], F.col("user_id") % 2 == 0)
    return A.increased_once(once, F.col("user_id") % 2 == 0).select("user_id", F.coalesce("lifetime_cell_quota", F.lit(-1)).alias("lifetime_cell_quota"), "quota_increased")


# Catalog

@query("catalog_left_join_chain", "select s_suppkey as id, s_name as model_name, n_name as metadata_name, r_name as region from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def catalog_left_join_chain(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (R.table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model_name"), F.col("n_name").alias("metadata_name"), F.col("r_name").alias("region"))


@query("catalog_with_relations", "with c as (select s_suppkey % 5 as k, count(*) as n, arg_min(s_name, s_suppkey) as x from supplier group by 1) select n_nationkey as id, r_name as metadata_name, coalesce(c.n, 0) as n_columns, c.x as first_column, case when n_nationkey % 2 = 0 then 'index ' || n_nationkey end as index_name from nation left join region on n_regionkey = r_regionkey left join c on c.k = n_regionkey")
def catalog_with_relations(spark: SparkSession, d: str) -> DataFrame:
    n, r, s = (R.table(spark, d, t) for t in ("nation", "region", "supplier"))
    models = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("model_name"), F.col("n_regionkey").alias("cell_info_metadata_id"))
    columns = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).cast("int").alias("cell_info_metadata_id"), F.col("s_name").alias("column_name"))
    indexes = models.filter("id % 2 = 0").select(F.col("id").alias("model_id"), F.concat(F.lit("index "), "id").alias("index_name"))
    got = C.with_relations(models, r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), columns, indexes)
    return got.select("id", F.col("cell_info_metadata.name").alias("metadata_name"), F.coalesce(F.size("ontological_columns"), F.lit(0)).cast("long").alias("n_columns"), F.get("ontological_columns", F.lit(0))["column_name"].alias("first_column"), F.col("vector_index.index_name").alias("index_name"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model_name"), (F.col("s_acctbal") < 0).alias("admin_use_only"), F.lit(True).alias("is_default_model"))


query("catalog_non_admin", "select s_suppkey as id, s_name as model_name from supplier where not s_acctbal < 0")(lambda spark, d: C.visible(suppliers(spark, d), False).select("id", "model_name"))
query("catalog_paged", "select s_suppkey as id, s_name as model_name from supplier order by 1 limit 5 offset 5")(lambda spark, d: C.page(suppliers(spark, d), "id", 1, 5).select("id", "model_name"))
query("set_default_model", "select s_suppkey as id, s_name = 'Supplier#000000003' as is_default_model from supplier")(lambda spark, d: C.with_default(suppliers(spark, d), "Supplier#000000003").select("id", "is_default_model"))


@query("cell_ingest_join_filter", "select c_custkey as cas_cell_index, c_mktsegment as cell_type, n_name as dataset_id from customer left join nation on n_nationkey = c_nationkey where n_name = 'NATION_3' and c_mktsegment in ('HOUSEHOLD', 'BUILDING')")
def cell_ingest_join_filter(spark: SparkSession, d: str) -> DataFrame:
    cells = R.table(spark, d, "customer").select(F.col("c_custkey").alias("cas_cell_index"), F.col("c_nationkey").alias("cas_ingest_id"), F.col("c_mktsegment").alias("cell_type"))
    ingests = R.table(spark, d, "nation").select(F.col("n_nationkey").alias("cas_ingest_id"), F.col("n_name").alias("dataset_id"))
    return C.browsed(C.cells_with_ingest(cells, ingests), "cells", {"dataset_id__eq": "NATION_3", "cell_type__in": ["HOUSEHOLD", "BUILDING"]}).select("cas_cell_index", "cell_type", "dataset_id")


# Index updates, files, streams

UPSERT_SQL = "select vec_id as id, case when vec_id % 3 = 0 then label + 100 else label end as value, cast(case when vec_id % 3 = 0 then 1 else 0 end as bigint) as ts from embeddings union all select vec_id + 1000000, label, 1 from embeddings where vec_id % 5 = 0"


def writes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An index (id, value, ts) and a later update of a third of it and some new ids."""
    e = R.table(spark, d, "embeddings")
    update = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 100).alias("value"), F.lit(1).cast("long").alias("ts"))
    new = e.filter("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000).alias("id"), F.col("label").alias("value"), F.lit(1).cast("long").alias("ts"))
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("value"), F.lit(0).cast("long").alias("ts")), update.unionByName(new)


query("upsert_last_write_wins", UPSERT_SQL)(lambda spark, d: I.upserted(*writes(spark, d)))


@query("streaming_upsert_final_state", UPSERT_SQL)
def streaming_upsert_final_state(spark: SparkSession, d: str) -> DataFrame:
    at, (index, update) = new_path(spark, "stream"), writes(spark, d)
    for rows in (index, update):
        rows.write.mode("append").parquet(f"{at}/in")
    upsert_stream(spark, f"{at}/in", index.schema, f"{at}/out", f"{at}/state", chunk=1).awaitTermination()
    return current(spark, f"{at}/out")


@query("index_lifecycle", "select vec_id as id, cast(round(embedding[1] * case when vec_id % 3 = 0 then -1 else 1 end, 6) as double) as first, cast(round(embedding[64] * case when vec_id % 3 = 0 then -1 else 1 end, 6) as double) as last from embeddings")
def index_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Created from the first of five batches, updated by two chunks of two, the last of which writes a third of the ids anew, and consolidated."""
    e = R.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("embedding"))
    batches = e.withColumn("batch", (F.col("id") % 4).cast("int"))
    again = e.filter("id % 3 = 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(4).alias("batch"))
    path = new_path(spark, "index")
    I.build_index(batches.unionByName(again), path, metric="L2", normalise=False, sample_size=1, partitions=8, chunk=2)
    rows, _ = I.read_index(spark, path)
    return rows.select("id", F.round(F.col("embedding")[0].cast("float"), 6).cast("double").alias("first"), F.round(F.col("embedding")[63].cast("float"), 6).cast("double").alias("last"))


table_query("training_sample_batches", "events", "with b as (select cast(cast(ts as date) as varchar) as batch, count(*) as n_rows from events group by 1), r as (select *, cast(coalesce(sum(n_rows) over (order by batch rows between unbounded preceding and 1 preceding), 0) as bigint) as rows_before from b) select * from r where rows_before < 1500", lambda df: I.training_batches(df.groupBy(F.to_date("ts").cast("string").alias("batch")).agg(F.count(F.lit(1)).alias("n_rows")), 1500))


@query("csv_gz_roundtrip", "select vec_id as id, len(embedding) as n, embedding[1]::double as first, embedding[64]::double as last from embeddings")
def csv_gz_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    at = new_path(spark, "batches")
    e = R.table(spark, d, "embeddings")
    e.select("vec_id", *(F.col("embedding")[i].alias(f"x{i}") for i in range(64))).write.option("compression", "gzip").csv(at)
    return R.embedding_batches(spark, at, 64).select("id", F.size("embedding").cast("long").alias("n"), F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"))


@query("csv_quarantine_good", "select vec_id as id, embedding[1]::double as first, embedding[64]::double as last from embeddings where vec_id % 100 not in (7, 33, 58)")
def csv_quarantine_good(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = quarantined(spark, d)
    return rows.select("id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"))


def quarantined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as files of lines in order of id, of which three in a hundred are bad: one without a number, one too short, one without an id."""
    at = new_path(spark, "lines")
    e = R.table(spark, d, "embeddings").select("vec_id", "label", V.doubles("embedding").alias("v"))
    row = lambda n: F.array_join(F.transform(F.slice("v", 1, n), lambda x: x.cast("float").cast("string")), ",")
    line = F.when(F.col("vec_id") % 100 == 7, F.concat_ws(",", "vec_id", F.lit("none"), row(63))).when(F.col("vec_id") % 100 == 33, F.concat_ws(",", "vec_id", row(60))).when(F.col("vec_id") % 100 == 58, F.concat(F.lit(","), row(64))).otherwise(F.concat_ws(",", "vec_id", row(64)))
    # In order of the column that files are dealt by: else the writer sorts by it once more, and loses the order of ids.
    lines = e.withColumn("part", F.concat(F.lit("label_"), "label")).repartitionByRange(4, "part").sortWithinPartitions("part", "vec_id")
    lines.select(line.alias("value"), "part").write.partitionBy("part").text(at)
    return R.quarantined_batches(spark, at, 64)


@query("csv_quarantine_bad", "with n as (select vec_id, label, row_number() over (partition by label order by vec_id) as line from embeddings) select 'label_' || label as part, line, case vec_id % 100 when 7 then 'not a number' when 33 then '60 components of 64' else 'no id' end as reason from n where vec_id % 100 in (7, 33, 58)")
def csv_quarantine_bad(spark: SparkSession, d: str) -> DataFrame:
    _, bad = quarantined(spark, d)
    return bad.select(F.regexp_extract("file", "part=([^/]*)", 1).alias("part"), "line", "reason")


@query("database_upsert_roundtrip", "select o_orderkey, o_custkey, o_orderstatus, round(case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end, 2) as o_totalprice, o_orderdate from orders where o_orderkey >= 100 and o_orderstatus <> 'P'")
def database_upsert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Orders into a database, a third of them again with another price, the second write once more to no effect; read in ranges with pushed filters."""
    url = f"jdbc:derby:{D.local_database()};create=true"
    o = R.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    again = o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    D.upsert_table(o, url, "orders", ["o_orderkey"], "first", bounded=["o_orderstatus"])
    for _ in range(2):
        D.upsert_table(again, url, "orders", ["o_orderkey"], "second", bounded=["o_orderstatus"])
    got = D.read_table(spark, url, "orders", "o_orderkey", rows_per_partition=4000)
    return got.filter("o_orderkey >= 100 and o_orderstatus <> 'P'").withColumn("o_totalprice", F.round("o_totalprice", 2))


# Backfills

table_query("backfill_insert_select", "supplier", "select s_name || ' metadata' as name, 'store/' || s_suppkey as soma_dataframe_uri, timestamp '2024-01-30 12:00:00' as created_date from supplier where s_acctbal >= 0", lambda df: B.metadata_from_models(df.select(F.col("s_name").alias("model_name"), F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("store/"), "s_suppkey")).alias("cell_metadata_uri")), at(NOW)))


@query("backfill_update_from", "select c_custkey, case when n_nationkey is not null then n_name else c_mktsegment end as c_mktsegment from customer left join (select * from nation where n_nationkey < 10) n on n_nationkey = c_nationkey")
def backfill_update_from(spark: SparkSession, d: str) -> DataFrame:
    nation = R.table(spark, d, "nation").filter("n_nationkey < 10").withColumnRenamed("n_nationkey", "c_nationkey")
    return B.update_from(R.table(spark, d, "customer"), nation, "c_nationkey", {"c_mktsegment": "n_name"}).select("c_custkey", "c_mktsegment")


table_query("backfill_conditional", "customer", "select c_custkey, case when c_custkey % 2 = 0 then 100000 else 70000 end as cell_quota, c_custkey % 3 = 0 as quota_increased, 'SUCCEEDED' as event from customer", lambda df: B.filled(B.marked_increased(B.raised_default_quota(df.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 50_000).otherwise(70_000).alias("cell_quota"), F.when(F.col("c_custkey") % 3 == 0, 200_000).otherwise(50_000).alias("lifetime_cell_quota"), F.lit(False).alias("quota_increased")))), {"event": F.lit("SUCCEEDED")}).drop("lifetime_cell_quota"))


# Scalars

table_query("client_version_gate", "part", "with v as (select p_partkey, (p_partkey % 3) || '.' || (p_size % 12) || case when p_partkey % 2 = 0 then '.1' else '' end as version from part) select p_partkey, version, list_transform(string_split(version || '.0', '.'), lambda x: x::int)[1:3] >= [1, 8, 0] as ok from v", lambda df: df.select("p_partkey", F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("."), (F.col("p_size") % 12).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(".1")).otherwise(F.lit(""))).alias("version")).withColumn("ok", S.version_at_least(F.col("version"))))
table_query("owl_id_rewrite", "part", "select p_partkey, regexp_replace(case p_partkey % 3 when 0 then 'CL_' || p_partkey when 1 then 'obo.CL_1_CL_' || p_partkey else 'GO_' || p_partkey end, 'CL_', 'CL:') as term from part", lambda df: df.select("p_partkey", R.ontology_id(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("CL_"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("obo.CL_1_CL_"), "p_partkey")).otherwise(F.concat(F.lit("GO_"), "p_partkey"))).alias("term")))
_HEADER = "case event_id % 4 when 0 then 'abc' || event_id || '/' || user_id when 1 then 'ff' || event_id || '/0a;o=' || event_type when 2 then 'XYZ/' || user_id else event_type end"
table_query("trace_header_parse", "events", f"with h as (select event_id, {_HEADER} as header from events) select event_id, case when regexp_matches(header, '^([a-f0-9]+)/([a-f0-9]+)(;o=(.*))?$') then regexp_extract(header, '^([a-f0-9]+)/', 1) end as trace_id, case when regexp_matches(header, '^([a-f0-9]+)/([a-f0-9]+)(;o=(.*))?$') then regexp_extract(header, '/([a-f0-9]+)', 1) end as span_id from h", lambda df: df.select("event_id", F.expr(_HEADER).alias("header")).select("event_id", S.trace_id(F.col("header")).alias("trace_id"), S.span_id(F.col("header")).alias("span_id")))


@query("embed_linear_projection", "select vec_id as query_cell_id, " + ", ".join(f"round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double * (((i * {j + 3}) % 7) - 3))), 6) as e{j}" for j in range(3)) + " from embeddings")
def embed_linear_projection(spark: SparkSession, d: str) -> DataFrame:
    weights = np.array([[(i * (j + 3)) % 7 - 3 for j in range(3)] for i in range(64)], np.float64)
    matrix = R.checked_matrix(R.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_cell_id"), F.lit(100.0).cast("float").alias("total_mrna_umis"), F.col("embedding").alias("x")))
    got = M.embed(matrix, M.linear_model(weights), 3)
    return got.select("query_cell_id", *(F.round(F.col("embedding")[j], 6).alias(f"e{j}") for j in range(3)))
