"""What a query's neighbours say together.

A strategy takes neighbours with metadata (query_cell_id, rank, distance, cell type or term) for any number of queries and gives rows
for each; everything is one plan, shuffled by query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OntologyError
from .ontology import with_self


def summary_statistics(neighbours: DataFrame, *, query_id: str = "query_cell_id", type_col: str = "cell_type") -> DataFrame:
    """Per query and type: count, min, quartiles (linear between ranks) and max of the distances. position is the order of a query's
    rows: by count, most first, ties by the first neighbour of the type."""
    stats = neighbours.groupBy(query_id, type_col).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.min("distance").alias("min_distance"),
        F.percentile("distance", 0.25).alias("p25_distance"),
        F.median("distance").alias("median_distance"),
        F.percentile("distance", 0.75).alias("p75_distance"),
        F.max("distance").alias("max_distance"),
        F.min("rank").alias("first_rank"),
    )
    order = Window.partitionBy(query_id).orderBy(F.desc("cell_count"), "first_rank")
    return stats.withColumn("position", F.row_number().over(order).cast("long")).drop("first_rank")


def weighted(neighbours: DataFrame, terms: DataFrame, *, query_id: str = "query_cell_id", term_col: str = "cell_type_ontology_term_id", prefactor: float = 1.0) -> DataFrame:
    """Neighbours with weight exp(-prefactor * distance / median distance) and whether their term is known; a median of 0 gives null weights."""
    own = Window.partitionBy(query_id)
    gamma = F.try_divide(F.lit(-float(prefactor)), F.median("distance").over(own))
    known = terms.select(F.col("term").alias("own_term"))
    return neighbours.withColumn("weight", F.exp(gamma * F.col("distance"))).join(F.broadcast(known), F.col(term_col) == F.col("own_term"), "left").withColumn("recognised", F.col("own_term").isNotNull()).drop("own_term")


def totals(weighed: DataFrame, *, query_id: str = "query_cell_id") -> DataFrame:
    """Per query: total weight, neighbours, and those whose term is unknown."""
    return weighed.groupBy(query_id).agg(
        F.sum("weight").alias("total_weight"),
        F.count(F.lit(1)).alias("total_neighbors"),
        F.sum(F.when(F.col("recognised"), 0).otherwise(1)).cast("long").alias("total_neighbors_unrecognized"),
    )


def ontology_scores(neighbours: DataFrame, terms: DataFrame, pairs: DataFrame, *, query_id: str = "query_cell_id", term_col: str = "cell_type_ontology_term_id", prefactor: float = 1.0, prune_threshold: float = 0.1) -> DataFrame:
    """Per query and term: the share of the weight that falls on the term or below. terms: ord, term, name; pairs: term, ancestor.

    The total includes neighbours with unknown terms. With a threshold above 0 lower scores go; otherwise every term is
    listed, with 0 where nothing falls on it. position is the terms' order. The ontology is small and broadcast.
    """
    if not terms.filter("name is null").isEmpty():
        raise OntologyError("a term has no name")
    weighed = weighted(neighbours, terms, query_id=query_id, term_col=term_col, prefactor=prefactor)
    spread = with_self(terms, pairs).select(F.col("term").alias("from_term"), F.col("ancestor").alias("term"))
    sums = weighed.filter("recognised").join(F.broadcast(spread), F.col(term_col) == F.col("from_term")).groupBy(query_id, "term").agg(F.sum("weight").alias("w"))
    total = totals(weighed, query_id=query_id).select(query_id, "total_weight")
    listed = terms.select(F.col("ord").cast("long").alias("position"), "term", F.col("name").alias("cell_type"))
    if prune_threshold > 0:
        scored = sums.join(total, query_id).join(F.broadcast(listed), "term")
    else:
        every = total.crossJoin(F.broadcast(listed))  # all terms for each query is what is asked for
        scored = every.join(sums, [query_id, "term"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    scored = scored.withColumn("score", F.try_divide("w", "total_weight"))
    if prune_threshold > 0:
        scored = scored.filter(F.col("score") >= prune_threshold)
    return scored.select(query_id, "position", F.col("term").alias("cell_type_ontology_term_id"), "cell_type", "score")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"summary_statistics": summary_statistics, "ontology_aware": ontology_scores}


def summarize(strategy: str, neighbours: DataFrame, **options) -> DataFrame:
    return STRATEGIES[strategy](neighbours, **options)


def as_response(rows: DataFrame, fields: list[str], *, query_id: str = "query_cell_id") -> DataFrame:
    """One row a query: its matches in order of position; a query has no more of them than there are types or terms."""
    held = F.array_sort(F.collect_list(F.struct("position", *fields)))
    return rows.groupBy(query_id).agg(F.transform(held, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("matches"))
