"""Ontology graphs as edges (parent, child): closure, children, path lengths, and the document made of them.

Closures and paths grow by doubling: beside the pairs that a route of fewer than 2^k edges joins, those that one of exactly 2^k edges
joins are kept, and both are put together to what fewer than 2^(k+1) join. So a chain of thousands of terms takes a dozen rounds, and pairs
are made distinct in each, for a dense graph to cost its pairs and not its paths. Rounds are staged in the shared folder, and what the
next one replaces goes; what a round found is observed while it is written. No side of a join is broadcast: each grows with the graph.

Where every term has one parent at most, routes are unique: the closure is then kept as one row a term, an array of its ancestors from the
nearest on, and nothing has to be made distinct or shuffled pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import OntologyError
from ..sources.shared import discard, staged

ROOT = "CL:0000000"


def edges_of(classes: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Distinct edges between known classes. classes: term; parents and children: parent, child, as seen from either end."""
    known = classes.select("term").distinct()
    both = parents.select("parent", "child").unionByName(children.select("parent", "child")).distinct()
    return both.join(known, F.col("parent") == F.col("term"), "left_semi").join(known, F.col("child") == F.col("term"), "left_semi")


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """df (term, ancestor, ...) staged, the number of its rows, and of those whose term is its own ancestor."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") == F.col("ancestor")).alias("loops")), name)
    return out, seen.get["n"], seen.get["loops"]


def _doubled(exact: DataFrame) -> DataFrame:
    """From pairs that a route of n edges joins, those that one of 2n edges joins."""
    ahead = exact.select(F.col("term").alias("via"), F.col("ancestor").alias("beyond"))
    return exact.join(ahead.hint("merge"), F.col("ancestor") == F.col("via")).select("term", F.col("beyond").alias("ancestor")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """term, ancestor: all pairs, without the term itself. A term that is its own ancestor is a cycle and an error."""
    exact, n, loops = _observed(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct(), "exact")
    if n and not loops and exact.groupBy("term").count().filter("count > 1").isEmpty():
        return _lines(exact)
    found = exact
    while n and not loops:
        twice, n, loops = _observed(_doubled(exact), "exact")
        if n and not loops:
            # What 2^k to 2^(k+1) - 1 edges join: exactly 2^k, or fewer and then exactly 2^k.
            beyond = twice.select(F.col("term").alias("via"), F.col("ancestor").alias("beyond"))
            longer = found.join(beyond.hint("merge"), F.col("ancestor") == F.col("via")).select("term", F.col("beyond").alias("ancestor"))
            after, _, loops = _observed(found.unionByName(twice).unionByName(longer).distinct(), "closure")
            discard(found, exact)
            found = after
        exact = twice
    if loops:
        raise OntologyError("the graph has a cycle")
    discard(exact if exact is not found else None)
    return found


def _lines(exact: DataFrame) -> DataFrame:
    """The closure of terms with one parent each. A term's row holds its ancestors so far and, while there may be more, the `last` of them, whose row goes on from there."""
    rows = exact.select("term", F.array("ancestor").alias("above"), F.col("ancestor").alias("last"))
    ended: list[DataFrame] = []
    while True:
        every = rows
        for e in ended:
            every = every.unionByName(e)
        ahead = every.select(F.col("term").alias("via"), F.col("above").alias("further"), F.col("last").alias("beyond"))
        going = rows.filter("last is not null").join(ahead.hint("merge"), F.col("last") == F.col("via"), "left")
        seen, above = Observation(), F.concat("above", F.coalesce("further", F.array().cast(rows.schema["above"].dataType)))
        after = going.select("term", above.alias("above"), F.col("beyond").alias("last"))
        after = after.observe(seen, F.count_if(F.col("last").isNotNull()).alias("n"), F.count_if(F.array_contains("above", F.col("term"))).alias("loops"))
        after, before = staged(after, "lines"), rows
        if seen.get["loops"]:
            raise OntologyError("the graph has a cycle")
        ended, rows = [*ended, before.filter("last is null")], after
        if not seen.get["n"]:
            break
    for e in ended:
        rows = rows.unionByName(e)
    return rows.select("term", F.explode("above").alias("ancestor"))


def with_self(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """The closure and each term as its own ancestor, each pair once: scores must not count two routes twice."""
    return pairs.select("term", "ancestor").unionByName(terms.select("term", F.col("term").alias("ancestor"))).distinct()


def ancestors(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """term and its ancestors in order; a term has no more of them than the ontology has terms."""
    return terms.select("term").join(pairs.groupBy("term").agg(F.array_sort(F.collect_set("ancestor")).alias("ancestors")), "term", "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))


def children(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """term and its direct children in order; leaves have none."""
    of = edges.groupBy(F.col("parent").alias("term")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    return terms.select("term").join(of, "term", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def _lengths(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, bool]:
    """term, shortest, longest: the fewest and most edges of a route from a start (term); and whether routes go on without end.

    A term's row after a round is about routes of fewer than 2^k edges. Rounds end when no route has 2^k edges, or 2^k is the number of
    terms, which no route without a cycle reaches."""
    most = edges.select(F.col("parent").alias("t")).union(edges.select("child")).distinct().count()
    exact, n, _ = _observed(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct(), "exact")
    now, step = staged(starts.select("term", F.lit(0).alias("shortest"), F.lit(0).alias("longest")).distinct(), "lengths"), 1
    while n and step < max(2, 2 * most):
        on = exact.join(now.withColumnRenamed("term", "via").hint("merge"), F.col("ancestor") == F.col("via")).select("term", (F.col("shortest") + step).alias("shortest"), (F.col("longest") + step).alias("longest"))
        after = staged(now.unionByName(on).groupBy("term").agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest")), "lengths")
        twice, n, _ = _observed(_doubled(exact), "exact")
        discard(now, exact)
        now, exact, step = after, twice, 2 * step
    discard(exact)
    return now, n > 0


def _start(edges: DataFrame, root) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["parent"].dataType).alias("term"))


def shortest_paths(edges: DataFrame, root: str = ROOT) -> DataFrame:
    """term and the fewest edges from the root; what it doesn't reach is absent. Cycles do no harm."""
    return _lengths(edges, _start(edges, root))[0].select("term", F.col("shortest").alias("length"))


def longest_paths(edges: DataFrame, root: str = ROOT) -> DataFrame:
    """term and the most edges from the root; what it doesn't reach is absent. A cycle that the root reaches is an error, others do no harm."""
    found, endless = _lengths(edges, _start(edges, root))
    if endless:  # is it the root's?
        own = staged(edges.join(found, F.col("parent") == F.col("term"), "left_semi"), "edges")
        discard(found)
        found, endless = _lengths(own, _start(edges, root))
        if endless:
            raise OntologyError("the graph has a cycle")
    return found.select("term", F.col("longest").alias("length"))


def topological(edges: DataFrame) -> DataFrame:
    """term and depth, the most edges from any term without parents: in order of depth, and then of term, parents come before children."""
    every = edges.select(F.col("parent").alias("term")).union(edges.select("child")).distinct()
    found, endless = _lengths(edges, every.join(edges.select(F.col("child").alias("term")).hint("merge"), "term", "left_anti"))
    if endless:
        raise OntologyError("the graph has a cycle")
    return found.select("term", F.col("longest").alias("depth")).orderBy("depth", "term")


def resource(terms: DataFrame, edges: DataFrame, root: str = ROOT) -> DataFrame:
    """One row: the document of an ontology. terms: term, name. Its size is that of the ontology."""
    pairs = staged(closure(edges), "pairs")  # where there is a cycle, this is an error
    lengths, _ = _lengths(edges, _start(edges, root))

    def held(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("term").alias("key"), F.col(value).alias("value"))))).alias(name))

    parts = [
        held(ancestors(terms, pairs), "ancestors", "ancestors_dictionary"),
        held(terms, "name", "cell_ontology_term_id_to_cell_type"),
        held(children(terms, edges), "children", "children_dictionary"),
        held(lengths, "shortest", "shortest_path_lengths_from_cell_root"),
        held(lengths, "longest", "longest_path_lengths_from_cell_root"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*(F.first(c, ignorenulls=True).alias(c) for c in out.columns))  # each part is one row


def served(doc: DataFrame) -> DataFrame:
    """What clients see: names in order and the maps, without the ancestors."""
    return doc.select(
        F.array_sort(F.map_keys("cell_ontology_term_id_to_cell_type")).alias("cl_names"),
        "cell_ontology_term_id_to_cell_type",
        "children_dictionary",
        "shortest_path_lengths_from_cell_root",
        "longest_path_lengths_from_cell_root",
    )


def require_column(columns: DataFrame, model_metadata_id: int, name: str) -> None:
    """An error unless the model's metadata has the ontology column."""
    if columns.filter((F.col("cell_info_metadata_id") == model_metadata_id) & (F.col("column_name") == name)).isEmpty():
        raise OntologyError(f"the model has no ontology column {name!r}")
