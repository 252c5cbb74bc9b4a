"""Trees of centroids: training, assignment and a served index, without a list of all centroids anywhere.

A node with k partitions to come gets k children where k <= WHOLE, else about sqrt(k) of them, which share its partitions by their rows;
65,536 partitions make a tree of two levels, and a hot cell one of three. Each node is trained in a task of its own, on POINTS rows of
the sample for each child at most. A row is assigned by going down: to the nearest child each time, ties to the first.

The tree is a table with a row for each inner node. Where it has at most `most_bytes` it is broadcast whole; else rows are read once for
each chunk of subtrees that has. A query goes down to the `breadth` nearest children of the root and keeps `breadth` nodes in each
subtree from there; of the leaves that it meets it probes the `nprobe` nearest.

A served index lies by groups of partitions, a folder a group, sorted by partition: a search reads the groups that are probed (partition
pruning) and of their files the row groups (statistics). A large group has several files, written by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexConfigurationError
from ..functions import vectors as V
from ..sources.shared import discard, file_system, staged
from .index_build import sampled
from .search import LARGEST, QUERY_BLOCK, _searched, arrays, closest, distances, probed_scan, ranked

WHOLE, FANOUT, POINTS, ITERATIONS = 64, 256, 128, 10
MOST_BYTES = 96 << 20
BREADTH = 8
GROUPS, FILE_ROWS = 1024, 200_000
TREE = "node bigint, width int, children array<bigint>, centroids array<double>"


def lloyd(m: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """At most k centroids: those of k-means from random different rows, or all different rows where there are no more."""
    different = np.unique(m, axis=0)
    if len(different) <= k:
        return different
    c = different[np.random.default_rng(0).permutation(len(different))[:k]]
    step = max(16, 2**22 // k)
    for _ in range(iterations):
        at, away = np.empty(len(m), np.int64), np.empty(len(m))
        for a in range(0, len(m), step):
            x = m[a : a + step]
            d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
            at[a : a + step] = d.argmin(1)
            away[a : a + step] = d.min(1)
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        new = c.copy()
        new[held] = np.add.reduceat(m[order], first, axis=0) / np.diff(np.append(first, len(m)))[:, None]
        lost = np.setdiff1d(np.arange(k), held)
        new[lost] = m[np.argsort(-away, kind="stable")[: len(lost)]]
        if np.array_equal(new, c):
            break
        c = new
    return c


def children_of(k: int) -> int:
    return k if k <= WHOLE else min(FANOUT, math.ceil(math.sqrt(k)))


def trained_tree(sample: DataFrame, partitions: int, metric: str = "l2", *, vector: str = "embedding", points: int = POINTS, iterations: int = ITERATIONS) -> DataFrame:
    """The tree over a sample: node, top, width, children, leaves (partition ids, -1 for inner nodes), centroids; a staged table.

    There are about `partitions` leaves, fewer where vectors repeat."""
    fine = F.forall(V.doubles(vector), lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))
    rows = staged(sample.filter(F.col(vector).isNotNull() & fine).select(V.doubles(vector).alias("v")).withColumn("draw", F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)).withColumn("node", F.lit(0).cast("bigint")), "training")
    n = rows.count()
    if not n:
        raise IndexConfigurationError("there are no vectors to train on")
    # One row a node that is to be divided: never more than there are partitions.
    nodes = sample.sparkSession.createDataFrame([(0, partitions, n)], "node bigint, k bigint, n bigint")
    levels: list[DataFrame] = []

    def train(key: tuple, t: pa.Table) -> pa.Table:
        node, k = key[0].as_py(), t.column("k")[0].as_py()
        _, m = arrays(t, None)
        c = lloyd(m[np.lexsort(m.T[::-1])], children_of(k), iterations)
        columns = [pa.array([node]), pa.array([m.shape[1]], pa.int32()), pa.array([[node * FANOUT + 1 + i for i in range(len(c))]], pa.list_(pa.int64())), pa.array([c.reshape(-1)], pa.list_(pa.float64()))]
        return pa.table(columns, names=["node", "width", "children", "centroids"])

    while not nodes.isEmpty():
        wanted = F.when(F.col("k") <= WHOLE, F.col("k")).otherwise(F.least(F.lit(FANOUT), F.ceil(F.sqrt("k"))))
        held = nodes.select(F.col("node").alias("own"), "k", (wanted * points / F.col("n")).alias("share"))
        chosen = rows.join(F.broadcast(held), F.col("node") == F.col("own")).filter(F.col("draw") < F.col("share"))
        level = staged(chosen.select("node", "k", "v").groupBy("node").applyInArrow(train, TREE), "level")
        levels.append(level)
        moved = staged(_descended(rows.join(F.broadcast(held.select("own")), F.col("node") == F.col("own"), "left_semi"), [level], metric, "v", "node"), "training")
        split = level.select("node", F.explode("children").alias("child"), F.size("children").alias("c"))
        sizes = moved.groupBy(F.col("node").alias("child")).agg(F.count(F.lit(1)).alias("m"))
        ahead = split.join(nodes, "node").join(sizes, "child").filter((F.col("k") > WHOLE) & (F.col("c") > 1))
        after = staged(ahead.select(F.col("child").alias("node"), F.greatest(F.lit(1), F.floor(F.col("k") * F.col("m") / F.col("n"))).alias("k"), F.col("m").alias("n")).filter("k > 1"), "nodes")
        discard(rows, nodes)
        rows, nodes = moved, after
    discard(rows, nodes)
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    places = tree.select("node", F.posexplode("children").alias("place", "child"))
    inner = tree.select(F.col("node").alias("inner"))
    ends = places.join(inner, F.col("child") == F.col("inner"), "left_anti").select(F.col("child").alias("leaf"), (F.row_number().over(Window.orderBy("child")) - 1).cast("int").alias("id"))
    named = places.join(ends, F.col("child") == F.col("leaf"), "left").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("leaves"))
    top = F.col("node")
    for _ in range(len(levels)):  # up to the child of the root
        top = F.when(top > FANOUT, F.floor((top - 1) / FANOUT)).otherwise(top)
    out = staged(tree.join(named, "node").select("node", top.cast("bigint").alias("top"), "width", "children", "leaves", "centroids"), "tree")
    discard(*levels)
    return out


def tree_of(centroids: DataFrame) -> DataFrame:
    """A tree of two levels from given centroids: cell, partition_id, centroid. A cell's own centroid is in the row without a partition_id."""
    numbered = centroids.select(F.col("cell").cast("bigint").alias("cell"), F.col("partition_id").cast("int").alias("leaf"), V.doubles("centroid").alias("c"))
    flat = lambda rows: F.flatten(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["c"]))
    order = lambda rows, name: F.transform(F.array_sort(F.collect_list(rows)), lambda x: x[name])
    upper = numbered.filter("leaf is null").groupBy(F.lit(0).cast("bigint").alias("node")).agg(F.max(F.size("c")).alias("width"), order(F.struct("cell", "c"), "cell").alias("cells"), flat(F.struct("cell", "c")).alias("centroids"))
    upper = upper.select("node", F.lit(0).cast("bigint").alias("top"), "width", F.transform("cells", lambda x: x + 1).alias("children"), F.transform("cells", lambda x: F.lit(-1)).alias("leaves"), "centroids")
    lower = numbered.filter("leaf is not null").groupBy((F.col("cell") + 1).alias("node")).agg(F.max(F.size("c")).alias("width"), order(F.struct("leaf", "c"), "leaf").alias("leaves"), flat(F.struct("leaf", "c")).alias("centroids"))
    lower = lower.select("node", F.col("node").alias("top"), "width", F.transform("leaves", lambda x: -x.cast("bigint") - 1).alias("children"), "leaves", "centroids")
    return upper.unionByName(lower)


Blocks = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _blocks(tree: DataFrame) -> Blocks:
    """node -> its children's numbers, their partition ids and their centroids."""
    t = tree.select("node", "width", "children", "leaves", "centroids").toArrow()
    as_array = lambda name, k, kind: np.array(t.column(name)[k].values.to_numpy(), kind)
    return {t.column("node")[k].as_py(): (as_array("children", k, np.int64), as_array("leaves", k, np.int32), as_array("centroids", k, np.float64).reshape(-1, t.column("width")[k].as_py())) for k in range(len(t))}


def chunks(tree: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The tree in parts of whole subtrees, each with the root, of at most `most_bytes` unless one subtree has more."""
    sizes = sorted((r.top, r.bytes) for r in tree.filter("node <> 0").groupBy("top").agg(F.sum(8 * F.size("centroids")).alias("bytes")).collect())
    parts: list[list[int]] = [[]]
    held = 0
    for top, size in sizes:
        if parts[-1] and held + size > most_bytes:
            parts.append([])
            held = 0
        parts[-1].append(top)
        held += size
    return [tree] if len(parts) == 1 else [tree.filter((F.col("node") == 0) | F.col("top").isin(p)) for p in parts]


def _descended(df: DataFrame, parts: list[DataFrame], metric: str, vector: str, name: str) -> DataFrame:
    """df with the column `name`: where its rows come to. Without `leaves` in the parts this is one step down from `name`; with them it is the partition."""
    final = "leaves" in parts[0].columns
    kind = T.IntegerType() if final else T.LongType()
    schema = T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])
    spark, out = df.sparkSession, None
    for number, part in enumerate(parts):
        held = _blocks(part if final else part.withColumn("leaves", F.transform("children", lambda x: F.lit(-1))))
        sent = spark.sparkContext.broadcast(held)
        width = next(iter(held.values()))[2].shape[1]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number, width=width) -> Iterator[pa.RecordBatch]:
            blocks = sent.value
            for b in batches:
                v = b.column(vector)
                there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                ok, x = arrays(pa.RecordBatch.from_arrays([v.drop_null().cast(pa.list_(pa.float64()))], names=["v"]), width)
                rows = there[ok]
                node = np.zeros(len(rows), np.int64) if final else b.column(name).to_numpy()[rows].copy()
                leaf, open_ = np.full(len(rows), -1, np.int32), np.arange(len(rows))
                mine = np.zeros(b.num_rows, bool)
                mine[np.setdiff1d(np.arange(b.num_rows), rows)] = number == 0  # what takes no part is told once
                while len(open_):
                    order = open_[np.argsort(node[open_], kind="stable")]
                    names, first = np.unique(node[order], return_index=True)
                    for p, at in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                        if p in blocks:
                            children, leaves, m = blocks[p]
                            best = closest(metric, x[at], m)
                            node[at], leaf[at] = children[best], leaves[best]
                            mine[rows[at]] = True
                        else:  # a subtree of another chunk
                            mine[rows[at]], leaf[at] = False, 0
                    open_ = open_[leaf[open_] < 0] if final else open_[:0]
                result = np.full(b.num_rows, -1, np.int32 if final else np.int64)
                result[rows] = leaf if final else node
                keep = [n for n in b.schema.names if n != name]
                whole = pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(result)], names=[*keep, name])
                yield whole if mine.all() else whole.filter(pa.array(mine))

        got = df.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def assigned_by_tree(df: DataFrame, tree: DataFrame, metric: str = "l2", *, vector: str = "embedding", most_bytes: int = MOST_BYTES) -> DataFrame:
    """df with partition_id, found by going down the tree; -1 for vectors that take no part in searches. Rows are not shuffled."""
    return _descended(df, chunks(tree, most_bytes), metric, vector, "partition_id")


def probes(queries: DataFrame, tree: DataFrame, nprobe: int, metric: str = "l2", *, breadth: int = BREADTH, most_bytes: int = MOST_BYTES) -> DataFrame:
    """q, partition_id: what each query (id, v) probes."""
    if nprobe < 1 or breadth < 1:
        raise IndexConfigurationError("nprobe and breadth must be positive")
    kind = queries.schema["id"].dataType.simpleString()
    out, parts = None, chunks(tree, most_bytes)
    for part in parts:
        sent = queries.sparkSession.sparkContext.broadcast(_blocks(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = sent.value
            for b in batches:
                ok, x = arrays(b, blocks[0][2].shape[1])
                found: list[tuple[int, float, int]] = []
                for r, q in enumerate(x):
                    children, leaves, m = blocks[0]
                    d = distances(metric, q, m)
                    near = np.lexsort((children, d))[:breadth] if (leaves < 0).any() else np.arange(len(d))
                    best = [(d[i], int(leaves[i])) for i in near if leaves[i] >= 0]
                    for top in [int(children[i]) for i in near if leaves[i] < 0]:
                        front = [top] if top in blocks else []
                        while front:
                            children, leaves, m = (np.concatenate(y) for y in zip(*(blocks[p] for p in front), strict=True))
                            d = distances(metric, q, m)
                            best += [(d[i], int(leaves[i])) for i in np.flatnonzero(leaves >= 0)]
                            inner = np.flatnonzero(leaves < 0)
                            front = children[inner[np.lexsort((children[inner], d[inner]))[:breadth]]].tolist()
                    found += [(int(ok[r]), float(x_), leaf) for x_, leaf in sorted(best)[:nprobe]]
                if found:
                    at, d, leaf = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(d), pa.array(leaf, pa.int32())], names=["q", "d", "partition_id"])

        got = queries.mapInArrow(run, f"q {kind}, d double, partition_id int")
        out = got if out is None else out.unionByName(got)
    if len(parts) == 1:
        return out.select("q", "partition_id")
    order = Window.partitionBy("q").orderBy("d", "partition_id")
    return out.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= nprobe).select("q", "partition_id")


# The served index.


@dataclass
class ServedIndex:
    """An opened index: its files are listed and its settings read once, and any number of searches share it."""

    path: str
    metric: str
    rows: DataFrame
    tree: DataFrame
    leaves: int
    span: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ServedIndex:
        fs, at = file_system(spark, f"{path}/settings/_SUCCESS")
        if not fs.exists(at):
            raise IndexConfigurationError(f"no index at {path}")
        s = spark.read.json(f"{path}/settings").first()
        kind = T._parse_datatype_json_string(s.rows)
        return cls(path, s.metric, spark.read.schema(kind).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/tree"), s.leaves, s.span)

    def probed(self, partitions: list[int]) -> DataFrame:
        """The rows of some partitions; plans read their groups alone."""
        if len(partitions) >= self.leaves:
            return self.rows
        groups = sorted({p // self.span for p in partitions})
        return self.rows.filter(F.col("cell_group").isin(groups) & F.col("partition_id").isin(partitions))

    def search(self, queries: DataFrame, k: int, nprobe: int, *, breadth: int = BREADTH, query_id: str = "query_cell_id", query_vector: str = "embedding", index_id: str = "cas_cell_index", query_block: int = QUERY_BLOCK, most_bytes: int = MOST_BYTES) -> DataFrame:
        """query id, rank (from 1), index id and distance of the k nearest rows in the probed partitions; ties to the smaller id."""
        asked = queries.select(F.col(query_id).alias("id"), V.doubles(query_vector).alias("v"))
        kind = asked.schema["id"].dataType

        def scan(names: pa.Array, q: np.ndarray):
            held: dict[int, list[int]] = {}
            if len(q):
                # The block goes back to the tasks, which know the tree; a row for each query and probe returns.
                numbered = queries.sparkSession.createDataFrame(pa.table([pa.array(np.arange(len(q))), pa.array(list(q), pa.list_(pa.float64()))], names=["id", "v"]))
                t = probes(numbered, self.tree, nprobe, self.metric, breadth=breadth, most_bytes=most_bytes).toArrow()
                for r, p in zip(t.column("q").to_pylist(), t.column("partition_id").to_pylist(), strict=True):
                    held.setdefault(p, []).append(r)
            sent = queries.sparkSession.sparkContext.broadcast((names, q, {p: np.array(sorted(r)) for p, r in held.items()}))
            rows = self.probed(sorted(held)).select(F.col("partition_id").alias("part"), "id", F.col("embedding").alias("v"))
            return probed_scan(rows, sent, self.metric, k, kind.simpleString()), sent

        found = _searched(asked, scan, query_block)
        return ranked(found.select(F.col("q").alias(query_id), F.col("n").alias(index_id), F.col("d").alias("distance")), k, query_id=query_id, index_id=index_id)


def create_served(rows: DataFrame, path: str, partitions: int, metric: str = "l2", *, id_col: str = "id", vector: str = "embedding", sample_size: int | None = None, tree: DataFrame | None = None, groups: int = GROUPS, file_rows: int = FILE_ROWS, most_bytes: int = MOST_BYTES) -> ServedIndex:
    """Train (unless a tree is given), assign, write; the settings come last, and an index without them is none. Rows without an id take no part."""
    if metric not in ("l2", "cosine"):
        raise IndexConfigurationError(f"{metric!r} is neither l2 nor cosine")
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), V.doubles(vector).alias("embedding")).filter("id is not null")
    n_rows = own.count()
    tree = tree if tree is not None else trained_tree(sampled(own, n_rows, sample_size or 2 * POINTS * partitions), partitions, metric)
    tree.select("node", "top", "width", "children", "leaves", "centroids").write.mode("overwrite").parquet(f"{path}/tree")
    held = spark.read.parquet(f"{path}/tree")
    leaves = held.agg(F.max(F.array_max("leaves"))).first()[0] + 1
    span = -(-leaves // groups)
    placed = staged(assigned_by_tree(own, held, metric, most_bytes=most_bytes).filter("partition_id >= 0").withColumn("cell_group", F.floor(F.col("partition_id") / span).cast("int")), "placed")
    # Files of a group: one for each file_rows rows. There are at most `groups` sizes.
    sizes = placed.groupBy(F.col("cell_group").alias("of")).agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("files"))
    dealt = placed.join(F.broadcast(sizes), F.col("cell_group") == F.col("of")).withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    out = dealt.repartition("cell_group", "file").sortWithinPartitions("cell_group", "partition_id", "id").select("id", "embedding", "partition_id", "cell_group")
    out.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("cell_group").parquet(f"{path}/rows")
    discard(placed)
    kind = T.StructType([*(f for f in out.schema.fields if f.name != "cell_group"), T.StructField("cell_group", T.IntegerType())])
    spark.createDataFrame([(metric, leaves, span, kind.json())], "metric string, leaves int, span int, rows string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    return ServedIndex.open(spark, path)
