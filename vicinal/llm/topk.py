"""Exact top-k search by inner product, with segment statistics as bounds.

Components become floor(1024 * x). A segment's inner product is at most length * (mean * mean + deviation * deviation); the sum over
segments bounds the score from above (the distance from below). Levels of 1, 4, 16 ... segments are tried from coarse to fine, each on
the pairs alone that the one before let through. Of what survives, a query's most promising rows come first, and exact scores are
computed for those pairs only whose bound still reaches the query's threshold: its k-th best score so far. Thresholds start from the
k-th best score among `seed_rows` rows, any rows at all, which saves work and changes nothing. Where more than a quarter of the pairs of a
block survives, the next level, or the exact score, is one product of matrices for the block; else the pairs are gathered. A bound equal to the threshold
survives: ties go to the smaller id.

Vectors that are null, or hold a null or non-finite component, take no part, and rows with a null id neither. A query is not its
own candidate; rows that repeat an id are candidates of other queries each for itself. Scores exist between vectors of one length
only. Scores are exact: products are summed as floats while all partial sums stay below 2**53, else as integers; a score beyond
64 bits is an error. An empty table gives an empty table. Extra columns are ignored.

Scale: the queries are held in blocks of `query_block` rows; a block is broadcast and meets all rows, batch by batch, in one job
without a shuffle, by products of matrices and gathered pairs, never query by query; the thresholds to start from come from a task, too; and its broadcast goes when the job is done. Each task sends the k best of each query, and these few rows are
ranked in a shuffle by query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, new_path, staged, table

K = 10
SCALE = 1024
QUERY_BLOCK = 20_000
LEVELS = (1, 4, 16)
SEED_ROWS = 4096
#: Rows and pairs of rows and queries that meet at once.
BLOCK_ROWS, BLOCK_PAIRS = 4096, 1 << 20
#: Less than any score.
LEAST = -(1 << 80)


def scaled(column: pa.Array, ids: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: ids, and matrix of floor(SCALE * x), of the vectors that take part."""
    there = pa.compute.and_(column.is_valid(), ids.is_valid())
    column, ids = column.filter(there), ids.filter(there).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = {}
    for n in np.unique(ends - starts).tolist():
        rows = np.flatnonzero(ends - starts == n)
        m = flat[starts[rows][:, None] + np.arange(n)]
        ok = np.isfinite(m).all(1)  # nulls are NaN here
        if ok.any():
            out[n] = (ids[rows][ok], np.floor(SCALE * m[ok]))
    return out


def statistics(m: np.ndarray, levels: tuple[int, ...]) -> list[np.ndarray]:
    """For each level, means and deviations of the segments side by side, scaled by the root of the segments' lengths."""
    out = []
    for n in levels:
        if n < m.shape[1]:
            parts = np.array_split(m, n, axis=1)
            out.append(np.concatenate([np.stack([f(p, axis=1) * math.sqrt(p.shape[1]) for p in parts], 1) for f in (np.mean, np.std)], 1))
    return out


class Search:
    """The best of each query so far. Queries and candidates of one length; `least` are thresholds to start from."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, levels: tuple[int, ...], least: np.ndarray | None = None):
        self.ids, self.m, self.k, self.levels = ids, matrix, k, levels
        self.stats, self.top = statistics(matrix, levels), float(np.abs(matrix).max(initial=0))
        # Scores are whole numbers, as floats while those are exact; places without a candidate hold the least of all.
        self.score, self.id = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(float)
        self.pairs = self.scored = 0  # pairs met, and pairs whose exact score was computed

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Blocks of queries meet blocks of rows."""
        rows = min(max(1, len(ids)), BLOCK_ROWS)
        queries = max(1, BLOCK_PAIRS // rows)
        for a in range(0, len(ids), rows):
            for q in range(0, len(self.ids), queries):
                self._add(np.arange(q, min(q + queries, len(self.ids))), ids[a : a + rows], m[a : a + rows])

    def _add(self, own: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        high = self.top * float(np.abs(m).max(initial=0)) * max(1, m.shape[1])
        slack, stats = 1e-9 * high + 1e-6, statistics(m, self.levels)
        self.pairs += len(own) * len(ids)
        alive = self.ids[own][:, None] != ids[None, :]
        if stats:  # the coarsest level meets every pair, by two numbers a vector
            alive &= self.stats[0][own] @ stats[0].T + slack >= self.least[own][:, None]
        # While more than a quarter of the pairs is left, products for all of them cost less than gathering.
        level, dense = 1, high < 2**53 and 4 * np.count_nonzero(alive) > alive.size
        while dense and level < len(stats):
            alive &= self.stats[level][own] @ stats[level].T + slack >= self.least[own][:, None]
            level, dense = level + 1, 4 * np.count_nonzero(alive) > alive.size
        if dense:
            self.scored += np.count_nonzero(alive)
            score = np.where(alive, self.m[own] @ m.T, -np.inf)
            worst = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1] if len(ids) > self.k else np.full(len(own), -np.inf)
            r, c = np.nonzero(alive & (score >= np.maximum(worst, self.least[own])[:, None]))
            self._keep(own[r], score[r, c], ids[c])
            return
        r, c = np.nonzero(alive)
        bound = None
        for mine, other in zip(self.stats[level:], stats[level:], strict=True):
            if not len(r):
                return
            bound = paired(mine[own], other, r, c)
            near = bound + slack >= self.least[own[r]]
            r, c, bound = r[near], c[near], bound[near]
        if bound is not None and len(r) > 4 * self.k:
            order = np.lexsort((-bound, r))
            r, c, bound = r[order], c[order], bound[order]
            early = np.arange(len(r)) - np.searchsorted(r, r) < 2 * self.k  # the most promising of each query
            self._score(own, r[early], c[early], ids, m, high)
            later = np.flatnonzero(~early & (bound + slack >= self.least[own[r]]))
            r, c = r[later], c[later]
        self._score(own, r, c, ids, m, high)

    def _score(self, own: np.ndarray, r: np.ndarray, c: np.ndarray, ids: np.ndarray, m: np.ndarray, high: float) -> None:
        if not len(r):
            return
        self.scored += len(r)
        r = own[r]
        if high < 2**53:
            score = paired(self.m, m, r, c)
        elif high < 2**63:
            score = paired(self.m.astype(np.int64), m.astype(np.int64), r, c).astype(object)
        else:  # integers of any size
            whole = np.frompyfunc(int, 1, 1)
            score = np.array([whole(m[y]) @ whole(self.m[x]) for x, y in zip(r.tolist(), c.tolist(), strict=True)], object)
        if score.dtype == object and self.score.dtype != object:
            self.score = np.array([[int(x) if x > -np.inf else LEAST for x in row] for row in self.score.tolist()], object).reshape(self.score.shape)
        self._keep(r, score, ids[c])

    def _keep(self, r: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        """Put candidates of the queries r beside what these hold."""
        near = np.flatnonzero(score >= self.score[r, -1])
        if not len(near):
            return
        r, score, found = r[near], score[near].astype(self.score.dtype), found[near]
        # What a query has and what has been found, in order of score and then of id.
        touched = np.unique(r)
        r = np.concatenate([np.repeat(touched, self.k), r])
        score, found = np.concatenate([self.score[touched].reshape(-1), score]), np.concatenate([self.id[touched].reshape(-1), found])
        order = np.array(sorted(range(len(r)), key=lambda x: (r[x], -score[x], found[x])), np.int64) if score.dtype == object else np.lexsort((found, -score, r))
        turn = np.arange(len(r)) - np.searchsorted(r[order], r[order])
        order = order[turn < self.k].reshape(len(touched), self.k)
        self.score[touched], self.id[touched] = score[order], found[order]
        worst = self.score[touched, -1]
        self.least[touched] = np.maximum(self.least[touched], np.array([-np.inf if x == LEAST else float(x) for x in worst.tolist()]))

    @property
    def best(self) -> list[list[tuple[int, int]]]:
        """What each query holds: negated scores and ids, in order."""
        return [[(-int(x), int(i)) for x, i in zip(score, ids, strict=True) if x > LEAST] for score, ids in zip(self.score.tolist(), self.id.tolist(), strict=True)]

    def found(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Queries, candidates and scores of all that is held."""
        there = self.score > LEAST
        r, k = np.nonzero(there)
        return self.ids[r], self.id[r, k], [int(x) for x in self.score[r, k].tolist()]


def paired(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, some pairs at a time."""
    out = np.empty(len(r), a.dtype)
    step = max(1, 2**21 // max(1, a.shape[1]))
    for x in range(0, len(r), step):
        out[x : x + step] = np.einsum("ij,ij->i", a[r[x : x + step]], b[c[x : x + step]])
    return out


def top_k(queries: DataFrame, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_block: int = QUERY_BLOCK, levels: tuple[int, ...] = LEVELS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `rows` for each of `queries`."""
    spark = queries.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id is not null and vector is not null").distinct()
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    n = asked.count()
    n_blocks = -(-n // query_block) or 1
    if n_blocks > 1:
        asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "queries")
    few = staged(held.limit(seed_rows), "seeds")
    schema, found, at = "query_id bigint, vec_id bigint, score bigint", None, None
    for block in range(n_blocks):
        by = scaled(*columns(asked.filter(F.col("block") == block).select("id", "vector") if n_blocks > 1 else asked))

        def scan_with(sent):
            def scan(batches):
                by, least = sent.value
                search = {w: Search(i, m, k, levels, least.get(w)) for w, (i, m) in by.items()}
                for b in batches:
                    for w, (i, m) in scaled(b.column("vector"), b.column("id")).items():
                        if w in search:
                            search[w].add(i, m)
                for s in search.values():
                    queries, candidates, scores = s.found()
                    for a in range(0, len(queries), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 10_000], pa.int64()) for x in (queries, candidates, scores)], names=["query_id", "vec_id", "score"])

            return scan

        # A task compares the seeds; a number a query comes back.
        first = spark.sparkContext.broadcast((by, {}))
        reached = few.mapInArrow(scan_with(first), schema).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).toArrow()
        first.destroy()
        held_ids, least = dict(zip(reached.column("query_id").to_pylist(), reached.column("score").to_pylist(), strict=True)), {}
        every, times = np.unique(np.concatenate([ids for ids, _ in by.values()]), return_counts=True) if by else ((), ())
        repeated = {i for i, n in zip(every, times, strict=True) if n > 1}  # an id with several vectors has no threshold of its own
        for w, (ids, _) in by.items():
            least[w] = np.array([-np.inf if i in repeated else float(held_ids.get(i, -np.inf)) for i in ids.tolist()])
        sent = spark.sparkContext.broadcast((by, least))
        scan = scan_with(sent)

        found = held.mapInArrow(scan, schema)
        if n_blocks > 1:
            at = at or new_path(spark, "best")
            found.write.mode("append").parquet(at)
            sent.destroy()
    discard(few)
    if n_blocks > 1:
        discard(asked)
        found = spark.read.schema(schema).parquet(at)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def columns(df: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Vectors and ids of some rows, on the driver."""
    got = df.select("vector", "id").toArrow()
    return tuple(pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type) for x in got.columns)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.filter(F.col("vec_id") % 100 == 0), rows)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as e from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
