"""Proximity graphs: an alpha-pruned graph a shard, and beam search through all shards.

A shard is what one task holds: rows are dealt out evenly, so no key makes one larger than another. Equal vectors are one node with all
their ids. A node is linked to near ones and some random ones; of these a candidate stays unless a link chosen before it is `alpha` times
nearer to it than the node is. Links are also taken backwards and pruned again, and what cannot be reached from the start (the node
nearest to the mean) gets a link from the nearest node that can.

A graph is one row of a table: a search is one pass over the rows without a shuffle, a broadcast block of queries meets each graph, and
a task sends k neighbours a query and graph. The beam holds the `l_search` nearest nodes met so far; each step reads the links of the
nearest one not read yet. Vectors that take no part in searches (see search.py) are left out, and so are rows with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IndexConfigurationError, SearchError
from ..functions import vectors as V
from .search import QUERY_BLOCK, _searched, arrays, distances, ranked

DEGREE, ALPHA, NEAR, RANDOM = 32, 1.2, 96, 16
#: Numbers that the vectors of a shard hold at most: 16 MB as doubles.
SHARD_NUMBERS = 1 << 21
#: Queries that walk through a graph together.
TOGETHER = 256
GRAPH = "width int, degree int, ids array<bigint>, first array<int>, vectors array<double>, links array<int>"


def _squares(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * (x @ m.T), 0)


def nearest_lists(m: np.ndarray, count: int) -> np.ndarray:
    """For each row the places of about its `count` nearest others, itself perhaps among them."""
    out, count = np.zeros((len(m), count), np.int64), min(count, len(m))
    step = max(16, 2**22 // len(m))
    for a in range(0, len(m), step):
        out[a : a + step, :count] = np.argpartition(_squares(m[a : a + step], m), count - 1, axis=1)[:, :count]
    return out


def pruned(m: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most `degree` links of each node, out of its candidates (-1: none); -1 where there are fewer."""
    out = np.full((len(nodes), degree), -1, np.int64)
    step = max(1, 2**21 // (candidates.shape[1] * max(candidates.shape[1], m.shape[1])))
    for a in range(0, len(nodes), step):
        own, cand = nodes[a : a + step], candidates[a : a + step]
        away = ((m[cand] - m[own][:, None]) ** 2).sum(2)
        away[(cand < 0) | (cand == own[:, None])] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        cand, away = np.take_along_axis(cand, order, 1), np.take_along_axis(away, order, 1)
        x = m[cand]
        norm = (x * x).sum(2)
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)
        alive, rows = np.isfinite(away), np.arange(len(own))
        for s in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            best = alive.argmax(1)
            out[a + rows[some], s] = cand[rows, best][some]
            # A repeated candidate is at distance 0 from the first, so it goes as well.
            alive &= ~((alpha * alpha * between[rows, best] <= away) | (cand == cand[rows, best][:, None]))
    return out


def reached(links: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> None:
    """Mark what can be reached."""
    seen[starts] = True
    while len(starts):
        ahead = np.unique(links[starts])
        starts = ahead[(ahead >= 0) & ~seen[ahead]]
        seen[starts] = True


def graph_of(m: np.ndarray, *, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 0) -> np.ndarray:
    """The links of nodes with different vectors, node 0 being the start; -1 fills rows."""
    n = len(m)
    random = np.random.default_rng(seed).integers(0, n, (n, min(RANDOM, n)))
    every = np.arange(n)
    links = pruned(m, every, np.concatenate([nearest_lists(m, min(NEAR, n)), random], 1), alpha, degree)
    # The same links backwards: of each node the first 2 * degree in order of distance.
    to, of = links.reshape(-1), np.repeat(every, degree)
    of, to = of[to >= 0], to[to >= 0]
    order = np.lexsort((((m[of] - m[to]) ** 2).sum(1), to))
    of, to = of[order], to[order]
    turn = np.arange(len(to)) - np.searchsorted(to, to)
    back = np.full((n, 2 * degree), -1, np.int64)
    back[to[turn < 2 * degree], turn[turn < 2 * degree]] = of[turn < 2 * degree]
    links = pruned(m, every, np.concatenate([links, back], 1), alpha, degree)
    seen = np.zeros(n, bool)
    reached(links, np.zeros(1, np.int64), seen)
    room = np.concatenate([links, np.full((n, degree), -1, np.int64)], 1)
    used = (room >= 0).sum(1)
    while not seen.all():
        lost = int(np.argmin(seen))
        able = np.flatnonzero(seen & (used < 2 * degree))
        host = able[np.argmin(((m[able] - m[lost]) ** 2).sum(1))]
        room[host, used[host]] = lost
        used[host] += 1
        reached(room, np.array([lost]), seen)
    return room[:, : used.max()]


def build_graphs(rows: DataFrame, metric: str = "l2", *, id_col: str = "id", vector: str = "embedding", dimension: int | None = None, degree: int = DEGREE, alpha: float = ALPHA, shard_numbers: int = SHARD_NUMBERS) -> DataFrame:
    """One row a shard. An empty table gives none. Stage or write the result: it is built anew whenever it is read."""
    if metric not in ("l2", "cosine"):
        raise IndexConfigurationError(f"graphs are built for l2 and cosine, not for {metric!r}")
    held = rows.select(F.col(id_col).cast("long").alias("id"), V.doubles(vector).alias("v")).dropna()
    total, widest = held.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards = max(1, -(-total * (dimension or widest) // shard_numbers))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for b in batches:
            ok, m = arrays(b, dimension)
            ids.append(b.column("id").to_numpy()[ok])
            parts.append(m)
        if not sum(map(len, ids)):
            return
        if len({p.shape[1] for p in parts if len(p)}) > 1:
            raise SearchError("vectors differ in width")
        ids, m = np.concatenate(ids), np.concatenate([p for p in parts if len(p)])
        if metric == "cosine":
            m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), V.LEAST_NORM)
        m, node = np.unique(m, axis=0, return_inverse=True)
        start = int(np.argmin(((m - m.mean(0)) ** 2).sum(1)))
        turn = np.concatenate([[start], np.delete(np.arange(len(m)), start)])
        place = np.empty(len(m), np.int64)
        place[turn] = np.arange(len(m))
        m, node = m[turn], place[node.reshape(-1)]
        order = np.lexsort((ids, node))
        first = np.searchsorted(node[order], np.arange(len(m) + 1))
        links = graph_of(m, degree=degree, alpha=alpha)
        row = [[m.shape[1]], [links.shape[1]], [ids[order]], [first.astype(np.int32)], [m.reshape(-1)], [links.reshape(-1).astype(np.int32)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32())), strict=True)], names=[x.split()[0] for x in GRAPH.split(", ")])

    return held.repartition(shards).mapInArrow(build, GRAPH)


def beam_search(m: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of each query's beam, nearest first (-1: none), how many nodes' links it read, and to how many vectors it was compared."""
    n, rows = len(m), np.arange(len(q))
    held, away, done = np.full((len(q), beam), -1), np.full((len(q), beam), np.inf), np.ones((len(q), beam), bool)
    seen, read, met = np.zeros((len(q), n), bool), np.zeros(len(q), np.int64), np.ones(len(q), np.int64)
    held[:, 0], away[:, 0], done[:, 0], seen[:, 0] = 0, ((q - m[0]) ** 2).sum(1), False, True
    while len(rows := np.flatnonzero(~done.all(1))):
        at = (~done[rows]).argmax(1)
        near = links[held[rows, at]]
        done[rows, at] = True
        read[rows] += 1
        new = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        seen[rows[r], near[r, c]] = True
        met[rows] += new.sum(1)
        d = np.full(near.shape, np.inf)
        d[r, c] = ((m[near[r, c]] - q[rows[r]]) ** 2).sum(1)
        every = np.concatenate([away[rows], d], 1)
        best = np.argsort(every, axis=1, kind="stable")[:, :beam]
        away[rows] = np.take_along_axis(every, best, 1)
        held[rows] = np.where(np.isfinite(away[rows]), np.take_along_axis(np.concatenate([held[rows], near], 1), best, 1), -1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~new], 1), best, 1) | (held[rows] < 0)
    return held, read, met


def graph_candidates(queries: DataFrame, graphs: DataFrame, k: int, l_search: int, metric: str = "l2", *, query_id: str = "query_cell_id", query_vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """q, n, d, graph, read, met: what the beams of each graph hold for each query, the k nearest at most; read and met are those of a query in a graph."""
    if l_search < k:
        raise IndexConfigurationError("l_search must be at least the number of neighbours")
    asked = queries.select(F.col(query_id).alias("id"), V.doubles(query_vector).alias("v"))
    kind = asked.schema["id"].dataType.simpleString()

    def scan(names: pa.Array, q: np.ndarray) -> tuple[DataFrame, Broadcast]:
        sent = queries.sparkSession.sparkContext.broadcast((names, q))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for b in batches:
                for g in range(b.num_rows if len(q) else 0):
                    width, degree = b.column("width")[g].as_py(), b.column("degree")[g].as_py()
                    if width != q.shape[1]:
                        raise SearchError(f"a vector does not have {width} components")
                    ids, first, flat, links = (b.column(c)[g].values.to_numpy() for c in ("ids", "first", "vectors", "links"))
                    m, links = flat.reshape(-1, width), links.reshape(-1, degree).astype(np.int64)
                    mark = int(ids[0])
                    for a in range(0, len(q), TOGETHER):
                        part = q[a : a + TOGETHER]
                        unit = part / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), V.LEAST_NORM) if metric == "cosine" else part
                        held, read, met = beam_search(m, links, unit, min(l_search, len(m)))
                        out: list[list] = [[], [], [], [], [], []]
                        for r in range(len(part)):
                            nodes = held[r][held[r] >= 0]
                            d = distances(metric, part[r], m[nodes])
                            best = sorted((x, int(i)) for x, p in zip(d.tolist(), nodes.tolist(), strict=True) for i in ids[first[p] : first[p + 1]][:k])[:k]
                            for held_col, values in zip(out, ([a + r] * len(best), [i for _, i in best], [x for x, _ in best], [mark] * len(best), [int(read[r])] * len(best), [int(met[r])] * len(best)), strict=True):
                                held_col += values
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), *(pa.array(x, pa.int64()) for x in out[3:])], names=["q", "n", "d", "graph", "read", "met"])

        return graphs.mapInArrow(walk, f"q {kind}, n bigint, d double, graph bigint, read bigint, met bigint"), sent

    return _searched(asked, scan, query_block)


def graph_neighbours(queries: DataFrame, graphs: DataFrame, k: int, l_search: int, metric: str = "l2", *, query_id: str = "query_cell_id", index_id: str = "cas_cell_index", **options) -> DataFrame:
    """query id, rank (from 1), index id and distance of the k nearest rows that the beams met; ties to the smaller id."""
    found = graph_candidates(queries, graphs, k, l_search, metric, query_id=query_id, **options)
    return ranked(found.select(F.col("q").alias(query_id), F.col("n").alias(index_id), F.col("d").alias("distance")), k, query_id=query_id, index_id=index_id)


def visits(candidates: DataFrame) -> DataFrame:
    """q, read, met: over all graphs, the nodes whose links a query has read, and the vectors that it was compared to."""
    each = candidates.groupBy("q", "graph").agg(F.max("read").alias("read"), F.max("met").alias("met"))
    return each.groupBy("q").agg(F.sum("read").alias("read"), F.sum("met").alias("met"))
