r"""Near-duplicates by a chosen-path similarity join.

A document's set: the distinct `width`-word shingles of its words (A-Z lower-cased, `[^\x20\x09-\x0D]+`); with fewer words the whole
sequence is one shingle; without words the set is empty and linked with nothing. Documents are linked when 100 * intersection >=
percent * union, and components of links are the classes.

1. Equal sets become one node (its smallest doc_id), however many copies there are.
2. In each of `trees` independent trees every node starts on a path of minwise tokens, and at each step takes one more token as a
   branch, and in `SECOND` of all cases a second one as another; which, the path so far decides, alike for all nodes on it. Paths with
   few nodes are compared exhaustively, larger ones branch on, level by level, until they are small. A large path most of whose pairs are of one component
   is compared without these: its few other nodes against blocks of all. What is still large after `LEVELS` levels is compared
   as all pairs of blocks.
3. On a path, sketches of 64 minwise bytes pick pairs that may be linked; the groups of such pairs, the same from
   whichever tree, get the full sets, and every pair of a group is confirmed or refused on the sets.
4. A first round of `first` trees links most copies: it branches `depth` times at most, and then compares the blocks of a large path with one of them. The second round leaves out what
   is in one component already, and compares the rest. Links inside a component change nothing, so no class is lost by that.

Recall: a pair of similarity s that shares a path shares a branch of it with probability s, and a second one with SECOND * s. The trees
take their branches from the same 64 values and all paths of a level the same ones, so they aren't independent of each other: a pair that
happens to share few of the values is parted sooner in all trees. Simulated with that (4000 pairs each), the ten trees of the second
round part a pair of 0.85 within four levels in none of the cases and within twelve in 4 %, a pair of 0.80 in 0.2 % and 16 %. Paths are
that long only among thousands of documents that share most of their tokens and no component. On chains of template pages that hang
together by one link each, a test finds all links with nodes of 32. A sketch, the same for all trees, misses a pair at exactly `percent`
with a probability of at most MISS.

Null ids: such rows are in no class (component null) and are kept. Rows that repeat an id are one document; if their texts differ,
each text's set is its own but they share the id's class only by their sets. Null texts are empty. Ties go to the smallest
doc_id. Empty tables give empty tables; extra columns are ignored.

Scale: a signature row (280 bytes) per document is staged; paths move 8-byte keys; sketches and sets move only for nodes that share
a path with a node of another component, and stay where they are while the nodes are few enough to be broadcast. Texts are read again for those nodes alone. Branching multiplies the paths of documents that
differ less than it divides them, so template pages cost in proportion to their number. A group whose sets are large is confirmed pair
by pair. Tables of at most `BROADCAST_ROWS` rows of 16 to 24 bytes are broadcast, larger ones shuffled; the centres of large stars are dealt with apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, discard, give_back, pieces, raw, staged, table

WIDTH, PERCENT = 5, 85
TREES, FIRST, DEPTH = 12, 2, 4
#: The probability of a second branch, and the levels after which what is left is compared in blocks.
SECOND, LEVELS = 0.3, 16
#: Nodes of a path prefix that are compared at once; hash functions; the probability that a sketch refuses a pair at the threshold.
SMALL, HASHES, MISS = 1024, 64, 1e-5
AT_ONCE = 250_000
#: Rows of a table (two or three numbers each) that may be broadcast: some 10 MB.
BROADCAST_ROWS = 250_000
#: Half of the nodes of a job; shingles of a group beyond which it is confirmed pair by pair; share of all links from which a centre of a star counts as large.
JOB, GROUP_SHINGLES, LARGE_STAR = 512, 4_000_000, 0.001


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, salt: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def shingle_sets(texts: Iterable[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from xxhash import xxh3_64_intdigest

    factors, short = constants(width, 1), constants(width + 1, 2)

    def flush(words: list[bytes], ends: list[int]) -> Iterator[np.ndarray]:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        one = np.fromiter(map(xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        own = np.concatenate([one[coded.indices.to_numpy()] if words else np.zeros(0, np.uint64), np.zeros(width, np.uint64)])
        rolled = np.zeros(len(words) + 1, np.uint64)
        for k in range(width):
            rolled += own[k : k + len(words) + 1] * factors[k]
        rolled = mixed(rolled)
        start = 0
        for end in ends:
            n = end - start
            if n >= width:
                yield np.unique(rolled[start : end - width + 1])
            elif n:
                yield mixed((own[start:end] * factors[:n]).sum(keepdims=True) + short[n])
            else:
                yield np.zeros(0, np.uint64)
            start = end

    words: list[bytes] = []
    ends: list[int] = []
    for data in texts:
        for part in pieces((data or b"").translate(SPACED)):
            words += part.split()
        ends.append(len(words))
        if len(words) >= AT_ONCE:
            yield from flush(words, ends)
            words, ends = [], []
    yield from flush(words, ends)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums for each set."""
    out = [np.array([mixed(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in constants(2, 3)]
    return out[0], out[1]


SIGNED = "doc_id bigint, n_shingles bigint, a bigint, b bigint, signature binary"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, digests of the set, and HASHES minwise values of 4 bytes (null for an empty set)."""

    def run(batches):
        flip, times = constants(HASHES, 4), constants(HASHES, 5) | np.uint64(1)
        for batch in batches:
            ids, held = batch.column("doc_id"), []
            at = 0

            def out(held, at):
                sizes = np.array([len(s) for s in held], np.int64)
                a, b = digests(held)
                full, low = np.flatnonzero(sizes), np.zeros((len(held), HASHES), "<u4")
                if len(full):
                    joined, starts = np.concatenate(held), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for i in range(HASHES):
                        low[full, i] = np.minimum.reduceat((joined ^ flip[i]) * times[i], starts) >> np.uint64(32)
                signs = [low[k].tobytes() if n else None for k, n in enumerate(sizes)]
                return pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array(sizes), pa.array(a), pa.array(b), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "a", "b", "signature"])

            size = 0
            for s in shingle_sets(raw(batch.column("text")), width):
                held.append(s)
                size += len(s)
                if size >= AT_ONCE:
                    yield out(held, at)
                    at, held, size = at + len(held), [], 0
            if held:
                yield out(held, at)
        give_back()

    return docs.mapInArrow(run, SIGNED)


def branched(rows: DataFrame, level: int, trees: range | None = None) -> DataFrame:
    """The next branches of paths. rows: node, comp, signature and held, the trees and keys of the node's paths; back come node, comp, tree and the keys one token longer, a row a path. At the start rows have no paths, and go on in all of `trees`."""

    def run(batches):
        salt, roots, second = constants(HASHES, 6), constants(HASHES, 7), np.uint64(int(SECOND * 2**64))
        order: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            low = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u4").reshape(n, HASHES)
            held = None
            if trees is None:
                paths = b.column("held")
                owner, flat = np.repeat(np.arange(n), paths.value_lengths().to_numpy()), paths.flatten()
                held, keys = flat.field("tree").to_numpy(), flat.field("key").to_numpy().view(np.uint64)
            for t in trees or np.unique(held).tolist():
                at = np.arange(n) if held is None else owner[held == t]
                key = np.full(n, roots[t]) if held is None else keys[held == t]
                pick = order.setdefault(t, np.argsort(constants(HASHES, 100 + t)))
                for k in (0, 1):
                    use = np.arange(len(at)) if k == 0 else np.flatnonzero(mixed(key ^ salt[level % HASHES]) < second)
                    if len(use):
                        grown = mixed(key[use] + low[at[use], pick[(2 * level + k) % HASHES]] * np.uint64(0x9E3779B97F4A7C15) + salt[k])
                        own = pa.array(at[use])
                        yield pa.RecordBatch.from_arrays([b.column("node").take(own), b.column("comp").take(own), pa.array(np.full(len(use), t, np.int32)), pa.array(grown.view(np.int64))], names=["node", "comp", "tree", "key"])

    names = ["node", "comp", "signature"] if trees else ["node", "comp", "held", "signature"]
    return rows.select(*names).mapInArrow(run, "node bigint, comp bigint, tree int, key bigint")


def signed_again(paths: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """n paths (node, comp, tree, key) as a row a node with its signature. A node has at most trees * (1 + SECOND) ^ level paths, but for chance."""
    own = paths.groupBy("node", "comp").agg(F.collect_list(F.struct("tree", "key")).alias("held"))
    return joined(nodes.select(F.col("node").alias("of"), "signature"), own, F.col("node") == F.col("of"), n=n)


def joined(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", n: int | None = None) -> DataFrame:
    """A join that broadcasts the right side when its rows (n at most, else they are counted) are few; else Spark shuffles, and splits what is skewed."""
    n = right.limit(BROADCAST_ROWS + 1).count() if n is None else n
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("merge"), on, how)


def in_blocks(rows: DataFrame, m: Column) -> DataFrame:
    """Rows with the number of blocks of less than half of SMALL, but for chance, and their own."""
    n = F.ceil(m * 2.5 / SMALL)
    return rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), n))


def shared_paths(nodes: DataFrame, comps: DataFrame | None, trees: range, depth: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """key, node, comp: bounded groups of more than one component that share a path; and the staged tables that they are read from.

    comps: node and comp of what is linked already, in the second round.
    """
    starts = nodes.select("node", F.col("node").alias("comp"), "signature")
    if comps is not None:
        known = comps.select(F.col("node").alias("known"), F.col("comp").alias("known_comp"))
        starts = joined(nodes.select("node", "signature"), known, F.col("node") == F.col("known"), "left").select("node", F.coalesce("known_comp", "node").alias("comp"), "signature")
    now, out, held = starts, [], []
    for level in range(LEVELS + 1):
        now = branched(now, level, None if level else trees)
        sizes = now.groupBy(F.col("key").alias("own")).agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter((F.col("m") > 1) & (F.col("low") != F.col("high"))).select("own", "m")
        sizes = staged(sizes, f"sizes{level}")
        met = staged(joined(now, sizes, F.col("key") == F.col("own")).drop("own"), f"paths{level}")
        discard(sizes)
        held.append(met)
        out.append(met.filter(F.col("m") <= SMALL).select("key", "node", "comp"))
        large = met.filter(F.col("m") > SMALL)
        n = large.count()
        if not n:
            break
        blocked = in_blocks(large, F.col("m"))
        if comps is None and level + 1 >= depth or level == LEVELS:
            # The first round: each block with one of them. The end of all levels: all pairs of blocks.
            every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
            others = every if comps is not None else F.when(F.col("block") == 0, every).otherwise(F.array(F.lit(0).cast("bigint")))
            pairs = blocked.select("node", "comp", "key", "block", F.explode(others).alias("other"))
            out.append(pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "comp"))
            break
        if comps is None:  # nothing is linked yet, so no path is lopsided
            now = signed_again(large, nodes, n)
            continue
        # Paths where few pairs are of different components: those of the largest in blocks, the others with each block.
        parts = large.groupBy(F.col("key").alias("own"), "comp").agg(F.count(F.lit(1)).cast("double").alias("n"))
        parts = parts.groupBy("own").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max(F.struct("n", "comp"))["comp"].alias("main"))
        parts = staged(parts.filter(F.col("all") * F.col("all") - F.col("same") <= 2 * SMALL * F.col("all")).select("own", "main"), f"main{level}")
        held.append(parts)
        lopsided = joined(blocked, parts, F.col("key") == F.col("own"), n=n // SMALL)
        every = F.when(F.col("m") <= 4 * SMALL, F.array(F.lit(0).cast("bigint"))).when(F.col("comp") == F.col("main"), F.array("block")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
        out.append(lopsided.select("node", "comp", "key", F.explode(every).alias("at")).select(F.xxhash64("key", "at").alias("key"), "node", "comp"))
        rest = joined(large, parts, F.col("key") == F.col("own"), "left_anti", n // SMALL)
        now = signed_again(rest, nodes, n)
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    return got, held


def grouped(batches, key: str) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of one key after another, from batches sorted by it."""
    now, rows = None, {}
    for b in batches:
        keys = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            part = b.slice(s, e - s)
            if rows and keys[s] == now:
                for c in rows:
                    rows[c] += part.column(c).to_pylist()
                continue
            if rows:
                yield now, rows
            now, rows = keys[s], {c: part.column(c).to_pylist() for c in b.schema.names}
    if rows:
        yield now, rows


def roots(n: int, linked: Iterator[tuple[int, int]]) -> list[int]:
    """The smallest member of each one's class, for classes of the linked."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in linked:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def plausible(percent: int) -> int:
    """Equal sketch bytes that make a pair plausible: a pair at `percent` has fewer with a probability of at most MISS."""
    p = percent / 100 + (1 - percent / 100) / 256
    missed = 0.0
    for k in range(HASHES):
        missed += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if missed > MISS:
            return k
    return HASHES


def plausible_groups(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """job, node, comp: classes of nodes whose sketches may be linked across components; one job for the same class from any tree. A large class is several jobs, and of one with many shingles each such pair is a job."""
    enough = plausible(percent)

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for _, g in grouped(batches, "key"):
            first = {x: i for i, x in reversed([*enumerate(g["node"])])}
            node = np.array(sorted(first), np.int64)
            at = [first[x] for x in node.tolist()]
            comp = np.array([g["comp"][i] for i in at], np.int64)
            sketch = np.frombuffer(b"".join(g["signature"][i] for i in at), "<u4").reshape(len(node), HASHES).astype(np.uint8)
            size = np.array([g["n_shingles"][i] for i in at], np.int64)
            jobs, who = [], []
            pairs: list[tuple[int, int]] = []
            for i in range(len(node) - 1):
                same = (sketch[i + 1 :] == sketch[i]).sum(1)
                pairs += [(i, i + 1 + j) for j in np.flatnonzero((same >= enough) & (comp[i + 1 :] != comp[i])).tolist()]
            if not pairs:
                continue
            root = np.array(roots(len(node), iter(pairs)))
            for r in np.unique(root):
                own = np.flatnonzero(root == r)
                if len(own) > 2 and size[own].sum() > GROUP_SHINGLES:
                    for i, j in pairs:
                        if root[i] == r:
                            jobs += [xxh3_64_intdigest(node[[i, j]].tobytes()) - (1 << 63)] * 2
                            who += [i, j]
                elif len(own) > 2 * JOB:  # blocks of it, two by two where a pair asks for it
                    block = np.zeros(len(node), np.int64)
                    block[own] = np.arange(len(own)) // JOB
                    for p, q in sorted({(block[i], block[j]) for i, j in pairs if root[i] == r}):
                        both = own[(block[own] == p) | (block[own] == q)]
                        jobs += [xxh3_64_intdigest(node[both].tobytes()) - (1 << 63)] * len(both)
                        who += both.tolist()
                elif len(own) > 1:
                    jobs += [xxh3_64_intdigest(node[own].tobytes()) - (1 << 63)] * len(own)
                    who += own.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(node[who]), pa.array(comp[who])], names=["job", "node", "comp"])

    carried = joined(nodes.select(F.col("node").alias("own"), "signature", "n_shingles"), members, F.col("node") == F.col("own")).drop("own")
    found = carried.repartition("key").sortWithinPartitions("key").mapInArrow(run, "job bigint, node bigint, comp bigint")
    return found.groupBy("job", "node").agg(F.min("comp").alias("comp"))


def linked_pairs(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """All pairs of sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    token, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of, shared = np.repeat(np.arange(len(sets)), sizes), np.flatnonzero(n > 1)
    number = np.full(len(token), -1)
    number[shared] = np.arange(len(shared))
    column = number[where]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    both = np.zeros((len(sets), len(sets)), np.float32 if len(shared) < 1 << 24 else np.float64)
    for a in range(0, len(shared), 4096):
        s, e = np.searchsorted(column, [a, a + 4096])
        x = np.zeros((len(sets), min(4096, len(shared) - a)), np.float32)
        x[of[s:e], column[s:e] - a] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    ok = np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
    return zip(*(x.tolist() for x in np.nonzero(ok)), strict=True)


def confirmed(jobs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """u, v: for each class of confirmed links inside a job, its members and the smallest of them; and the staged table it is read from."""
    n = jobs.count()
    asked = staged(joined(nodes.select("node", "a", "b"), jobs.select(F.col("node").alias("asked")).distinct(), F.col("node") == F.col("asked"), n=n).select("node", "a", "b"), "asked")

    def sets(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [*shingle_sets(raw(part.column("text")), width)]
                a, b = digests(got)
                ok = np.flatnonzero((a == part.column("a").to_numpy()) & (b == part.column("b").to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(ok)), pa.array([got[i].tobytes() for i in ok], pa.binary())], names=["of", "tokens"])

    def links(batches):
        for _, g in grouped(batches, "job"):
            first = {x: i for i, x in reversed([*enumerate(g["node"])])}
            node = sorted(first)
            root = roots(len(node), linked_pairs([np.frombuffer(g["tokens"][first[x]], np.uint64) for x in node], percent))
            pairs = [(x, node[r]) for x, r in zip(node, root, strict=True) if x != node[r]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["u", "v"])

    texts = joined(docs, asked, F.col("doc_id") == F.col("node"), n=n).select("node", "a", "b", "text")
    full = texts.mapInArrow(sets, "of bigint, tokens binary")
    return joined(full, jobs, F.col("node") == F.col("of"), n=n).select("job", "node", "tokens").repartition("job").sortWithinPartitions("job").mapInArrow(links, "u bigint, v bigint"), asked


def beside_least(edges: DataFrame, n: int) -> DataFrame:
    """Links u, v, and low: the smallest v of each u. Where n links, all there are, are many, centres with LARGE_STAR or more of them, at most 1 / LARGE_STAR, are broadcast, and the others meet theirs in a shuffle."""
    if n <= BROADCAST_ROWS:
        return edges.join(F.broadcast(edges.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("low"))), F.col("u") == F.col("hub")).select("u", "v", "low")
    least = staged(edges.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("links")), "hubs")
    large = F.col("links") >= max(64, LARGE_STAR * n)
    wide = F.broadcast(least.filter(large).select(F.col("hub").alias("wide"), F.col("low").alias("wide_low")))
    at = edges.join(wide, F.col("u") == F.col("wide"), "left")
    light = at.filter("wide is null").select("u", "v").join(least.filter(~large).hint("merge"), F.col("u") == F.col("hub")).select("u", "v", "low")
    out = staged(light.unionByName(at.filter("wide is not null").select("u", "v", F.col("wide_low").alias("low"))), "stars")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for all nodes of edges, by alternating large and small stars."""
    now, before = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            out.staged_at = now.staged_at
            return out
        before = state
        both = beside_least(now.union(now.select("v", "u")), 2 * state[0])
        large = staged(both.filter("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).filter("u <> v").distinct(), "large")
        small = beside_least(large, state[0])
        new = staged(small.select("u", F.col("low").alias("v")).union(small.select(F.col("v").alias("u"), F.col("low").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(now, both, large, small)
        now = new


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, trees: int = TREES, first: int = FIRST, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(signatures(own, width), "signatures")
    full = signed.filter("doc_id is not null and n_shingles > 0")
    nodes = staged(full.groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles")), "nodes")
    edges = known = None
    for some in (range(first), range(first, trees)):
        groups, read = shared_paths(nodes, known, some, depth)
        jobs = staged(plausible_groups(groups, nodes, percent), "jobs")
        discard(*read)
        links, asked = confirmed(jobs, own, nodes, width, percent)
        found = staged(links, "links")
        new = components(found if known is None else known.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(found))
        discard(jobs, asked, found, known)
        known = new
    of = joined(nodes, known.select(F.col("node").alias("known"), "comp"), F.col("node") == F.col("known"), "left").select(F.col("a").alias("own_a"), F.col("b").alias("own_b"), F.coalesce("comp", "node").alias("class"))
    of = staged(of, "classes")
    discard(nodes, known)
    placed = signed.join(of, (F.col("a") == F.col("own_a")) & (F.col("b") == F.col("own_b")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("class", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns."""
    gone = staged(near_duplicates(docs, id_col=id_col, **options).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return joined(docs, gone, docs[id_col].cast("long") == gone["gone"], "left_anti")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') as sh
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e(x, y) as (select x, y from l union all select y, x from l),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.y from r join e on r.other = e.x),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join m using (doc_id)
"""
