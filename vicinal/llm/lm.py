r"""LM scoring with a probabilistic suffix tree over words.

Tokens: A-Z lower-cased, words `[^\x20\x09-\x0D]+`, then one end. Root: the add-one unigram (c + 1) / (N + V + 1), where one class
stands for all unknown words. A context s is the last 1 to `depth` words, seen `least_context` times or more in the training texts;
n(s) is how often, and the next symbols seen `least_pair` times or more after it are listed, L of them with C occurrences.

Divergence test: s is kept when its listed symbols gain `gain` nats each, or more, against the state of its suffix:
sum of c(s,w) ln((c(s,w) - 1 - D) / P(w | suffix)) - C ln n(s) + rest ln(rest / n(s)) >= gain * L, where rest = n(s) - C + D L. Each
occurrence is so judged by the others; P(w | suffix) enters in steps of half a bit.

Smoothing: P(w | s) = (max(c(s,w) - D, 0) + (rest + K) P(w | suffix)) / (n(s) + K), with c(s,w) = 0 where w is not listed; it sums to 1
over the vocabulary and the unknown class. A token is scored by the longest kept suffix of what precedes it in its text. All
bounds are numbers of occurrences, the same for any corpus, so contexts, symbols and what is shuffled grow with it.

Training rows are those whose crc32(doc_id as text) mod 7 is not 2. Null or empty texts are the end alone. Rows that repeat, or share an
id, are scored each for itself. Without training rows N is 0 and every token is unknown. Empty tables give empty tables; extra
columns are ignored. Words are told apart by hashes of 64 bits, contexts of two words or more by numbers of their own.

Scale: no table of words or contexts is ever whole in one place. Texts become chunks of about `CHUNK` tokens, written once, bucketed by
chunk; hashes of words go after the first level. A level is a question and an answer: each chunk sends its distinct pairs (context, symbol) with their counts, packed, to the
buckets of their contexts; a bucket of about `BUCKET` tokens adds them up, tests its contexts, and answers each chunk in the
order it was asked. Words get numbers with the first answer, frequent ones small numbers, which is what later levels send. Listed pairs get
numbers with theirs, in the order of their bucket, and are the contexts of the next level: numbers in order cost a byte or two each. A pair whose shorter
form is not listed cannot be, so it is asked for as "other". Answers are shuffled to their chunks once, and bucketed alike, so that levels are
read side by side and no text moves. A context with `HOT` or more of all tokens is dealt out by symbol to `SALTS` parts;
there are at most 1 / HOT of them a level, so the driver adds up their parts and broadcasts the sums. A text longer than a chunk
is several, each led by the words that precede it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, discard, fold, give_back, new_path, pieces, raw, remove, staged, table, write

FOLDS, HELD_OUT = 7, 2
DEPTH = 3
LEAST_CONTEXT, LEAST_PAIR = 2, 2
GAIN, K, D = 2.0, 1.0, 0.75
#: Tokens of a chunk, and for each bucket of pairs.
CHUNK, BUCKET = 750_000, 1_500_000
#: Share of all tokens from which a context is dealt out to parts, and the parts.
HOT, SALTS = 0.001, 64
#: Steps of ln P in the divergence test: half a bit, up to 255 of them.
STEP = math.log(2) / 2
#: The end of a text as a word; no word holds a space.
END = b" "


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of x, all below `limit`, in order; for each of x its place among them, and for each of them a place in x."""
    bits = max(1, len(x)).bit_length()
    if limit.bit_length() + bits > 63:
        key, first, place = np.unique(x, return_index=True, return_inverse=True)
        return key, place, first
    both = np.sort((x << bits) | np.arange(len(x)))  # numbers with their places: sorting values is far cheaper than sorting places by them
    at, both = both & ((1 << bits) - 1), both >> bits
    new = np.append(True, both[1:] != both[:-1])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[at] = np.cumsum(new) - 1
    return both[new], place, at[new]


def packed(x: np.ndarray) -> bytes:
    """Numbers by their bytes, the lowest of all first, so that leading zeros cost nothing; compressed."""
    planes = np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


# Chunks


def in_texts(ends: list[int], leads: list[int], held: list[bool]) -> tuple[np.ndarray, ...]:
    """Where the segments of a chunk start, and by token: words before it in its segment, whether it is its segment's own, and whether it is trained on."""
    ends = np.array(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    depth = (np.arange(size.sum()) - np.repeat(starts, size)).astype(np.int32)
    active = depth >= np.repeat(np.array(leads, np.int64), size)
    return starts, depth, active, ~np.repeat(np.array(held, bool), size) & active


def chunks(docs: DataFrame, depth: int) -> DataFrame:
    """docs (pid, row, doc_id, held_out, text) as chunks of two rows: distinct hashes of words in order and their counts, for the first question alone, and for all
    that follow tokens as places among them and the segments of texts. Places are by class of frequency and then by hash: small numbers are frequent, and classes say the order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk bigint, n_tokens bigint, tokens binary, classes binary, hashes binary, times binary, rows array<bigint>, ids array<{kind}>, held array<boolean>, ends array<int>, leads array<int>, words boolean"

    def run(batches):
        from xxhash import xxh3_64_intdigest

        number, id_type = 0, None
        words: list[bytes] = []
        segments: list[tuple] = []  # row, id, held out, end, words that only lead

        def flush() -> pa.RecordBatch:
            nonlocal words, segments, number
            coded = pa.array(words, pa.binary()).dictionary_encode()
            hashes = np.fromiter(map(xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            hashed = np.argsort(hashes)
            place = np.empty(len(hashed), np.int32)
            place[hashed] = np.arange(len(hashed))
            codes = place[coded.indices.to_numpy()]
            classes = np.log2(np.bincount(codes)).astype(np.uint8)
            place[by_class(classes)] = np.arange(len(classes))
            row, ids, held, ends, leads = ([*x] for x in zip(*segments, strict=True))
            times = np.bincount(codes, weights=in_texts(ends, leads, held)[-1]).astype(np.uint32)
            chunk, text, of_words = (pid << 32) + number, (len(codes), packed(place[codes].view(np.uint32)), packed(classes)), (packed(np.diff(hashes[hashed], prepend=np.uint64(0))), packed(times))
            two = [(chunk, *text, None, None, row, ids, held, ends, leads, False), (chunk, None, None, None, *of_words, *[None] * 5, True)]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, *(pa.list_(t) for t in (pa.int64(), id_type, pa.bool_(), pa.int32(), pa.int32())), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*two, strict=True), kinds, strict=True)], names=["chunk", "n_tokens", "tokens", "classes", "hashes", "times", "rows", "ids", "held", "ends", "leads", "words"])
            number, words, segments = number + 1, [], []
            return out

        for b in batches:
            id_type, pid = b.schema.field("doc_id").type, b.column("pid")[0].as_py() if b.num_rows else 0
            for row, doc, held, data in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), raw(b.column("text")), strict=True):
                lead = 0
                for part in pieces((data or b"").translate(SPACED)):
                    own = part.split()
                    while len(words) + len(own) > 2 * CHUNK:
                        take = 2 * CHUNK - len(words)
                        words += own[:take]
                        own, before = own[take:], words[-depth:]
                        segments.append((row, doc, held, len(words), lead))
                        yield flush()
                        words, lead = [*before], len(before)
                    words += own
                words.append(END)
                segments.append((row, doc, held, len(words), lead))
                if len(words) >= CHUNK:
                    yield flush()
        if segments:
            yield flush()
        give_back()

    return docs.mapInArrow(run, schema)


def by_class(classes: np.ndarray) -> np.ndarray:
    """The order of words by class, large ones first, from their classes in the order of their hashes."""
    return np.argsort(-classes.astype(np.int8), kind="stable")


def in_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash of 64 bits, by its highest."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def numbered(ranks: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers over all buckets, from 1, of what has these ranks in one."""
    return ranks.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)


def routed(numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts by their numbers, the buckets that they are asked of, and what they are called there: by ranks, which are dense. Those of one rank go to different buckets."""
    ranks, made_in = np.divmod(numbers - np.uint64(1), np.uint64(buckets))
    return (ranks + made_in) % np.uint64(buckets), ranks * np.uint64(2)


def routed_parts(parts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts of hot contexts, by place * SALTS + part; what these are called is odd."""
    return mixed(parts.astype(np.uint64)) % np.uint64(buckets), parts.astype(np.uint64) * np.uint64(2) + np.uint64(1)


def asked_words(row: dict, buckets: int) -> tuple[np.ndarray, ...]:
    """What a chunk asks for at level 0: its words, in order of their hashes."""
    hashes, times = np.cumsum(unpacked(row["hashes"], "u8"), dtype=np.uint64), unpacked(row["times"], "u4")
    none = np.zeros(len(hashes), np.uint64)
    return in_bucket(hashes, buckets), hashes, none, times, none.astype(np.uint8)


class Levels:
    """A chunk level by level: what it asks for, and what the answers so far make of it."""

    def __init__(self, row: dict, n: int, v: int, buckets: int, hot: list[np.ndarray], known: list[dict[str, np.ndarray]], least_context: int):
        self.tokens = by_class(unpacked(row["classes"], "u1")).astype(np.int32)[unpacked(row["tokens"], "u4")]
        self.n, self.v, self.buckets, self.hot, self.known, self.least = n, v, buckets, hot, known, least_context
        self.starts, self.depth, self.active, self.trained = in_texts(row["ends"], row["leads"], row["held"])
        self.level = 0

    def take_words(self, counts: np.ndarray, numbers: np.ndarray) -> None:
        """The answer to asked_words(): the root's probabilities, and words as symbols and as contexts by their numbers."""
        order = np.argsort(numbers)  # so that pairs of a context are in the order that their bucket has
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.tokens = place[self.tokens]
        count, self.symbols = counts.astype(np.int64)[order], numbers[order]
        self.count = count[self.tokens]
        self.seen = self.count > 0
        self.root = (self.count + 1) / (self.n + self.v + 1)
        self.p = self.root.copy()
        self.gram, self.totals = np.where(count >= max(self.least, LEAST_PAIR), np.arange(len(count)), -1)[self.tokens], count
        self.next = self.symbols

    def ask(self, replayed: bool = False) -> tuple[np.ndarray, ...] | None:
        """Contexts, symbols, counts and suffix probabilities of the next level's distinct pairs, in order of context; none where the answer is here already."""
        self.level += 1
        context = np.full(len(self.tokens), -1, np.int64)
        context[1:] = self.gram[:-1]
        context[self.depth < self.level] = -1
        real, grams, told = self.count >= LEAST_PAIR, len(self.next), self.hot[self.level - 1]
        hot = np.zeros(0, np.int64)
        if len(told):
            near = told[np.minimum(np.searchsorted(told, self.next), len(told) - 1)]
            hot = np.flatnonzero(near == self.next)
        self.hot_here = np.zeros(grams + 1, bool)  # the last one is for tokens without a context
        self.hot_here[hot] = True
        is_hot = self.hot_here[context]
        self.at = np.flatnonzero((context >= 0) & (real | ~is_hot))
        self.hot_at = np.flatnonzero(is_hot)
        self.hot_context = context[self.hot_at]
        part = context[self.at]
        symbol = np.where(real[self.at], self.tokens[self.at] + 1, 0)
        # Contexts, and the parts of hot ones, get ranks in the order in which they are sent, so that one sort of their pairs is enough.
        if len(hot):
            place = np.zeros(grams, np.int64)
            place[hot] = np.arange(len(hot))
            salted = np.flatnonzero(self.hot_here[part])
            part[salted] = grams + place[part[salted]] * SALTS + (self.symbols[symbol[salted] - 1] % np.uint64(SALTS)).astype(np.int64)
        there = np.zeros(grams + len(hot) * SALTS, bool)
        there[part] = True
        ids = np.flatnonzero(there)
        plain = np.searchsorted(ids, grams)
        of = np.concatenate([ids[:plain], hot[(ids[plain:] - grams) // SALTS]])
        parts = np.searchsorted(told, self.next[of[plain:]]) * SALTS + (ids[plain:] - grams) % SALTS
        bucket, name = (np.concatenate(x) for x in zip(routed(self.next[of[:plain]], self.buckets), routed_parts(parts, self.buckets), strict=True))
        order = np.lexsort((name, bucket))
        rank = np.zeros(len(there), np.int64)
        rank[ids[order]] = np.arange(len(order))
        bits = len(self.symbols).bit_length()
        key, self.pair, first = distinct((rank[part] << bits) | symbol, max(1, len(order)) << bits)
        self.key_rank = key >> bits  # the place of a pair's context among those that are sent
        at, w = order[self.key_rank], key & ((1 << bits) - 1)
        self.key_context, self.key_symbol = of[at], np.append(self.symbols, np.uint64(0))[w - 1]
        if replayed:
            return None
        steps = np.where(w > 0, np.clip(np.rint(-np.log(self.p[self.at[first]]) / STEP), 0, 255), 0).astype(np.uint8)
        times = np.bincount(self.pair, weights=self.trained[self.at], minlength=len(key)).astype(np.uint32)
        return bucket[at], name[at], self.key_symbol, times, steps

    def take(self, counts: np.ndarray, numbers: np.ndarray, kept: np.ndarray, listed: np.ndarray, mass: np.ndarray, last: bool = False) -> None:
        """The answer to ask(): counts of the pairs, numbers of those that are listed, and by pair what its context is. last: no level follows."""
        counts = counts.astype(np.int64)
        size, totals = len(self.tokens), self.totals[self.key_context]
        self.count = np.zeros(size, np.int64)
        self.count[self.at] = counts[self.pair]
        use = np.flatnonzero((kept.astype(bool) & ~self.hot_here[self.key_context])[self.pair])
        pair, use = self.pair[use], self.at[use]
        rest = totals - mass.astype(np.int64) + D * listed
        self.p[use] = (np.maximum(counts - D, 0)[pair] + (rest + K)[pair] * self.p[use]) / (totals + K)[pair]
        if len(self.hot_at):  # what the driver added up
            told, hot = self.known[self.level - 1], np.flatnonzero(self.hot_here)
            i = np.searchsorted(told["context"], self.next[hot])
            kept, rest = np.zeros(len(self.next), bool), np.zeros(len(self.next))
            kept[hot], rest[hot] = told["kept"][i] & (told["context"][i] == self.next[hot]), told["rest"][i]
            use = np.flatnonzero(kept[self.hot_context])
            context, use = self.hot_context[use], self.hot_at[use]
            self.p[use] = (np.maximum(self.count[use] - D, 0) + (rest[context] + K) * self.p[use]) / (self.totals[context] + K)
        if last:
            return
        grams = np.where(counts >= max(self.least, LEAST_PAIR), np.arange(len(counts)), -1)
        self.gram = np.full(size, -1, np.int64)
        self.gram[self.at] = grams[self.pair]
        self.next = np.zeros(len(counts), np.uint64)
        self.next[counts > 0] = numbers
        self.totals = counts

    def answered(self, answers: list[dict], levels: int, last: int = -1) -> None:
        """Take the answers of `levels` levels, of which `last` is the last of all. A chunk that asked nothing at a level got no answer and goes on without."""
        for level in range(levels):
            own = sorted((a for a in answers if a["level"] == level), key=lambda a: a["bucket"])
            counts = np.concatenate([np.zeros(0, np.uint64), *(unpacked(a["counts"], "u8") for a in own)])
            if level == 0:
                self.take_words(counts, np.concatenate([unpacked(a["follow"], "u8") for a in own]))
                continue
            numbers = np.concatenate([np.zeros(0, np.uint64), *(numbered(np.cumsum(unpacked(a["follow"], "u4"), dtype=np.uint64), a["bucket"], self.buckets) for a in own if level != last)])
            self.ask(replayed=True)
            kept = np.concatenate([np.zeros(0, bool), *(unpacked(a["kept"], "u1").astype(bool) for a in own)])
            of = np.zeros((2, len(kept)), np.int64)
            of[:, kept] = np.concatenate([np.zeros((2, 0), np.uint64), *(unpacked(a["contexts"], "u8").reshape(2, -1) for a in own)], axis=1)
            self.take(counts, numbers, kept[self.key_rank], *of[:, self.key_rank], last=level == last)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """By segment, over the tokens that are its own."""
        return np.add.reduceat(np.where(self.active, x, 0), self.starts)


ASKED = "bucket int, chunk bigint, contexts binary, symbols binary, times binary, steps binary"
ANSWER = "chunk bigint, level int, bucket int, counts binary, follow binary, kept binary, contexts binary, kind string, context bigint, numbers array<double>"


def questions(rows: DataFrame, level: int, options: dict) -> DataFrame:
    """What the chunks ask for at a level, by bucket."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if level:
                    chunk = Levels(row, **options)
                    chunk.answered(row["answers"] or [], level)
                bucket, contexts, symbols, times, steps = chunk.ask() if level else asked_words(row, options["buckets"])
                cuts = np.searchsorted(bucket, np.arange(options["buckets"] + 1, dtype=np.uint64))
                out = [(i, row["chunk"], packed(np.diff(contexts[s:e], prepend=np.uint64(0))), packed(symbols[s:e]), packed(times[s:e]), packed(steps[s:e])) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if s < e]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "chunk", "contexts", "symbols", "times", "steps"])
        give_back()

    return rows.mapInArrow(run, ASKED)


def tested(n: np.ndarray, listed: np.ndarray, mass: np.ndarray, gained: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts diverge enough from their suffixes, and their rest."""
    rest = n - mass + D * listed
    total = gained - mass * np.log(np.maximum(n, 1)) + rest * np.log(np.maximum(rest, 1e-300) / np.maximum(n, 1))
    return (listed > 0) & (total >= gain * listed), rest


def answers(asked: DataFrame, level: int, last: bool, buckets: int, least_hot: float, hot: np.ndarray, gain: float) -> DataFrame:
    """For each bucket: answers to its chunks, and rows for the driver: totals of level 0, contexts that will be hot, parts of those that are."""

    def run(key, t):
        def column(name: str, kind: str) -> list[np.ndarray]:
            return [unpacked(x, kind) for x in t.column(name).to_pylist()]

        contexts = [np.cumsum(x, dtype=np.uint64) for x in column("contexts", "u8")]
        sizes = [len(x) for x in contexts]
        context, symbol = np.concatenate(contexts), np.concatenate(column("symbols", "u8"))
        times, steps = np.concatenate(column("times", "u4")), np.concatenate(column("steps", "u1"))
        order = np.argsort(symbol)
        order = order[np.argsort(context[order], kind="stable")]
        c, w = context[order], symbol[order]
        del contexts, context, symbol
        new_context = np.append(True, c[1:] != c[:-1])
        new = new_context | np.append(True, w[1:] != w[:-1])
        first = np.flatnonzero(new)
        count = np.add.reduceat(times[order].astype(np.int64), first)
        of = np.cumsum(new_context[first]) - 1  # the context of each pair
        c, w, parent = c[first], w[first], steps[order][first] * STEP
        driver: list[tuple] = []
        if level:
            use = (count >= LEAST_PAIR) & (w > 0)
            n = np.bincount(of, weights=count)
            listed, mass = np.bincount(of, weights=use), np.bincount(of, weights=count * use)
            gained = np.bincount(of, weights=np.where(use, count * (np.log(np.maximum(count - 1 - D, 0.1)) + parent), 0))
            kept, _ = tested(n, listed, mass, gained, gain)
            count = np.where(use, count, 0)
            heads = np.flatnonzero((c & np.uint64(1) > 0) & np.append(True, of[1:] != of[:-1]))
            driver += [("part", int(hot[int(c[h]) // 2 // SALTS].view(np.int64)), [float(listed[of[h]]), float(mass[of[h]]), float(gained[of[h]])]) for h in heads]
            rank = np.cumsum(use) - 1  # listed pairs get numbers, which are the contexts of the next level
            follow = np.where(use, numbered(rank, key[0].as_py(), buckets), 0).astype(np.uint64)
        else:
            driver.append(("total", 0, [float(count.sum()), float((count > 0).sum())]))
            follow = np.empty(len(count), np.uint64)  # numbers: by count, those of all buckets in turns
            follow[np.argsort(-count, kind="stable")] = numbered(np.arange(len(count)), key[0].as_py(), buckets)
            follow[count < LEAST_PAIR] = 0
        driver += [("hot", int(follow[h].view(np.int64)), [float(count[h])]) for h in np.flatnonzero(count >= least_hot)]
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        rows, at = [], 0
        for chunk, size in zip(t.column("chunk").to_pylist(), sizes, strict=True):
            p, at = pair[at : at + size], at + size
            numbers = of_kept = told = None
            if level == 0:
                numbers = packed(follow[p])
            else:
                if not last:
                    numbers = packed(np.diff(rank[p[use[p]]], prepend=0).astype(np.uint32))
                o = of[p[np.append(True, of[p[1:]] != of[p[:-1]])]]  # its contexts, and of those that are kept what the scores need
                of_kept, o = packed(kept[o].astype(np.uint8)), o[kept[o]]
                told = packed(np.concatenate([listed[o], mass[o]]).astype(np.uint64))
            rows.append((chunk, level, key[0].as_py(), packed(count[p].astype(np.uint64)), numbers, of_kept, told, None, None, None))
        rows += [(None, level, key[0].as_py(), None, None, None, None, *x) for x in driver]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.string(), pa.int64(), pa.list_(pa.float64())]
        give_back()
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ANSWER.split(", ")])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_context: int = LEAST_CONTEXT, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    own = docs.select(F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    path = new_path(spark, "chunks")
    name = f"chunks_{path[-32:]}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.rdd.getNumPartitions())
    write(spark, chunks(own, depth).write.partitionBy("words").bucketBy(parts, "chunk"), path, name)
    held, words = spark.table(name).filter("not words").drop("words", "hashes", "times"), spark.table(name).filter("words")
    n_tokens = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = -(-n_tokens // BUCKET) or 1
    options = {"n": 0, "v": 0, "buckets": buckets, "hot": [], "known": [], "least_context": least_context}
    told: list[str] = []

    def answered() -> DataFrame:
        """Chunks with all answers so far, read side by side."""
        none = F.array().cast("array<struct<level: int, bucket: int, counts: binary, follow: binary, kept: binary, contexts: binary>>")
        rows, every = held, none
        for level, t in enumerate(told):
            one = spark.table(t).select(F.col("of").alias(f"of{level}"), F.col("answers").alias(f"answers{level}"))
            rows = rows.join(one.hint("merge"), F.col("chunk") == F.col(f"of{level}"), "left")
            every = F.concat(every, F.coalesce(f"answers{level}", none))
        return rows.select(*held.columns, every.alias("answers"))

    least_hot = max(LEAST_PAIR, HOT * n_tokens)
    for level in range(depth + 1):
        hot = options["hot"][level - 1] if level else np.zeros(0, np.uint64)
        rows = staged(answers(questions(answered() if level else words, level, dict(options)), level, level == depth, buckets, least_hot, hot, gain), "answers")
        to_chunks = rows.filter("chunk is not null").select(F.col("chunk").alias("of"), F.struct("level", "bucket", "counts", "follow", "kept", "contexts").alias("a"))
        told.append(f"{name}_{level}")
        of = to_chunks.repartition(parts, "of").groupBy("of").agg(F.collect_list("a").alias("answers"))
        write(spark, of.write.bucketBy(parts, "of"), f"{path}-{level}", told[-1])
        mine = rows.filter("kind is not null")
        if level == 0:
            remove(spark, f"{path}/words=true")
            n, v = (int(x) for x in mine.filter("kind = 'total'").agg(F.coalesce(F.sum(F.col("numbers")[0]), F.lit(0.0)), F.coalesce(F.sum(F.col("numbers")[1]), F.lit(0.0))).first())
            options |= {"n": n, "v": v}
        else:
            sums = mine.filter("kind = 'part'").groupBy("context").agg(*(F.sum(F.col("numbers")[i]).alias(f"x{i}") for i in range(3))).collect()
            order = sorted(sums, key=lambda r: int(np.int64(r.context).view(np.uint64)))
            context = np.array([r.context for r in order], np.int64).view(np.uint64)
            listed, mass, gained = (np.array([r[f"x{i}"] for r in order], float) for i in range(3))
            kept, rest = tested(np.array([totals[int(c)] for c in context], float), listed, mass, gained, gain)
            options["known"] = [*options["known"], {"context": np.append(context, np.uint64(2**64 - 1)), "kept": np.append(kept, False), "rest": np.append(rest, 0.0)}]
        found = mine.filter("kind = 'hot'").select("context", F.col("numbers")[0].alias("count")).collect()
        totals = {int(np.int64(r.context).view(np.uint64)): r["count"] for r in found}
        options["hot"] = [*options["hot"], np.array(sorted(totals), np.uint64)]
        discard(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    final = dict(options)

    def score(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                chunk = Levels(row, **final)
                chunk.answered(row["answers"] or [], depth + 1, last=depth)
                id_type = b.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["rows"], pa.int64()), pa.array(row["ids"], id_type), pa.array(row["held"], pa.bool_()), pa.array(chunk.sums(np.ones(len(chunk.tokens), np.int64))), pa.array(chunk.sums(chunk.seen.astype(np.int64))), pa.array(chunk.sums(np.log10(chunk.root))), pa.array(chunk.sums(np.log10(chunk.p)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
        give_back()

    scored = answered().mapInArrow(score, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    whole = staged(whole, "scored")
    for t, at in ((name, path), *((t, f"{path}-{k}") for k, t in enumerate(told))):
        spark.sql(f"drop table {t}")
        remove(spark, at)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
