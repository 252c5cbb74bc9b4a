r"""Benchmark decontamination with suffix arrays.

A shard is a run of documents inside one task. Its words become ids of the benchmark's vocabulary (0: not in it), its suffix
array holds the suffixes that start in a run of known words long enough for a window, and every benchmark suffix is looked up in
it by binary search of its window, which gives the hit words and the windows of each document. Longest matches lie within hit words, so
these and the items that occur get a suffix array of their own, in full order, by doubling. In it the longest match of an item's suffix
with a document is one of the two neighbours among the document's suffixes; of pairs with the same word before both, the longer pair
begins earlier, so they are dropped, and windows that occur behind one common word alone are not even laid out.

Words: A-Z lower-cased, then `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. A window is `window` consecutive item words; an item with fewer,
but not none, is one window. Null or empty texts have no words: documents count as clean, items have no window. A null item id
reads as the empty text. Repeated rows are judged alike, each for itself; of items that repeat an id, all windows count, the id
once. Tables may be empty, extra columns are ignored (find_matches) or kept (remove_contaminated).

Scale: work and memory follow places and pairs of document and item, never pairs of places: a shard whose documents and items make over
MOST_PAIRS is halved, and a single document's are taken in parts. The scan is one pass without a shuffle. The benchmark is collected and indexed in blocks of about `block_chars` characters (a
longer single item is a block of its own), one after the other; a worker holds one block at a time and goes through all of them
for each batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, free_name, give_back, pieces, raw, table

WINDOW = 10
BLOCK_CHARS = 4_000_000
SHARD_WORDS, MOST_PAIRS = 1_000_000, 500_000
KIND = "struct<n_words: bigint, n_hit: bigint, items: array<string>, matches: array<struct<item: string, doc_word: bigint, item_word: bigint, n_words: bigint>>, spans: array<bigint>>"


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(ALNUM).split()


def window_keys(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, window: int, fill: int = 0) -> np.ndarray:
    """The first words of the suffixes `at`, as many as `sizes` says, as keys that sort like the suffixes; the rest is `fill`."""
    keys = np.full((len(at), window), fill, ">u4")
    for k in range(window):
        use = np.flatnonzero(k < sizes)
        keys[use, k] = words[at[use] + k]
    return keys.reshape(-1).view(f"S{4 * window}")


class Index:
    """A block of items: vocabulary, the words of all items as ids with a 0 after each, and the windows' suffixes in order."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocabulary, self.names = window, {}, sorted({n for n, _ in items})
        number, parts, owners = {n: i for i, n in enumerate(self.names)}, [np.zeros(1, np.int64)], [-1]
        for name, data in items:
            words = words_of(data)
            parts.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
            owners += [number[name]] * (len(words) + 1)
        self.words = np.concatenate(parts)
        item, length = np.array(owners), np.array([len(p) for p in parts[1::2]], np.int64)
        starts = np.concatenate([[1], 1 + np.cumsum(length + 1)[:-1]]).astype(np.int64) if len(length) else np.zeros(0, np.int64)
        counts = np.where(length > 0, np.maximum(length - window, 0) + 1, 0)
        at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = np.repeat(np.minimum(length, window), counts)
        low = window_keys(self.words, at, sizes, window)
        order = np.lexsort((at, low))
        at, sizes, low = at[order], sizes[order], low[order]
        head = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)])
        self.first = np.append(head, len(low))  # the suffixes of each distinct window
        self.at, self.item, self.place = at, item[at], at - np.repeat(starts, counts)[order]
        self.text, self.starts, self.length = np.repeat(np.arange(len(length)), counts)[order], starts, length
        # The word before all places of a window; 0 where they differ or one begins its item.
        before = self.words[np.maximum(at - 1, 0)]
        self.left = np.where(np.minimum.reduceat(before, head) == np.maximum.reduceat(before, head), before[head], 0) if len(head) else before
        self.sizes, self.low = sizes[head], low[head]
        self.high = window_keys(self.words, at[head], sizes[head], window, 0xFFFFFFFF)

    def ids(self, data: bytes | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.concatenate([np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in (p.split() for p in pieces((data or b"").translate(ALNUM)))])

    def search(self, docs: list[np.ndarray]) -> list[tuple[np.ndarray, list[tuple[str, int, int, int]]]]:
        """For each document: its hit spans (start, end, start, end ...), and the longest match with each item."""
        got = self.scan(docs, None)
        out: list[tuple[np.ndarray, list]] = [(got.spans[got.span_doc == i].reshape(-1), []) for i in range(len(docs))]
        for d, k, p, q, n in zip(*(x.tolist() for x in (got.doc, got.item, got.p, got.q, got.n)), strict=True):
            out[d][1].append((self.names[k], p, q, n))
        return out

    def scan(self, docs: list[np.ndarray], most_pairs: int | None) -> Found | None:
        """Spans and longest matches of all documents. None if there may be more than `most_pairs` matches and several documents."""
        starts = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
        words = np.zeros(sum(len(d) + 1 for d in docs) + self.window, np.int64)
        for s, d in zip(starts, docs, strict=True):
            words[s : s + len(d)] = d
        if not len(self.sizes):
            return Found.none()
        known = np.diff(np.concatenate([[0], (words > 0).view(np.int8), [0]]))
        begin, end = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
        long = end - begin >= self.sizes.min()
        begin, length = begin[long], (end - begin)[long]
        if not len(begin):
            return Found.none()
        # The suffix array: suffixes by their first words, up to the window's length.
        suffixes = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        keys, alive = np.zeros((len(suffixes), self.window), ">u4"), np.ones(len(suffixes), bool)
        for k in range(self.window):
            column = words[np.minimum(suffixes + k, len(words) - 1)]
            alive &= column > 0
            keys[:, k] = np.where(alive, column, 0)
        keys = keys.reshape(-1).view(f"S{4 * self.window}")
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.maximum(high - low, 0)
        if not found.sum():
            return Found.none()
        which = np.repeat(np.arange(len(found)), found)
        place = suffixes[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
        # Hit words: spans that overlap or touch become one.
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + self.sizes[which], -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(starts, s, "right") - 1
        # Windows of each document, but those whose places all follow the same word as they do in the items.
        left = np.where(place > 0, words[np.maximum(place - 1, 0)], 0)
        new = (left == 0) | (left != self.left[which])
        own = np.unique((np.searchsorted(starts, place[new], "right") - 1) * len(self.sizes) + which[new])
        own_doc, own_window = own // len(self.sizes), own % len(self.sizes)
        each = self.first[own_window + 1] - self.first[own_window]
        if most_pairs is not None and len(docs) > 1 and each.sum() > most_pairs:
            return None
        place = np.unique(place)
        longest = self._longest(words, s, e, place, np.searchsorted(starts, place, "right") - 1, own_doc, own_window, each, most_pairs or MOST_PAIRS)
        doc, item, p, q, n = longest
        return Found(np.stack([s, e], 1) - starts[owner][:, None], owner, doc, item, p - starts[doc], q, n)

    def _longest(self, words: np.ndarray, s: np.ndarray, e: np.ndarray, place: np.ndarray, place_doc: np.ndarray, own_doc: np.ndarray, own_window: np.ndarray, each: np.ndarray, step: int) -> list[np.ndarray]:
        """doc, item, p, q, n: of each document and item the longest match, the first of equal ones."""
        # One text of all hit spans and of the items that occur, with an end of its own behind each part.
        texts = np.unique(self.text[ranges(self.first[np.unique(own_window)], self.first[np.unique(own_window) + 1])])
        a, z = np.concatenate([s, self.starts[texts]]), np.concatenate([e, self.starts[texts] + self.length[texts]])
        at = np.cumsum(z - a + 1) - (z - a + 1)
        whole = np.full(int((z - a + 1).sum()), 0, np.int64)
        ends = at + (z - a)
        whole[ends] = len(self.vocabulary) + 1 + np.arange(len(ends))
        mask = np.ones(len(whole), bool)
        mask[ends] = False
        whole[mask] = np.concatenate([words[ranges(s, e)], self.words[ranges(a[len(s) :], z[len(s) :])]])
        before = np.concatenate([[0], np.where(mask[:-1], whole[:-1], 0)])
        levels = doubled(whole)
        order = levels[-1]

        def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            run = np.zeros(len(x), np.int64)
            for k in range(len(levels) - 2, -1, -1):  # in the last level no two are equal
                run += np.where(levels[k][x + run] == levels[k][y + run], 1 << k, 0)
            return run

        span = np.searchsorted(s, place, "right") - 1
        spot = at[span] + place - s[span]
        key = place_doc * len(whole) + order[spot]
        turn = np.argsort(key)
        key, spot, place, place_doc = key[turn], spot[turn], place[turn], place_doc[turn]
        first_of, last_of = np.searchsorted(place_doc, own_doc, "left"), np.searchsorted(place_doc, own_doc, "right")
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        done, sums = 0, np.cumsum(each)
        while done < len(each):
            until = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + step, "right")))
            part = slice(done, until)
            done = until
            q = ranges(self.first[own_window[part]], self.first[own_window[part] + 1])
            doc, lo, hi, size = (np.repeat(x[part], each[part]) for x in (own_doc, first_of, last_of, self.sizes[own_window]))
            q_spot = at[len(s) + np.searchsorted(texts, self.text[q])] + self.place[q]
            above = np.searchsorted(key, doc * len(whole) + order[q_spot])
            rows = []
            for side in (above - 1, above):
                ok = np.flatnonzero((side >= lo) & (side < hi))
                x, y = spot[side[ok]], q_spot[ok]
                ok = ok[(before[x] != before[y]) | (before[x] == 0)]
                n = common(spot[side[ok]], q_spot[ok])
                rows.append((ok[n >= size[ok]], n[n >= size[ok]]))
            at_row, n = (np.concatenate(r) for r in zip(*rows, strict=True))
            if not len(at_row):
                continue
            item = self.item[q[at_row]]
            at_row, item, n = _first_of_each(at_row, item, n, doc[at_row])
            # Where among the document's suffixes those lie that share as much; the first place of them counts.
            low, high = lo[at_row], above[at_row]
            while (open_ := low < high).any():
                mid = (low + high) // 2
                enough = common(spot[np.minimum(mid, len(spot) - 1)], q_spot[at_row]) >= n
                high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid + 1, low)
            begin, low, high = low, above[at_row], hi[at_row]
            while (open_ := low < high).any():
                mid = (low + high) // 2
                enough = common(spot[np.minimum(mid, len(spot) - 1)], q_spot[at_row]) >= n
                low, high = np.where(open_ & enough, mid + 1, low), np.where(open_ & ~enough, mid, high)
            p = np.minimum.reduceat(np.append(place, place.max() + 1), np.stack([begin, low], 1).reshape(-1))[::2]
            rows = [doc[at_row], item, p, self.place[q[at_row]], n]
            best = [np.concatenate(x) for x in zip(best, rows, strict=True)]
            chosen = np.lexsort((best[3], best[2], -best[4], best[1], best[0]))
            best = [x[chosen] for x in best]
            one = np.ones(len(best[0]), bool)
            one[1:] = (np.diff(best[0]) != 0) | (np.diff(best[1]) != 0)
            best = [x[one] for x in best]
        return best


def _first_of_each(at: np.ndarray, item: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document and item the rows with the largest n, all of them if several have it."""
    order = np.lexsort((-n, item, doc))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)
    most = n[order][new][np.cumsum(new) - 1]
    order = order[n[order] == most]
    return at[order], item[order], n[order]


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from each first up to its last, one range behind the other."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def doubled(text: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4 ... symbols, until all differ. The text ends with a symbol that is nowhere else."""
    levels = [np.unique(text, return_inverse=True)[1]]
    while levels[-1].max(initial=-1) + 1 < len(text):
        r, step = levels[-1], 1 << (len(levels) - 1)
        ahead = np.concatenate([r[step:], np.full(min(step, len(r)), -1)])
        levels.append(np.unique(r * (len(text) + 1) + ahead + 1, return_inverse=True)[1])
    return levels


@dataclass
class Found:
    """Hit spans (start, end) with their documents, and longest matches: document, number of the item's name, place in both, words."""

    spans: np.ndarray
    span_doc: np.ndarray
    doc: np.ndarray
    item: np.ndarray
    p: np.ndarray
    q: np.ndarray
    n: np.ndarray

    @classmethod
    def none(cls) -> Found:
        return cls(np.zeros((0, 2), np.int64), *(np.zeros(0, np.int64) for _ in range(6)))


def together(parts: list[tuple[Found, list[str]]]) -> tuple[Found, pa.Array]:
    """What several blocks have found in the same documents, and the names of the items."""
    names, number = np.unique(np.array([n for _, held in parts for n in held], object), return_inverse=True) if parts else (np.zeros(0, object), np.zeros(0, np.int64))
    offset = np.cumsum([0, *(len(held) for _, held in parts)])
    if len(parts) == 1:
        return parts[0][0], pa.array(parts[0][1], pa.string())
    doc, p, q, n = (np.concatenate([getattr(f, c) for f, _ in parts]) for c in ("doc", "p", "q", "n"))
    item = np.concatenate([number[offset[k] + f.item] for k, (f, _) in enumerate(parts)])
    order = np.lexsort((q, p, -n, item, doc))
    one = np.ones(len(order), bool)
    one[1:] = (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)
    order = order[one]
    span_doc = np.concatenate([f.span_doc for f, _ in parts])
    spans = np.concatenate([f.spans for f, _ in parts])
    joined = [(d, merged(spans[span_doc == d].reshape(-1).tolist(), [])) for d in np.unique(span_doc).tolist()]
    flat = np.array([x for _, held in joined for x in held], np.int64).reshape(-1, 2)
    return Found(flat, np.array([d for d, held in joined for _ in held[::2]], np.int64), doc[order], item[order], p[order], q[order], n[order]), pa.array(names.tolist(), pa.string())


def merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    """The items in blocks of bounded size, collected one after the other."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, count = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count(F.lit(1))).first()
    n = min(-(-total // block_chars), count) or 1
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted((r.item, r.text.encode()) for r in part.collect())


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", result_col: str = "found", window: int = WINDOW, block_chars: int = BLOCK_CHARS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """docs, and as a column that must not be there yet: words, hit words, items with occurring windows, longest match with each, and the hit spans."""
    sent = []
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        sent.append(docs.sparkSession.sparkContext.broadcast(vars(Index(items, window))))

    schema = T.StructType([*docs.schema.fields, T.StructField(result_col, T.DataType.fromDDL(KIND))])
    if result_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {result_col!r} already")

    def opened() -> Iterator[Index]:
        """One block after another, one of them in memory if there are several."""
        for index in sent:
            ix = Index.__new__(Index)
            vars(ix).update(index.value)
            yield ix
            if len(sent) > 1:
                vars(index).pop("_value", None)  # the next round reads its file again

    def results(texts: list[bytes | None]) -> Iterator[pa.Array]:
        """What is found in the texts, as arrays for the first of them, the next ones and so on."""
        parts, sizes = [], [0] * len(texts)
        for ix in opened():
            ids = [ix.ids(t) for t in texts]
            sizes = [len(d) for d in ids]
            got = ix.scan(ids, most_pairs)
            if got is None or sum(len(f.doc) for f, _ in parts) > most_pairs and len(texts) > 1:
                half = len(texts) // 2
                yield from results(texts[:half])
                yield from results(texts[half:])
                return
            if len(got.span_doc) or not parts:
                parts.append((got, ix.names))
        found, names = together(parts) if parts else (Found.none(), pa.array([], pa.string()))
        yield packed(found, names, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard: list[bytes | None] = []
            size = begin = 0
            for n, data in enumerate(raw(b.column(text_col))):
                shard.append(data)
                size += len(data or b"")
                if size >= 6 * SHARD_WORDS or n == b.num_rows - 1:
                    for found in results(shard):
                        yield pa.RecordBatch.from_arrays([*b.slice(begin, len(found)).columns, found], names=[*b.schema.names, result_col])
                        begin += len(found)
                    shard, size = [], 0
        give_back()

    return docs.mapInArrow(run, schema)


def packed(found: Found, names: pa.Array, sizes: list[int]) -> pa.Array:
    """One struct a document."""
    rows = np.arange(len(sizes) + 1)
    offsets = lambda of: pa.array(np.searchsorted(of, rows).astype(np.int32))
    hit = np.zeros(len(sizes), np.int64)
    np.add.at(hit, found.span_doc, found.spans[:, 1] - found.spans[:, 0])
    items, at = names.take(pa.array(found.item)), offsets(found.doc)
    matches = pa.StructArray.from_arrays([items, pa.array(found.p), pa.array(found.q), pa.array(found.n)], ["item", "doc_word", "item_word", "n_words"])
    spans = pa.ListArray.from_arrays(offsets(np.repeat(found.span_doc, 2)), pa.array(found.spans.reshape(-1)))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(hit), pa.ListArray.from_arrays(at, items), pa.ListArray.from_arrays(at, matches), spans], ["n_words", "n_hit", "items", "matches", "spans"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    name = free_name(docs)
    return find_matches(docs, benchmark, result_col=name, **options).filter(F.col(f"{name}.n_hit") == 0).drop(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("found.items")
    return r.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with d as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (
  select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select doc_id, i, dw.k, item_id from dw join bw on dw.s = bw.s and dw.k = bw.k),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
