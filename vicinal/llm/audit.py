r"""Filter interaction audit: what each of several filters removes in every order in which they may run.

Counts come from Arrow buffers: byte classes by table, words, capitals, symbols and code points by prefix sums, distinct words by
sorted hashes of words, each pair of equal neighbours verified byte by byte (texts where two different words share a hash are
counted by a set). A document's failed filters are one mask; masks are summed up by part, and all orders are read off those sums.

Words: maximal `[^\x20\x09-\x0D]+`, case-sensitive. A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * `[A-Z]` >
5 * code points; D: any of `#$%&*|`; E: the text is that of a smaller id anywhere in the table. A null text is empty, so it fails A,
and E where an empty text has a smaller id. A null id is never a copy, has no copies and no label. Repeated rows count each, and none
is smaller than the other. An id with several labels is good (toxic) if one of them says so. A null source is the part ''. Empty tables
give no rows. Extra columns are ignored. Texts of any length are read whole; those over HUGE bytes in pieces cut at spaces.

Scale: texts are read once and never shuffled: a row leaves the scan as id, part, mask and digest, in a staged table. Copies are
summed up by digest, part and label before the digests of a group of copies meet, so such a group costs a row for each part and label.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, give_back, staged, table

SLICE, HUGE = 1 << 20, 1 << 21
SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[32, *range(9, 14)]] = SPACE
CLASSES[65:91] = CAPITAL
CLASSES[[ord(c) for c in "#$%&*|"]] = SYMBOL
CLASSES[0x80:0xC0] = INNER
#: Of the words' hashes: a value for each byte, and an odd base with its inverse modulo 2^64.
VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
COUNTS = ("words", "distinct_words", "capitals", "symbols", "chars")
#: The contract's filters, as failure conditions over COUNTS and `first`, whether no smaller id has the text.
FILTERS = {"A": "words < 50", "B": "100 * distinct_words < 65 * words", "C": "100 * capitals > 5 * chars", "D": "symbols > 0"}


class Scanner:
    """Counts of the texts of a buffer; powers of the base are kept from slice to slice."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """data: bytes; off: where each text begins, and the end. A row of COUNTS for each text."""
        n, rows = len(data), len(off) - 1
        out = np.zeros((rows, len(COUNTS)), np.int64)
        if not n:
            return out
        kinds = CLASSES[data]
        space = kinds == SPACE
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before, after = edge[:n].copy(), edge[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        starts = ~space & before
        for k, flags in ((0, starts), (2, kinds == CAPITAL), (3, kinds == SYMBOL), (4, kinds != INNER)):
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            out[:, k] = sums[off[1:]] - sums[off[:-1]]
        s, e = np.flatnonzero(starts), np.flatnonzero(~space & after) + 1
        if not len(s):
            return out
        self.powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * self.up[:n], dtype=np.uint64)])
        owner = np.repeat(np.arange(rows), out[:, 0])
        size = e - s
        marks = (sums[e] - sums[s]) * self.down[s] + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(marks)
        same = np.flatnonzero(marks[order[1:]] == marks[order[:-1]])
        i, j = order[same], order[same + 1]
        equal = (owner[i] == owner[j]) & (size[i] == size[j])
        eights = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        open_, at = np.flatnonzero(equal), 0
        while len(open_):
            left = size[i[open_]] - at
            keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            differs = (eights[s[i[open_]] + at] ^ eights[s[j[open_]] + at]) & keep != 0
            equal[open_[differs]] = False
            at += 8
            open_ = open_[~differs & (left > 8)]
        out[:, 1] = out[:, 0] - np.bincount(owner[i[equal]], minlength=rows)
        for r in np.unique(np.concatenate([owner[i[~equal]], owner[j[~equal]]])):
            out[r, 1] = len(set(data[off[r] : off[r + 1]].tobytes().split()))
        return out

    def huge(self, data: np.ndarray) -> list[int]:
        """The same of one text, in pieces cut at spaces."""
        total, held, at = np.zeros(len(COUNTS), np.int64), set(), 0
        while at < len(data):
            end = min(at + SLICE, len(data))
            while end < len(data) and not CLASSES[data[end]] & SPACE:
                end += 1
            piece = data[at:end]
            held.update(piece.tobytes().split())
            total += self(piece, np.array([0, len(piece)]))[0]
            at = end
        total[1] = len(held)
        return total.tolist()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column as they lie in its buffer, and the texts' offsets; nulls are empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def scan(docs: DataFrame, *, text_col: str = "text", keep: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """The columns `keep`, COUNTS and `digest` (SHA-256 of the text) for each row; names must not clash."""
    if clash := {c.lower() for c in keep} & {*COUNTS, "digest"}:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    kinds = ", ".join([*(f"{c} bigint" for c in COUNTS), "digest binary"])
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            data, off = buffers(b.column(b.num_columns - 1))
            found, a = np.zeros((b.num_rows, len(COUNTS)), np.int64), 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
                part = data[off[a] : off[z]]
                found[a:z] = scanner(part, off[a : z + 1] - off[a]) if len(part) <= HUGE else scanner.huge(part)
                a = z
            view = memoryview(data)
            digests = [hashlib.sha256(view[off[r] : off[r + 1]]).digest() for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, k]) for k in range(len(COUNTS))), pa.array(digests, pa.binary())], names=[*keep, *COUNTS, "digest"])
        give_back()

    schema = type(kept.schema)([*kept.schema.fields, *type(kept.schema).fromDDL(kinds).fields])
    return docs.select(*keep, F.col(text_col).cast("string").alias("__audit_text")).mapInArrow(run, schema)


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, str] | None = None, copy_filter: str = "E") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail, whose bits follow the order of `filters`; the last bit is that of copies."""
    filters = FILTERS if filters is None else filters
    fails = sum((F.expr(cond).cast("int") * (1 << k) for k, cond in enumerate(filters.values())), F.lit(0))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    scanned = staged(scan(own, keep=("id", "part")).select("id", "part", fails.alias("fails"), "digest"), "scanned")
    marked = labels.select(F.col(id_col).alias("label_id"), F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("g"), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("t"))
    marked = marked.dropna().groupBy("label_id").agg(F.max("g").alias("good"), F.max("t").alias("toxic"))
    each = scanned.filter("id is not null").groupBy("id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(marked, F.col("id") == F.col("label_id"), "left").select("id", "digest", "part", "fails", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by_text = each.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    first = F.when(F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest")), F.col("least.n")).otherwise(F.lit(0))
    copy_bit = 1 << len(filters)
    split = by_text.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails").alias("mask"), F.col("first").alias("n")), F.struct((F.col("fails") + copy_bit).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    cells = split.select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    nameless = scanned.filter("id is null").groupBy("part", F.col("fails").alias("mask")).agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    out = staged(cells.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))), "masks")
    discard(scanned)
    return out


def audit(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """part, filter_order, step and the counts, for all orders of the filters `names`, whose bits `cells` has in that order."""
    steps = [("".join(names[k] for k in p), at + 1, sum(1 << k for k in p[:at]), 1 << p[at]) for p in itertools.permutations(range(len(names))) for at in range(len(names))]
    listed = F.split(F.lit(",".join(f"{o} {s} {u} {b}" for o, s, u, b in steps)), ",")
    by = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    field = lambda k: F.split("said", " ").getItem(k)
    by = by.select("part", "cells", F.explode(listed).alias("said")).select("part", "cells", field(0).alias("filter_order"), field(1).cast("int").alias("step"), field(2).cast("int").alias("upto"), field(3).cast("int").alias("bit"))

    def total(fits, of=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", fits), F.lit(0).cast("bigint"), lambda a, c: a + of(c))

    clear = lambda c, bits: c["mask"].bitwiseAND(bits) == 0
    upto, bit = F.col("upto"), F.col("bit")
    here = lambda c: clear(c, upto) & ~clear(c, bit)
    orders = math.factorial(len(names))
    return by.select(
        "part", "filter_order", "step",
        total(lambda c: clear(c, upto.bitwiseOR(bit))).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: ~clear(c, upto) & ~clear(c, bit)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        # A document with k failed filters goes by each of them in one k-th of the orders.
        total(lambda c: ~clear(c, bit), lambda c: (c["n"] * orders / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), [*FILTERS, "E"])


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (
  select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * (length(regexp_replace(t, '[^#$%&*|]', '', 'g')) > 0)::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by part, mask),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from x a, x b, x c, x d, x e where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, i as step, bits[i] as bit, coalesce(list_sum(bits[1:i - 1]), 0)::int as upto from o, unnest(range(1, 6)) as r(i)),
p as (select distinct part from c)
select part, filter_order, cast(step as int) as step, cast(coalesce(sum(n) filter (mask & (upto + bit) = 0), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (mask & upto = 0 and mask & bit > 0), 0) as bigint) as removed, cast(coalesce(sum(n) filter (mask & upto > 0 and mask & bit > 0), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (mask = bit), 0) as bigint) as unique_fails, cast(coalesce(sum(good) filter (mask & upto = 0 and mask & bit > 0), 0) as bigint) as good_lost,
  cast(coalesce(sum(toxic) filter (mask & upto = 0 and mask & bit > 0), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(n * 120 / bit_count(mask)) filter (mask & bit > 0), 0) as bigint) as shapley
from s, p join c using (part) group by part, filter_order, step
"""
