r"""Spelling variants: words one edit apart, found by the parity of their letters.

Each letter has a bit that says whether a word holds it an odd number of times. One inserted or deleted code point flips one bit,
a replaced one two; so of three bands of the mask one at least stays. Words meet where a band and the length are equal (the longer
of two words comes under the shorter's length; then two bands stay, so two bands suffice), masks must differ in two bits at most,
and half of each pair must be equal; what remains is verified by its edit distance. Letters go to the bands by turns in order of
frequency. The 63 most frequent letters have bits of their own, all others share one, which can hide a difference, never make one.

Runs: maximal `[A-Za-zÀ-ÿ]+` of a whole text, A-Z lower-cased. Where 97 divides h, the crc32 of `<doc_id>:<run>`, the run's
code point h % length is deleted. A word has `min_chars` code points and `min_count` occurrences at least. A word's form is its near
word of largest n (ties: smallest in code-point order) if that n is `lead` times the word's own at least; its root is where
forms of forms end. Null or empty texts have no runs; a null id reads as the empty text; repeated rows count each. Words of any
length and any letters are compared. Empty tables give no rows. Extra columns are ignored.

Scale: occurrences are summed up before they are shuffled; all else works on distinct words, each sent five times with its key. Groups
of over `split` words are dealt out anew by the first or the last half of the word, one of which one edit leaves alone; what is
still larger meets as pairs of blocks. So no task has more than `split` words of a group, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, free_name, give_back, staged, table

RUN = r"[A-Za-zÀ-ÿ]+"
BANDS, OWN_BITS, SPLIT, LARGE = 3, 63, 20_000, 64
#: A prime of which multiples mark the occurrences that lose a code point.
MARKED = 97
BASE = 0x9E3779B97F4A7C15


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: every run of every text, as the contract alters it."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("found")).select("id", ascii_lower(F.col("found")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    return runs.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % MARKED == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, *, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word and n of the words long and frequent enough."""
    return words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


class Alphabet:
    """The bit of each letter; letters that have none of their own share the last."""

    def __init__(self, letters: list[str]):
        self.codes = np.array(sorted(ord(c) for c in letters[:OWN_BITS]), np.uint32)
        place = {ord(c): k for k, c in enumerate(letters[:OWN_BITS])}
        self.bits = np.array([place[c] for c in self.codes.tolist()], np.int64)
        self.bands = np.array([sum(1 << k for k in range(64) if k % BANDS == b) for b in range(BANDS)], np.uint64)

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all words, where each begins, its length and its mask. Words are not empty."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        at = np.minimum(np.searchsorted(self.codes, flat), max(len(self.codes) - 1, 0))
        bit = np.where(self.codes[at] == flat, self.bits[at], OWN_BITS) if len(self.codes) else np.full(len(flat), OWN_BITS)
        mask = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), bit.astype(np.uint64)), begin) if len(words) else np.zeros(0, np.uint64)
        return flat, begin, size, mask


def halves(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first short // 2 and of the last short - short // 2 code points."""
    powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(flat), base, np.uint64)]), dtype=np.uint64) for base in (BASE, pow(BASE, -1, 1 << 64))]
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers[0][:-1], dtype=np.uint64)])
    of = lambda a, z: (sums[z] - sums[a]) * powers[1][a]
    end = begin + size
    return of(begin, begin + short // 2), of(end - (short - short // 2), end)


#: Rows that meet: `key` says with what, `band` by which band, `role` 1 for the longer word, `side` 1 or 2 where a half is in the key, `block` and `one` where blocks meet.
KEYED = "key bigint, band int, role int, side int, block int, one boolean, word string, n bigint"


def keyed(words: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Each word under its bands and its length, and as the longer word under two bands and the length below."""
    ways = [(b, 0) for b in range(BANDS)] + [(b, 1) for b in range(BANDS - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, size, mask = alphabet.read(b.column("word").to_pylist())
            for band, role in ways:
                key = (mask & alphabet.bands[band]) * np.uint64(BASE) ^ ((size - role) * BANDS + band).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
                fixed = [np.full(b.num_rows, x, np.int32) for x in (band, role, 0, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, fixed), pa.array(np.ones(b.num_rows, bool)), b.column("word"), b.column("n")], names=[x.split()[0] for x in KEYED.split(", ")])
        give_back()

    return words.select("word", "n").mapInArrow(run, KEYED)


def dealt(rows: DataFrame, split: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows, with keys that no more than `split` share; and the tables that it reads."""
    hot_of = lambda df: df.groupBy(F.col("key").alias("hot")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > split)
    hot = staged(hot_of(rows), "hot")
    if hot.isEmpty():
        return rows, [hot]
    short = F.length("word") - F.col("role")
    half = F.floor(short / 2).cast("int")
    parts = F.array(F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - (short - half) + 1))
    names = [x.split()[0] for x in KEYED.split(", ")]
    few = hot.count() <= 100_000  # rows of two numbers
    near = lambda right, few: F.broadcast(right) if few else right
    halved = staged(
        rows.join(near(hot, few), F.col("key") == F.col("hot"), "left_semi")
        .select(*names, F.posexplode(parts).alias("k", "half"))
        .withColumns({"key": F.xxhash64("key", "k", "half"), "side": F.col("k") + 1})
        .select(*names),
        "halved",
    )
    hotter = staged(hot_of(halved), "hotter")
    few_left = hotter.count() <= 100_000
    blocks = F.ceil(F.col("rows") / max(1, split // 2)).cast("int")
    blocked = (
        halved.join(near(hotter, few_left), F.col("key") == F.col("hot"))
        .withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"key": F.xxhash64("key", F.least("block", "x"), F.greatest("block", "x")), "one": F.col("block") == F.col("x")})
        .select(*names)
    )
    rest = lambda df, right, few: df.join(near(right, few), F.col("key") == F.col("hot"), "left_anti").select(*names)
    return rest(rows, hot, few).unionByName(rest(halved, hotter, few_left)).unionByName(blocked), [hot, halved, hotter]


def candidates(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """a, a_n, b, b_n: pairs of words that share a key, whose masks differ in two bits at most and of which a half is equal; each pair once."""

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, band, role, side, block, one = (t.column(c).to_numpy() for c in ("key", "band", "role", "side", "block", "one"))
        flat, begin, size, mask = alphabet.read(t.column("word").to_pylist())
        short = size - role
        first, last = halves(flat, begin, size, short)
        most = (2 - role).astype(np.uint8)  # bits that may differ from a row before this one
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        end = np.append(head[1:], len(key))
        found, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found, held
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            found, held = [], 0
            x = mask[i] ^ mask[j]
            ok = (short[i] == short[j]) & (band[i] == band[j]) & (side[i] == side[j]) & (x & alphabet.bands[band[i]] == 0)
            for b in range(BANDS - 1):  # the first band that is equal counts
                ok &= (band[i] <= b) | (x & alphabet.bands[b] != 0)
            same_first, same_last = first[i] == first[j], last[i] == last[j]
            ok &= np.select([side[i] == 1, side[i] == 2], [same_first, same_last & ~same_first], same_first | same_last)
            ok &= (block[i] != block[j]) | one[i] & one[j]
            i, j = i[ok], j[ok]
            word, n = t.column("word"), t.column("n")
            for a in range(0, len(i), 50_000):
                u, v = pa.array(i[a : a + 50_000]), pa.array(j[a : a + 50_000])
                yield from pa.table([word.take(u), n.take(u), word.take(v), n.take(v)], names=["a", "a_n", "b", "b_n"]).combine_chunks().to_batches()

        for a, z in zip(head[end - head >= LARGE].tolist(), end[end - head >= LARGE].tolist(), strict=True):
            m, lim, shorter = mask[a:z], most[a:z], int((role[a:z] == 0).sum())
            for d in range(1, z - a):
                w = min(shorter, z - a - d)
                if hit := len(at := np.flatnonzero(np.bitwise_count(m[:w] ^ m[d : d + w]) <= lim[d : d + w])):
                    found.append((at + a, at + a + d))
                    held += hit
                    if held > 1_000_000:
                        yield from flush()
        ends = np.repeat(end, end - head)
        act = np.flatnonzero(np.repeat(end - head < LARGE, end - head) & (role == 0))
        for d in range(1, LARGE):
            act = act[act + d < ends[act]]
            hits = act[np.bitwise_count(mask[act] ^ mask[act + d]) <= most[act + d]]
            found.append((hits, hits + d))
            if (held := held + len(hits)) > 1_000_000:
                yield from flush()
        yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for b in (b for b in batches if b.num_rows):
            waiting.append(b)
            rows += b.num_rows
            last = b.column("key")[b.num_rows - 1].as_py()
            if rows < 30_000 or waiting[0].column("key")[0].as_py() == last:
                continue  # a group goes on into the next batch
            whole = pa.Table.from_batches(waiting)
            cut = int(np.searchsorted(whole.column("key").to_numpy(), last))
            yield from compared(whole.slice(0, cut).combine_chunks())
            waiting = whole.slice(cut).combine_chunks().to_batches()
            rows -= cut
        if rows:
            yield from compared(pa.Table.from_batches(waiting).combine_chunks())
        give_back()

    return rows.repartition("key").sortWithinPartitions("key", "role").mapInArrow(run, "a string, a_n bigint, b string, b_n bigint")


def near_words(words: DataFrame, *, split: int = SPLIT) -> DataFrame:
    """a, a_n, b, b_n: the pairs of distinct words that are one edit apart, each once. words: word and n, each word once."""
    letters = [r.letter for r in words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(OWN_BITS).collect() if r.letter]
    alphabet = Alphabet(letters)
    rows = staged(keyed(words, alphabet), "keyed")
    parted, read = dealt(rows, split)
    out = staged(candidates(parted, alphabet).filter(F.levenshtein("a", "b", 1) == 1), "near")
    discard(rows, *read)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root, from word and form; doubling the steps each time. Forms lead upwards, so they end."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        after = staged(now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, *, lead: int = 2, split: int = SPLIT) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word. words: word and n; repeats of a word are summed up, nulls and empty words left out."""
    own = staged(words.filter(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_words(own, split=split)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("near_to"), F.col("b").alias("form"), F.col("b_n").alias("form_n")), F.struct(F.col("b").alias("near_to"), F.col("a").alias("form"), F.col("a_n").alias("form_n")))))
    best = both.groupBy("near_to").agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    leads = -F.col("best.less") >= lead * F.col("n")
    judged = staged(
        own.join(best, F.col("word") == F.col("near_to"), "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")),
        "judged",
    )
    discard(own, pairs)
    ends = roots(judged.filter("form is not null")).withColumnRenamed("word", "of")
    return judged.join(ends, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def with_roots(docs: DataFrame, found: DataFrame, *, result_col: str = "root") -> DataFrame:
    """docs with a column `word`, and the root of each; words that `found` lacks are their own. The name gets a `_` where docs has it."""
    ends = found.filter(F.col("root") != F.col("word")).select(F.col("word").alias("__spelling_word"), F.col("root").alias("__spelling_root"))
    return docs.join(ends, docs["word"] == F.col("__spelling_word"), "left").withColumn(free_name(docs, result_col), F.coalesce("__spelling_root", docs["word"])).drop("__spelling_word", "__spelling_root")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(counted(occurrences(table(spark, sf_dir, "documents"))))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial 0xEDB88320, as an SQL list."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return "[" + ", ".join(f"{x}::bigint" for x in out) + "]"


SQL = rf"""
with recursive r as (
  select id, r, count(*) as c from (
    select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from documents) group by id, r),
b as (select r, c, flatten(list_transform(string_split(id || ':' || r, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192::bigint + (unicode(x) >> 6), 128::bigint + (unicode(x) & 63)] end)) as bytes from r),
h as (select r, c, xor(list_reduce(bytes, lambda a, x: xor({_crc_table()}[(xor(a, x) & 255) + 1], a >> 8), 4294967295::bigint), 4294967295::bigint) as h from b),
o as (select case when h % 97 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, c from h),
w as materialized (select word, sum(c)::bigint as n from o where length(word) >= 5 group by word having sum(c) >= 3),
p as (select word, n, length(word) as len, unnest(range(1, length(word) + 1)) as i from w),
s as (select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as s from p),
x as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as s from p),
near as (
  select a.word, b.word as other, b.n as m from s a join s b on a.s = b.s and a.word <> b.word
  union all select x.word, w.word, w.n from x join w on x.s = w.word
  union all select w.word, x.word, x.n from x join w on x.s = w.word),
best as (select word, count(*) as n_near, arg_min(other, (-m, encode(other))) as other, max(m) as m from near group by word),
f as materialized (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * n then other end as form, case when m >= 2 * n then m end::bigint as form_n from w left join best using (word)),
t(word, root) as (select word, form from f where form is not null union all select t.word, f.form from t join f on t.root = f.word where f.form is not null),
e as (select t.word, t.root from t join f on t.root = f.word where f.form is null)
select f.word, form, coalesce(e.root, f.word) as root, n, n_near, form_n from f left join e on f.word = e.word
"""
