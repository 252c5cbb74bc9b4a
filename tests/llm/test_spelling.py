"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from vicinal.llm import spelling as S

RND = random.Random(11)


def edits(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, lead=2):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) if v else None for w, v in near.items()}
    form = {w: v if v and counts[v] >= lead * counts[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w in counts}


def altered(i, run):
    h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % 97 == 0 else run


def vocabulary(n, letters, sizes, seed):
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
        out |= {w, w[:-1] + rnd.choice(letters), w[1:], rnd.choice(letters) + w}
    return {w: rnd.choice([1, 2, 3, 4, 8, 40]) for w in sorted(out) if w}


def check(spark, counts, **options):
    rows = [(w, n, "x") for w, n in counts.items()]
    got = S.variants(spark.createDataFrame(rows, "word string, n bigint, root string").repartition(3), **options).collect()
    assert len(got) == len(counts)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(counts)


@pytest.mark.parametrize("split", [S.SPLIT, 30, 3])
def test_equals_all_pairs(spark, split):
    """Whole groups, halves, and blocks of what shares a half."""
    check(spark, vocabulary(700, "abcdeÀÿ", [1, 2, 5, 6, 7], 3), split=split)


def test_more_letters_than_bits_and_long_words(spark):
    letters = [chr(x) for x in [*range(97, 123), *range(0xC0, 0x100), *range(0x4E00, 0x4E10), 0x1D11E]]
    counts = vocabulary(400, letters, [5, 6], 4) | {"ab" * 3000: 5, "ab" * 3000 + "c": 20, "ab" * 2999 + "b": 3, "ba" * 3000: 9}
    # Letters that share a bit, replaced by one another.
    check(spark, counts | {"xyz" + c: 4 for c in letters})


def test_large_groups_in_one_task(spark):
    check(spark, vocabulary(1500, "ab", [9, 10, 11], 5))


def test_chains_end_at_their_root(spark):
    counts = {"a" * (5 + i): 2**i for i in range(40)}
    got = {r.word: r.root for r in S.variants(spark.createDataFrame([*counts.items()], "word string, n bigint")).collect()}
    assert set(got.values()) == {"a" * 44}


def test_occurrences(spark):
    texts = [None, "", "Één ÀÉ×÷ÿ naïve_word x-ray 123", "The the THE École ecole Ĉapelo naïve"] + [" ".join(RND.choice(["spelling", "Spelling", "speling", "colour", "color", "Größe", "grösse"]) for _ in range(60)) for _ in range(80)]
    rows = [(i if i % 9 else None, t, 7) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word int").repartition(4)
    lower = lambda r: re.sub("[A-Z]", lambda m: m[0].lower(), r)
    want = Counter(altered(i, lower(r)) for i, t, _ in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert {r.word: r.n for r in S.counted(S.occurrences(docs), min_chars=0, min_count=1).collect()} == want
    found = S.variants(S.counted(S.occurrences(docs)))
    kept = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()} == brute(kept)
    named = S.with_roots(S.occurrences(docs), found)
    assert named.columns == ["word", "root"] and named.count() == sum(want.values())
    assert {r.word: r.root for r in named.collect()} == {w: brute(kept)[w][4] if w in kept else w for w in want}


def test_empty_tables_repeats_and_nulls(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.variants(S.counted(S.occurrences(docs))).count() == 0
    words = spark.createDataFrame([("alpha", 2), ("alpha", 3), ("alpho", 2), (None, 9), ("", 4)], "word string, n bigint")
    assert sorted(tuple(r) for r in S.variants(words).select("word", "n", "n_near", "form").collect()) == [("alpha", 5, 1, None), ("alpho", 2, 1, "alpha")]
