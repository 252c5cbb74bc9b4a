"""Near-duplicates against all pairs."""

import math
import random
import re

import numpy as np
import pytest

from vicinal.llm import neardup as N


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in sets if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def texts():
    rnd = random.Random(7)
    fresh = lambda n: [f"w{rnd.randrange(100_000)}" for _ in range(n)]
    rows, at = [], 0

    def add(words):
        nonlocal at
        at += 1
        rows.append((at * 3 % 1009, " ".join(words)))

    for size in (60, 200, 400):
        for edits in range(12):  # copies of one base, ever more edited: links, near misses and chains
            base = fresh(size)
            for _ in range(3):
                w = [*base]
                for _ in range(edits * size // 400):
                    w[rnd.randrange(size)] = f"e{rnd.random()}"
                add(w)
            add(base[: size - edits])
    passage = fresh(40)
    for _ in range(60):
        add(passage + fresh(5))  # one passage is most of many documents
    chain = fresh(300)
    for _ in range(40):
        chain = [*chain]
        chain[rnd.randrange(300)] = f"c{rnd.random()}"
        add(chain)  # neighbours are linked, the ends are not
    rows += [(2000 + i, "copy of one text in six words") for i in range(50)] + [(3000, "Copy OF\none text\tin six words"), (3001, "a b"), (3002, "A  b"), (3003, "b a"), (3004, ""), (3005, None), (3006, "   ")]
    return [*{i: (i, t) for i, t in rows}.values()]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, node int").repartition(4)


def classes(df, **options):
    rows = N.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}


def test_equals_all_pairs(frame):
    rows = texts()
    assert classes(frame(rows)) == brute(rows)


def test_large_prefixes_are_cut_in_blocks(frame, monkeypatch):
    """With tiny nodes every path is walked to its end and what is left is compared in blocks."""
    monkeypatch.setattr(N, "SMALL", 8)
    rows = texts()
    assert classes(frame(rows)) == brute(rows)


def test_null_ids_repeated_rows_and_long_texts(frame):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "other words here are five six"), (3, "other words here are five six"), (None, long), (None, None)]
    got = N.near_duplicates(frame(rows)).collect()
    assert len(got) == 6
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, None: None}
    assert all(r.kept for r in got if r.doc_id in (None, 3))
    kept = N.keep_one(frame(rows))
    assert kept.columns == ["doc_id", "text", "node"] and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None", "None"]


def test_empty_table(frame):
    assert N.near_duplicates(frame(texts()).limit(0)).count() == 0


def test_linked_pairs_are_exact():
    rnd = random.Random(1)
    sets = [np.array(sorted(rnd.sample(range(300), rnd.randrange(1, 290))), np.uint64) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len({*sets[i]} & {*sets[j]}) >= 60 * len({*sets[i]} | {*sets[j]})}
    assert {*N.linked_pairs(sets, 60)} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 51), (51, 60), (7, 7)]
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {51: 50, 60: 50, 100: 50}


@pytest.mark.parametrize("percent", [50, 65, 70, 80, 85, 100])
def test_sketches_refuse_few_links_at_any_threshold(percent):
    p = percent / 100 + (1 - percent / 100) / 256
    missed = sum(math.comb(N.HASHES, k) * p**k * (1 - p) ** (N.HASHES - k) for k in range(N.plausible(percent)))
    assert missed <= 1e-5


def template_rows(spark, n):
    """Groups that are compared among n pages of one template, none linked with another: 200 words, 5 of them a page's own."""
    rnd = random.Random(n)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(n):
        w = [*base]
        for k in rnd.sample(range(200), 5):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    signed = N.signatures(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 5)
    nodes = N.staged(signed.selectExpr("doc_id as node", "a", "b", "signature", "n_shingles"), "nodes")
    none = spark.createDataFrame([], "node bigint, comp bigint")
    groups, _ = N.shared_paths(nodes, none, range(2, 6), N.DEPTH)
    return groups.count(), groups.groupBy("key").count().agg({"count": "max"}).first()[0]


def test_template_pages_cost_in_proportion(spark, monkeypatch):
    """Four times the pages are some four times the rows, in groups that stay small; no group holds all pairs of blocks."""
    monkeypatch.setattr(N, "SMALL", 32)
    (few, _), (many, largest) = template_rows(spark, 400), template_rows(spark, 1600)
    assert many < 7 * few and largest <= 4 * 32


def test_large_stars_are_dealt_with_apart(spark, monkeypatch):
    monkeypatch.setattr(N, "LARGE_STAR", 0.01)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 399) for i in range(300)] + [(5000, 5001)]
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {1000 + i: 0 for i in range(300)} | {5001: 5000}


@pytest.mark.parametrize(("name", "value"), [("GROUP_SHINGLES", 100), ("JOB", 3)])
def test_classes_are_confirmed_in_parts(frame, monkeypatch, name, value):
    """Pair by pair where sets are long, and in blocks where there are many."""
    monkeypatch.setattr(N, name, value)
    rows = texts()
    assert classes(frame(rows)) == brute(rows)


def test_nothing_but_the_result_is_left_behind(spark, frame):
    import os

    from vicinal.sources.shared import shared_dir

    before = {*os.listdir(shared_dir(spark))}
    df = N.near_duplicates(frame(texts()))
    left = {x.rsplit("-", 1)[0] for x in {*os.listdir(shared_dir(spark))} - before}
    assert left == {"signatures", "classes"} and df.count() > 0  # what the result is read from


def test_recall_on_pages_of_one_template(frame, monkeypatch):
    """Chains of pages, each three words from the one before and linked with it alone, among 900 pages that share most of their words: paths go deep."""
    monkeypatch.setattr(N, "SMALL", 32)
    rnd = random.Random(5)
    base, rows, links = [f"t{i}" for i in range(220)], [], []
    while len(rows) < 900:
        own = [*base]
        for k in rnd.sample(range(220), 6):
            own[k] = f"c{len(rows)}x{k}"
        for turn in range(rnd.choice([1, 1, 2, 4, 8])):
            own = [*own]
            for k in rnd.sample(range(220), 3):
                own[k] = f"d{len(rows)}x{k}"
            links += [(len(rows) - 1, len(rows))] * (turn > 0)
            rows.append((len(rows), " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in links if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got, want = classes(frame(rows)), brute(rows)
    assert len(links) > 400 and sum(got[i][1] == got[j][1] for i, j in links) >= 0.99 * len(links)
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(rows)



def test_few_links_need_no_staging(spark, monkeypatch):
    """Smallest neighbours of few links are broadcast; of many they are shuffled. The classes are the same."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 51), (51, 60)], "u bigint, v bigint")
    assert not hasattr(N.beside_least(edges, 43), "staged_at")
    few = sorted(map(tuple, N.components(edges).collect()))
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    assert few == sorted(map(tuple, N.components(edges).collect()))


def test_staging_leaves_no_shuffle_files(spark):
    """A staged table is read from its files, so what was shuffled to make it goes at once."""
    import time

    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in env.getAllFiles().mkString(",").split(",") if "shuffle_" in x}
    before = held()
    N.staged(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
