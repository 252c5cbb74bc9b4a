"""LM scoring against a brute-force tree: own loops over whole texts, from words to scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from vicinal.llm import lm

ROWS = [(i, " ".join(random.Random(i % 37).choices(["the", "Cat", "sat", "on", "a", "mat,", "dog"], k=5 + i % 50))) for i in range(400)]
ROWS += [(1000, None), (1001, ""), (1002, " \n "), (1003, "unseen words here \x0b x"), (None, "null id"), (1004, "the cat " * 20000), (5, "same id other text"), (1005, "twice"), (1005, "twice")]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows, depth=3, least=2, gain=2.0):
    """(id, held out, tokens, known, N, base, score) of each row: contexts of all lengths counted, tested and walked in plain dicts."""
    texts = [tokens(t) for i, t in rows if not held_out(i)]
    grams = collections.Counter(tuple(t[i : i + k]) for t in texts for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    counts = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(counts.values()), len(counts)
    follow = collections.defaultdict(list)
    for g, c in grams.items():
        if len(g) > 1 and c >= 2:
            follow[g[:-1]].append((g[-1], c))
    kept = {}

    def p(context, w):
        if not context:
            return (counts.get(w, 0) + 1) / (n + v + 1)
        below = p(context[1:], w)
        if context not in kept or not kept[context][0]:
            return below
        c = grams[context + (w,)]
        return (max(c - 0.75 if c >= 2 else 0, 0) + (kept[context][1] + 1) * below) / (grams[context] + 1)

    for size in range(1, depth + 1):
        for s in [g for g, c in grams.items() if len(g) == size and c >= least and None not in g]:
            total, listed = grams[s], follow.get(s, [])
            mass = sum(c for _, c in listed)
            rest = total - mass + 0.75 * len(listed)
            won = -mass * math.log(total) + (rest * math.log(rest / total) if rest else 0)
            for w, c in listed:
                steps = min(255, max(0, round(-math.log(p(s[1:], w)) / (math.log(2) / 2))))
                won += c * (math.log(c - 1.75) + steps * math.log(2) / 2)
            kept[s] = (bool(listed) and won >= gain * len(listed), rest)
    out = []
    for i, x in rows:
        t = tokens(x)
        score = 0.0
        for k, w in enumerate(t):
            score += math.log10(p(tuple(t[max(0, k - depth) : k]), w))
        out.append((str(i), held_out(i), len(t), sum(counts.get(w, 0) > 0 for w in t), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t), score))
    return sorted(out), kept, p


def check(rows, got, **options):
    want, kept, _ = brute(rows, **options)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.array([g[5:] for g in got]) == pytest.approx(np.array([w[5:] for w in want]), rel=1e-9, abs=1e-9)
    return kept


@pytest.fixture
def frame(spark):
    return lambda rows, parts=3: spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row int").repartition(parts)


@pytest.mark.parametrize("options", [{}, {"depth": 1}, {"least_context": 5}])
def test_equals_brute_force(frame, options):
    kept = check(ROWS, lm.score_texts(frame(ROWS), **options).collect(), **{"least" if k == "least_context" else k: x for k, x in options.items()})
    assert sum(k for k, _ in kept.values()) > 5


def prose(n, seed, words=400):
    """Zipf-like words, one of them a third of all, with passages that repeat."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    passages = [rnd.choices(vocabulary, weights, k=12) for _ in range(10)]
    out = []
    for i in range(n):
        t = rnd.choices(vocabulary, weights, k=rnd.randrange(1, 120))
        t = [x for w in t for x in ((w, "of") if rnd.random() < 0.4 else (w,))]
        if i % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = rnd.choice(passages)
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("hot", [0.001, 0.02, 2.0])
def test_hot_contexts_small_chunks_and_many_buckets(frame, monkeypatch, hot):
    """Chunks of some texts, texts of several chunks, buckets of some contexts, contexts in parts or whole: the same scores."""
    for name, value in (("CHUNK", 300), ("BUCKET", 700), ("HOT", hot), ("SALTS", 5)):
        monkeypatch.setattr(lm, name, value)
    rows = [*prose(150, 3), (500, " ".join(random.Random(9).choices([f"w{i}" for i in range(30)], k=2500))), (501, None)]
    kept = check(rows, lm.score_texts(frame(rows)).collect())
    assert {len(s) for s, (k, _) in kept.items() if k} == {1, 2, 3}


def test_texts_that_occur_twice_score_apart(frame):
    """Both copies are in the training rows: every context of theirs is seen twice, in a corpus of any size."""
    train = [i for i in range(4000) if not held_out(i)]
    fresh = lambda i: " ".join(random.Random(i).choices([f"v{k}" for k in range(3000)], k=60))
    rows = [(i, fresh(i)) for i in train[:1000]] + [(train[1000 + i], fresh(train[i])) for i in range(40)]
    gained = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score_texts(frame(rows)).collect()}
    twice = [gained[i] for i in [*train[:40], *train[1000:1040]]]
    assert min(twice) > 1 > max(gained[i] for i in train[40:1000])


def test_each_state_is_a_distribution():
    rows = prose(200, 5, words=20)
    _, kept, p = brute(rows)
    words = {w for i, t in rows if not held_out(i) for w in tokens(t)}
    for s in [(), ("w0",), *[s for s, (k, _) in kept.items() if k][:200]]:
        assert sum(p(s, w) for w in words) + p(s, "unknownword") == pytest.approx(1)


def test_empty_tables_and_no_training_rows(spark, frame):
    assert lm.score_texts(frame(ROWS).limit(0)).count() == 0
    i = next(i for i in range(100) if held_out(i))
    r = lm.score_texts(spark.createDataFrame([(i, "a b")], "doc_id bigint, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0)


def test_nothing_is_left_behind(spark, frame):
    import os

    from vicinal.sources.shared import shared_dir

    before = {*os.listdir(shared_dir(spark))}
    df = lm.score_texts(frame(ROWS[:50]))
    left = {*os.listdir(shared_dir(spark))} - before
    assert df.count() == 50 and len(left) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


@pytest.mark.parametrize("kind", ["u1", "u4", "u8"])
def test_packed_numbers(kind):
    rnd = np.random.default_rng(1)
    for x in (np.zeros(0, kind), rnd.integers(0, 200, 1000).astype(kind), np.array([np.iinfo(kind).max, 0, 1], kind)):
        assert lm.unpacked(lm.packed(x), kind).tolist() == x.tolist()


def test_distinct_numbers_and_their_places():
    """One sort of numbers with their places says what np.unique does, and numbers that are too large for it go there."""
    rnd = np.random.default_rng(3)
    for size, limit in ((0, 5), (1, 1), (1000, 7), (1000, 1 << 40), (1000, 1 << 60)):
        x = rnd.integers(0, limit, size)
        key, place, first = lm.distinct(x, limit)
        assert key.tolist() == np.unique(x).tolist() and key[place].tolist() == x.tolist() and x[first].tolist() == key.tolist()


def test_questions_name_contexts_in_few_bytes_and_words_go_after_the_first(spark, frame, monkeypatch):
    """Contexts of two words or more are numbers in order, not hashes of 6 bytes, and no hashes of words lie beside the chunks while later questions are shuffled."""
    import os

    from vicinal.sources.shared import shared_dir

    monkeypatch.setattr(lm, "CHUNK", 8000)
    before, counted, hashes, asked_for = {*os.listdir(shared_dir(spark))}, {}, {}, lm.answers

    def watched(asked, level, *rest):
        sent = [bytes(r.contexts) for r in asked.select("contexts").collect()]
        counted[level] = sum(map(len, sent)) / sum(int.from_bytes(x[:8], "little") for x in sent)
        (at,) = [p for p in {*os.listdir(shared_dir(spark))} - before if p.startswith("chunks-") and p.count("-") == 1]
        hashes[level] = spark.read.parquet(f"{shared_dir(spark)}/{at}").filter("hashes is not null").count()
        return asked_for(asked, level, *rest)

    monkeypatch.setattr(lm, "answers", watched)
    rows = prose(600, 4)
    check(rows, lm.score_texts(frame(rows, 1)).collect())
    assert [*counted] == [0, 1, 2, 3] and max(counted[2], counted[3]) < 1.5, counted
    assert hashes[0] and not hashes[1] + hashes[2] + hashes[3]
