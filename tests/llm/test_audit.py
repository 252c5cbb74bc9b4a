"""The filter audit against a plain simulation of every order."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vicinal.llm import audit as A

RND = random.Random(3)
LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (0, LONG + " $", "b"), (3, LONG + " $", None), (4, None, "a"), (5, "", None), (6, None, ""), (7, "UPPER CASE # TEXT", "b"), (None, LONG, "a"), (None, "", "a"), (8, "é" * 40 + "A" * 2, "b"), (9, "A" * 2 + "é" * 37, "b"),
    (10, "w " * 50, "a"), (11, " \t\n\x0b\x0c\r", "a"), (12, "a b c \x1f\x00 x" * 30, "b"), (13, "same same " * 5000, "b"), (14, LONG.upper(), "c"), (14, "another text of one id", "c"),
] + [(100 + i, " ".join(RND.choice(["alpha", "Beta", "gamma|", "d", "épsilon", f"n{i}"]) for _ in range(RND.choice([5, 49, 50, 51, 80]))), RND.choice("abc")) for i in range(120)]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (4, 1, 1), (7, 0, 1), (14, 1, 1), (9999, 1, 1)] + [(100 + i, i % 2, i % 3 == 0) for i in range(0, 120, 2)]


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t and i is not None}
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        docs.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, share = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                share[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(share[key[1][key[2] - 1]])
    return out


def frames(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, words string, digest int").repartition(3)
    return docs, spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in labels], "doc_id bigint, quality int, toxic int, text string")


def test_equals_simulation(spark):
    got = A.audit(A.masks(*frames(spark)), "ABCDE")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == ["part", "filter_order", "step", *names]
    rows = got.collect()
    want = brute(ROWS, LABELS)
    assert len(rows) == len(want) == 120 * 5 * len({r[2] or "" for r in ROWS})
    for r in rows:
        assert [r[n] for n in names] == want[r["part"], r.filter_order, r.step]


def test_empty_tables(spark):
    docs, labels = frames(spark)
    assert A.audit(A.masks(docs.limit(0), labels), "ABCDE").count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in A.audit(A.masks(docs, labels.limit(0)), "ABCDE").collect()} == {(0, 0)}


def test_other_filters(spark):
    cells = A.masks(*frames(spark), filters={"X": "words > 60", "Y": "symbols = 0"})
    got = {(r["part"], r.filter_order, r.step): r.removed for r in A.audit(cells, "XYE").collect()}
    assert len(got) == len({r[2] or "" for r in ROWS}) * 18
    assert got["c", "XYE", 1] == sum(len(r[1].split()) > 60 for r in ROWS if r[2] == "c")


@pytest.mark.parametrize("values", [A.VALUES, np.zeros(256, np.uint64)])
def test_counts_of_any_text(monkeypatch, values):
    """Also where all words of one length share a hash, and where texts are cut into pieces."""
    monkeypatch.setattr(A, "VALUES", values)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "B", "é", "語", "𝄞", " ", "\n", "\x0b", "#", " ", "longer words than eight bytes ", "longer wordt"]) for _ in range(rnd.choice([0, 1, 7, 300]))) for _ in range(200)]
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    want = [[len(w := re.findall(r"[^\x20\x09-\x0D]+", t)), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)] for t in texts]
    assert A.Scanner()(data, off).tolist() == want
    monkeypatch.setattr(A, "SLICE", 50)
    assert [A.Scanner().huge(data[a:z]) for a, z in zip(off[:-1], off[1:], strict=True)] == want


def test_buffers_of_sliced_columns_and_nulls():
    column = pa.array(["x", None, "", "abc", None, "é"]).slice(1, 4)
    data, off = A.buffers(column)
    assert data.tobytes() == b"abc" and off.tolist() == [0, 0, 0, 3, 3]
    data, off = A.buffers(pa.array([None, ""], pa.large_string()))
    assert len(data) == 0 and off.tolist() == [0, 0, 0]


def test_a_very_long_text_and_many_copies(spark):
    rows = [(1, "Ab # " * 1_500_000, "s")] + [(10 + i, "copy of a text", "s") for i in range(3000)]
    got = {(r.filter_order, r.step): r for r in A.audit(A.masks(*frames(spark, rows, [])), "ABCDE").collect()}
    assert got["EABCD", 1].removed == 2999 and got["DABCE", 1].removed == 1 and got["CABDE", 1].removed == 1 and got["ABCDE", 5].kept == 0
