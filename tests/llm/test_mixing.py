"""Mixing against water filling by repeated resharing."""

import re

import pytest

from vicinal.llm import mixing as M

ROWS = [(i, "w " * (i % 40), f"s{i % 5}") for i in range(600)] + [(1000 + i, "one two", None) for i in range(40)] + [(2000, None, "s0"), (2001, "", "zero"), (2001, "", "zero"), (None, "a b c", "s1"), (2003, "x\x0by\x85z\u00a0q", "é"), (2004, "y " * 5000, "Z")]


def brute(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id bigint, text string, source string, size string").repartition(3)


def planned(docs, **options):
    return M.plan_mix(docs, **options).collect()


@pytest.mark.parametrize("options", [{}, {"broadcast_sources": 0}])
def test_targets_and_taken(docs, options):
    sizes = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(M.WORD, text or ""))
    want, taken = brute(sizes), {}
    rows = planned(docs, **options)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.source == r.source and r[M.SOURCE_SIZE] == sizes[r.source] and r[M.TARGET] == pytest.approx(want[r.source])
        assert r[M.SIZE] == len(re.findall(M.WORD, r.text or "")) and 0 <= r[M.COPIES] <= 3
        taken[r.source] = taken.get(r.source, 0) + r[M.SIZE] * r[M.COPIES]
    for s, n in taken.items():
        assert want[s] == pytest.approx(n, rel=0.25, abs=5000 if s == "Z" else 60)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_and_columns_stay(docs):
    a, b = (sorted((r.doc_id or -1, r.mix_copy) for r in M.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert a == b
    assert M.mix(docs).columns == [*docs.columns, "mix_copy"]


def test_empty_table(docs):
    assert M.mix(docs.limit(0)).count() == 0


def test_one_source_is_taken_once(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.mix_copy) for r in M.mix(docs).collect()) == [(1, 1), (2, 1)]


def test_many_sources_and_clashing_columns(spark):
    """Ranks and sums of sources come from several ranges; columns of the input stay, whatever their names."""
    rows = [(i, "w " * (1 + i * i % 97), f"src{i % 500:03d}" if i % 500 else None, i, 1.5, "x") for i in range(2500)]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, mix_copy int, {M.SIZE} double, __mix_source string").repartition(6)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    goal = M.targets(spark.createDataFrame([*sizes.items()], "source string, size bigint").repartition(5)).collect()
    assert {r.own_source: r.target for r in goal} == pytest.approx(brute(sizes))
    got = M.mix(df)
    assert got.columns == [*df.columns, "mix_copy_"] and {r.doc_id: r.mix_copy for r in got.collect()}.items() <= {r[0]: r[3] for r in rows}.items()
