"""The pipeline against plain loops over a small corpus, and the contract of its stages."""

import random

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import brute as targets
from tests.llm.test_neardup import brute as copies
from tests.llm.test_toxicity import text_of
from vicinal.llm import toxicity
from vicinal.llm.common import table

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(5)
    docs = []
    for i in range(300):
        text = text_of(i, rnd)
        if i % 7 == 1:
            text += f" {PASSAGE} end"
        if i % 11 == 3:
            text = docs[-1][1] + " more"
        docs.append((i, text, "en", None if i % 13 == 0 else f"s{i % 4}", len(text)))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_equals_plain_loops(spark, folder):
    at, docs = folder
    grammar = toxicity.Grammar(toxicity.fit(table(spark, at, "documents"), table(spark, at, "labels")))
    left = [d for d in docs if grammar.score(d[1] or "") < toxicity.THRESHOLD]
    classes = copies([(d[0], d[1]) for d in left])
    left = [d for d in left if classes[d[0]][1] == d[0]]
    left = [d for d, (_, hit, _) in zip(left, contaminated([d[1] for d in left], [(1, PASSAGE)]), strict=True) if not hit]
    sizes = {}
    for d in left:
        sizes[d[3]] = sizes.get(d[3], 0) + len((d[1] or "").split())
    goal = targets(sizes)
    got = P.run(spark, at).collect()
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert tuple(r)[:5] == next(d for d in docs if d[0] == r.doc_id)
    assert len(docs) * 0.5 < len(left) < len(docs) and set(times) <= {d[0] for d in left}
    for d in left:
        rate = goal[d[3]] / sizes[d[3]]
        assert int(rate) <= times.get(d[0], 0) <= int(rate) + 1


def test_stages(spark, folder):
    at, docs = folder
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing"]
    df = table(spark, at, "documents")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, df, at).columns == df.columns
    assert P.STAGES[-1][1](spark, df, at).columns == [*df.columns, "mix_copy"]
    assert P.STAGES[1][1](spark, df.limit(0), at).count() == 0


def test_near_copies_from_0_80_are_dropped(spark):
    """Pairs with a similarity of 0.80 to 0.849, which the stage drops, and of 0.78, which it keeps."""
    rnd = random.Random(3)
    rows, gone = [], set()
    for i in range(30):
        both = [f"w{rnd.random()}" for _ in range(104)]
        left, right = ([f"{x}{rnd.random()}" for _ in range((10, 12, 14)[i % 3])] for x in "ab")  # 100 of 120, 124, 128 shingles
        rows += [(2 * i, " ".join(both + left)), (2 * i + 1, " ".join(both + right))]
        gone |= {2 * i + 1} if i % 3 < 2 else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in P.drop_copies(spark, docs, "").collect()} == {i for i, _ in rows} - gone


def test_columns_of_any_name_stay(spark, folder):
    """Names that stages use inside, and the last one's own, are kept with their values through every stage."""
    at, docs = folder
    df = table(spark, at, "documents").selectExpr("*", "1 as result", "2 as mix_copy", "3 as __mix_size", "4 as gone", "5 as comp", "6 as toxicity")
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, at)
        assert df.columns[5:] == ["result", "mix_copy", "__mix_size", "gone", "comp", "toxicity"]
    got = P.STAGES[-1][1](spark, df, at)
    assert got.columns == [*df.columns, "mix_copy_"]
    assert {tuple(r) for r in got.select(*df.columns[5:]).distinct().collect()} == {(1, 2, 3, 4, 5, 6)}
