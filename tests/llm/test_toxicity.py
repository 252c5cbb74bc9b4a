"""Toxicity: the transducers against plain rules, word by word, and held-out accuracy on planted words."""

import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinal.llm import toxicity as X

MODEL = {"stems": {"zork": 6.0, "blat$": 5.0}, "base": -4.0, "arcs": {"stem": 0.5, "insult": 1.0, "target": 0.5, "negation": -2.0, "speech": -1.5, "threat": 0.1, "intent": 2.0}}


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ("a zorkish thing", ["I"]), ("blat", ["I"]), ("blatant", []), ("you are a zork", ["IX"]), ("not a zork", ["IN"]), ("she said he is a zork", ["IXR"]), ("\"zork\" it is", ["IR"]), ("\"so\" zork", ["I"]),
        ("i will kill you", ["W"]), ("you will kill", ["WX"]), ("kill", ["V"]), ("never will you kill", ["WXN"]), ("not one two three four zork", ["I"]),
        ("She said: you are a zork", ["IXR"]), ("he said you\nare a zork", ["IXR"]), ("not\na zork", ["IN"]), ("\"So. You are a zork. Blat!\" he said", ["IXR", "IR"]), ("\"So.\n\nzork", ["I"]), ("she said so. you are a zork", ["IX"]), ("not good. zork", ["I"]),
    ],
)
def test_clauses(text, flags):
    assert [f for f, _ in X.Grammar(MODEL).matches(text)] == flags


def plain(words):
    """Flags of each hit by looking back from it, without any automaton."""
    out = []
    for i, w in enumerate(words):
        hit = "I" if w.startswith("zork") or w == "blat" else "V" if w == "kill" else ""
        if not hit:
            continue
        clause = 0
        for k in range(i):
            if words[k] == ".":
                clause = k + 1
        back = words[clause:i]
        if hit == "V" and any(x in ("will", "want") for x in back[-3:]):
            hit = "W"
        flags = hit + ("X" if any(x in ("you", "she") for x in back[-4:]) else "") + ("N" if "not" in back[-3:] else "")
        quotes, speech = 0, False
        for x in words[:i]:
            if x == '"':
                quotes, speech = (0, False) if quotes else (1, False)
            elif x == "." and not quotes:
                speech = False
            elif x == "said" and not quotes:
                speech = True
        out.append(flags + ("R" if quotes or speech else ""))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["zork", "zorky", "blat", "kill", "will", "want", "you", "she", "not", "said", '"', ".", "a", "b", "c"]), max_size=25))
def test_the_composed_transducers_equal_plain_rules(words):
    assert [f for f, _ in X.Grammar(MODEL).matches(" ".join(words))] == plain(words)


def test_a_score_is_the_sum_of_its_paths():
    g = X.Grammar(MODEL)
    assert g.matches("Not good. Zork!") == [("I", 6.0)]
    arcs = MODEL["arcs"]
    for text, z in (("", -4), ("clean", -4), ("zork", -4 + 3 + 1), ("not a zork", -4 + 3 + 1 - 2), ("you zork. you zork", -4 + 2 * (3 + 1 + 0.5)), ("zork " * 9, -4 + 3 * 4), ("i will kill", -4 + 0.1 + 2)):
        assert g.score(text) == pytest.approx(1 / (1 + math.exp(-z))), text
    assert g.score("NOT A ZORK") == g.score("not a zork") < g.score("zork") < g.score("zork. zork.") and arcs == MODEL["arcs"]
    many = X.Grammar(MODEL | {"stems": MODEL["stems"] | {f"st{a}{b}x": 1.0 for a in "abcdefghij" for b in "abcdefghij"}})
    assert many.matches("a stbcxy. zork") == [("I", 1.0), ("I", 6.0)] and many.matches("stbc") == []


def test_weights_follow_the_labels_and_else_the_priors():
    f = lambda **k: [float(k.get(a, 0)) for a in X.ARCS]
    rows = [(f(), 1, 1000), (f(stem=4, insult=1), 90, 100), (f(stem=4, insult=1, negation=1), 5, 100), (f(stem=4, insult=1, speech=1), 60, 100)]
    base, arcs = X.learned(rows, 0.05)
    p = lambda x: 1 / (1 + math.exp(-base - sum(arcs[a] * v for a, v in zip(X.ARCS, x, strict=True))))
    for x, pos, n in rows:
        assert p(x) == pytest.approx(pos / n, abs=0.03)
    assert arcs["threat"] == pytest.approx(X.ARCS["threat"]) and arcs["intent"] == pytest.approx(X.ARCS["intent"])
    assert X.learned([], 0.05)[1] == pytest.approx(X.ARCS)


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(900)]


def text_of(i, rnd):
    words = [f"w{rnd.choice('abcdef')}{rnd.choice('ghij')}{rnd.choice('klm')}" for _ in range(60)]
    if i % 5 == 0:
        for _ in range(3):
            words[rnd.randrange(60)] = rnd.choice(["zorkel", "zorkun", "zorkat", "Blat,"])
    return " ".join(words)


@pytest.fixture
def tables(spark):
    rnd = random.Random(3)
    docs = [(i, text_of(i, rnd), "en") for i in range(900)] + [(5000, None, "en"), (5001, "", "en"), (5002, "clean " * 50000 + "zorkel blat zorkun", "en"), (None, "zorkel blat", "en"), (10, "again", "en")]
    labels = [*LABELS, (None, 1, 1), (5000, 1, None), (3, 0, 0), (77777, 1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, label string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(tables):
    docs, labels = tables
    model = X.fit(docs, labels)
    assert set(model["stems"]) == {"zork", "blat$"}
    rows = {r.doc_id: r.toxicity for r in X.score_toxicity(docs, model).filter("text != 'again' or text is null").collect()}
    held = [i for i, _, _ in LABELS if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and all((rows[i] >= X.THRESHOLD) == (i % 5 == 0) for i in held if i != 10)
    assert rows[5002] >= X.THRESHOLD and rows[None] >= X.THRESHOLD and rows[5000] == rows[5001] < X.THRESHOLD
    assert all(0 <= s <= 1 for s in rows.values())
    kept = X.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id % 5 = 0 and doc_id < 900 and doc_id <> 10").count() == 0 and kept.filter("doc_id % 5 > 0 and doc_id < 900").count() == 720


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    assert X.fit(docs, labels) == X.fit(docs, turned)


def test_empty_tables(tables):
    docs, labels = tables
    model = X.fit(docs, labels.limit(0))
    assert model["stems"] == {} and {r.toxicity < X.THRESHOLD for r in X.score_toxicity(docs, model).collect()} == {True}
    assert X.score_toxicity(docs.limit(0), X.fit(docs.limit(0), labels)).count() == 0


def test_clashing_columns_are_kept(tables):
    docs, labels = tables
    model, odd = X.fit(docs, labels), docs.selectExpr("*", "1 as toxicity", "2 as result", "3 as __r")
    assert X.keep_clean(odd, model).columns == odd.columns
    with pytest.raises(ValueError, match="already"):
        X.score_toxicity(odd, model)


def test_near_copies_support_a_stem_once(spark):
    """One toxic text and 200 copies of it, some with another ending, make no stem of its words."""
    rnd = random.Random(8)
    odd = " ".join(f"odd{rnd.choice('abcdefgh')}{rnd.choice('ijklmnop')}" for _ in range(200))
    docs = [(i, odd + (" x" if i % 2 else "")) for i in range(200)] + [(i, text_of(i, rnd)) for i in range(1000, 1900)]
    labels = [(i, 1) for i in range(200)] + [(i, int(i % 5 == 0)) for i in range(1000, 1900)]
    model = X.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert set(model["stems"]) == {"zork", "blat$"}
