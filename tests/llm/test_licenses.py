"""License scans against a loop over all places."""

import random
import re

import pytest

from vicinal.llm import licenses as L

RND = random.Random(2)
TEXTS = [
    None, "", " .,;", "MIT License", "mit-license mit, LICENSE; apache\nlicense", "the MIT licence and the license of MIT", "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "under the apache license version 2 0", "licensed under the apache",
    "This work is licensed under the GNU General Public License, version 3.", "general public license general public license", "Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0", "licensed beneath cc by nc 4 0 x", "zürich mit license é", "mit license " * 4000, "filler words " * 3000 + "mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any body obtaining one copy of that software", "mit mit license license apache apache license",
]
ROWS = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6]), (6, TEXTS[6]), (6, "other text of the id: mit license"), (None, TEXTS[6])]
ROWS += [(100 + i, " ".join(RND.choice(["mit", "license", "apache", "general", "public", "gnu", "the", "licensed", "under", "version", "2", "0", "cc", "by", "4", "x"]) for _ in range(60))) for i in range(150)]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, phrases=L.PHRASES, templates=L.TEMPLATES, rare=L.RARE, share=L.SHARE):
    docs = [(i, words(t)) for i, t in rows]
    counts = {}
    for _, w in docs:
        for x in set(w):
            counts[x] = counts.get(x, 0) + 1
    out = []
    for i, w in docs:
        base, labels, score = [], set(), 0.0
        for phrase, label in phrases:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            base += [(k, label) for k in at]
            score = max(score, 0.5 if at else 0.0)
        for label, text, keys in templates:
            t = text.split()
            chosen = sorted(set(t), key=lambda x: (counts.get(x, 0), x))[:rare]
            for start in range(1 - len(t), len(w)):
                pairs = [(w[start + k], t[k]) for k in range(len(t)) if 0 <= start + k < len(w)]
                if not any(a == b and b in chosen for a, b in pairs):
                    continue
                alike = sum(a == b for a, b in pairs) / len(t)
                inside = " " + " ".join(w[max(start, 0) : start + len(t)]) + " "
                if alike >= share and all(f" {k} " in inside for k in keys):
                    labels.add(label)
                    score = max(score, alike)
        own = sorted({b[1] for b in base})
        out.append((i, len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, own, sorted({*own, *labels}), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"broadcast_postings": 0}, {"rare": 1, "share": 0.9}])
def test_equals_all_places(spark, options):
    rows = ROWS if not options else [r for r in ROWS if len(r[1] or "") < 20_000]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id bigint, text string, w string, n int").repartition(3)
    got = L.scan(df, **options)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    options.pop("broadcast_postings", None)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, **options)


def test_other_lists(spark):
    df = spark.createDataFrame([(1, "a b c a b"), (2, "x a b")], "doc_id bigint, text string")
    only = {r.doc_id: tuple(r)[1:] for r in L.scan(df, phrases=[("A b", "l")], templates=[]).collect()}
    assert only == {1: (5, 2, 0, 3, ["l"], ["l"], 0.5), 2: (3, 1, 1, 1, ["l"], ["l"], 0.5)}
    none = L.scan(df, phrases=[], templates=[]).collect()
    assert {(r.n_base, tuple(r.labels), r.score) for r in none} == {(0, (), 0.0)}
    later = L.scan(df, phrases=[], templates=[("t", "q b c a", ["b c"])]).collect()
    assert {r.doc_id: (r.labels, r.score) for r in later} == {1: (["t"], 0.75), 2: ([], 0.0)}


def test_an_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_python_on_the_path(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id bigint, text string")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
