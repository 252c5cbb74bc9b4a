"""Token counts against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinal.llm import tokens as K
from vicinal.llm.common import loaded_tokenizer

PATHS = {n: public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
DATA = {n: open(p, encoding="utf-8").read() for n, p in PATHS.items()}
WORDS = ["the", "Of", "don't", "we'll", "naïve", "漢字", "x1y22", "<|endoftext|>", "<|startoftext|>a", "é", "́", "😀👩‍👩‍👧", "İ", "ΣΑΣ", "...", "a b", "c\x85d", "--", "1234567", "supercalifragilistic", "\x00", "q\x1cr"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "\n", "\t", "  ", "", "\r\n", "\x0b"]) for _ in range(rnd.randrange(400))) for _ in range(n)]


def library(name, text):
    t = loaded_tokenizer(DATA[name])
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [*PATHS])
def test_huge_texts_are_spliced_exactly(name):
    for x in [*texts(40, 1), "a" * 3000, " " * 3000, "ab " * 1000, "x" * 900 + " " + "y" * 900 + " z", "\n\n \n" * 500]:
        assert np.concatenate(K.encode_huge(loaded_tokenizer(DATA[name]), x, 120, 24)).tolist() == library(name, x)


@pytest.mark.parametrize("name", [*PATHS])
def test_counts_equal_the_library(spark, name):
    rows = [*texts(60, 2), None, "", " ", "a" * 70_000, "the cat " * 20_000, "the cat " * 20_000, "no space" * 6000]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(rows)], "doc_id bigint, text string, n_tokens int").repartition(3)
    got = K.count_tokens(df, PATHS[name])
    assert got.columns == [*df.columns, "counts"]
    for r in got.collect():
        assert (r.counts.n_bytes, r.counts.n_tokens) == (len((r.text or "").encode()), len(library(name, r.text)))


def test_white_space_rule():
    assert K.keeps_no_space(loaded_tokenizer(DATA["word_bpe_49k.json"]))
    assert not K.keeps_no_space(loaded_tokenizer(DATA["byte_bpe_50k.json"]))


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 50)
    c = K.Counter(DATA["word_bpe_49k.json"], K.HUGE, K.CHUNK, K.OVERLAP)
    for x in texts(10, 3):
        assert c.batch([x.encode()]) == [len(library("word_bpe_49k.json", x))]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    c = K.Counter(DATA["word_bpe_49k.json"], K.HUGE, K.CHUNK, K.OVERLAP)
    assert c.batch([text.encode()]) == [len(library("word_bpe_49k.json", text))]


def test_empty_table(spark):
    assert K.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATHS["word_bpe_49k.json"]).count() == 0
