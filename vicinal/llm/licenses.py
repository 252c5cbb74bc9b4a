r"""License scans with a positional index of rare words.

The words of all phrases and templates are counted over all documents. The index holds, for each template, the places of its `rare`
words of highest IDF, and for each phrase that of its rarest; a file looks up those of its words, whichever they are, and a place in
the file less the place in the template says where the template would begin. There its words are compared: a phrase must stand
word for word; a template is found when `share` of its words are at their places and each of its mandatory key phrases lies within.
(A fixed number of words a file would lose the second license of a long one, so what is rare is settled by template.)

Words: A-Z lower-cased, then `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. n_base counts all places of phrases, first_word and last_word are the
smallest and the largest of their starts, else null. base_labels: of phrases; labels: of templates too. The score is the largest share
of a found template, 0.5 for a phrase at least, else 0. Null or empty texts have no words. Repeated rows are judged alike and all
returned, null ids too. An empty table gives an empty table. Extra columns are ignored. Texts are read whole.

Scale: a text is read twice, for the counts and for the scan, and never leaves its task: only a row itself and what has been found in it
are shuffled, summed up before. Templates are a parameter, not data: over `broadcast_postings` entries of the index the join is a
shuffle, in which rows without a find have keys of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, SHARE = 4, 0.7
BROADCAST_POSTINGS = 20_000
#: The contract's phrases and labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Label, words of public licenses and their notices, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge", "obtaining a copy"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license", "free software foundation"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd", "licensed under the 3 clause bsd license", ["bsd license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["into the public domain"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["commons attribution 4 0"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ["all rights reserved"]),
]


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def document_counts(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the vocabulary stands, over all documents; a row a word comes to the driver."""
    held = F.array_distinct(F.filter(words_in(F.col(text_col)), lambda x: x.isin(*vocabulary)))
    return {r.word: r["count"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()}


def postings(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str, Sequence[str]]], counts: dict[str, int], rare: int) -> list[tuple]:
    """word, label, base, at, words, keys: the places of each template's rarest words, and the first of each phrase's rarest."""
    out = []
    for label, text, keys, base in [*((label, phrase, [], True) for phrase, label in phrases), *((*t, False) for t in templates)]:
        words = text.translate(str.maketrans(UPPER, LOWER)).split()
        chosen = sorted(set(words), key=lambda w: (counts.get(w, 0), w))[: 1 if base else rare]
        out += [(w, label, base, at, words, list(keys)) for at, w in enumerate(words) if w in chosen and not (base and w in words[:at])]
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES, rare: int = RARE, share: float = SHARE, broadcast_postings: int = BROADCAST_POSTINGS) -> DataFrame:
    """For each row of docs: its id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score. Texts of templates and phrases are words with spaces between."""
    vocabulary = sorted(Counter(w for text in [*(p for p, _ in phrases), *(t for _, t, _ in templates)] for w in text.lower().split()))
    index = postings(phrases, templates, document_counts(docs, vocabulary, text_col) if vocabulary else {}, rare)
    few = len(index) <= broadcast_postings
    anchors = sorted({p[0] for p in index}) or [""]
    back, ahead = max([p[3] for p in index], default=0), max([len(p[4]) - p[3] for p in index], default=1)
    right = docs.sparkSession.createDataFrame(index, "anchor string, label string, base boolean, at int, template array<string>, keys array<string>")

    # The first entry, without a word, stands for the row itself.
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), words_in(F.col(text_col)).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("bigint"))
    places = rows.select("id", "digest", "n", "w", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("p", "x")).filter((F.col("p") == 0) | F.col("x").isin(*anchors))
    low = F.greatest(F.col("p") - back, F.lit(1))
    around = F.when(F.col("p") > 0, F.slice("w", low, F.col("p") + ahead - low))
    places = places.select("id", "digest", "n", "p", "x", around.alias("around"), (F.col("p") - low).alias("centre"))
    if not few:
        places = places.withColumn("x", F.coalesce("x", F.concat(F.lit("-"), "digest", F.coalesce(F.col("id").cast("string"), F.lit("")))))
    met = places.join(F.broadcast(right) if few else right.hint("merge"), F.col("x") == F.col("anchor"), "left")

    begin, length = F.col("centre") - F.col("at"), F.size("template")  # where in `around` the template would begin, from 0
    alike = F.size(F.filter(F.sequence(F.lit(0), length - 1), lambda i: F.get("around", begin + i) == F.get("template", i))) / length
    inside = F.concat(F.lit(" "), F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, length + F.least(begin, F.lit(0))), " "), F.lit(" "))
    verified = F.when(F.col("base"), alike == 1.0).otherwise((alike >= share) & F.forall("keys", lambda k: F.contains(inside, F.concat(F.lit(" "), k, F.lit(" ")))))
    start = (F.col("p") - 1 - F.col("at")).cast("bigint")
    found = met.select("id", "digest", "n", "p", "label", "base", start.alias("start"), F.when(F.col("p") > 0, alike).alias("alike"), F.when(F.col("p") > 0, verified).alias("verified"))
    found = found.filter((F.col("p") == 0) | F.col("verified"))
    base = F.col("base")
    sets = lambda c: F.array_sort(F.collect_set(c))
    return (
        found.groupBy("id", "digest")
        .agg(
            F.max("n").alias("n_words"), F.sum((F.col("p") == 0).cast("bigint")).alias("copies"), F.sum(F.when(base, 1).otherwise(0)).alias("hits"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
            sets(F.when(base, F.col("label"))).alias("base_labels"), sets(F.col("label")).alias("labels"), F.coalesce(F.max(F.when(base, F.lit(0.5)).otherwise(F.col("alike"))), F.lit(0.0)).alias("score"),
        )
        .select(F.col("id").alias(id_col), "n_words", F.expr("hits div copies").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
        .drop("copy")
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


_quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
_ENTRIES = ", ".join(f"({k}, {base}, '{label}', string_split('{text}', ' '), {_quoted(keys)})" for k, (label, text, keys, base) in enumerate([*((label, p, [], True) for p, label in PHRASES), *((*t, False) for t in TEMPLATES)]))
SQL = rf"""
with e(id, base, label, t, keys) as (values {_ENTRIES}),
d as materialized (
  select row_number() over () as row, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'), lambda x: x <> '') as w from documents),
v as (select distinct id, base, unnest(t) as word from e),
c as (select word, count(*) as n from (select unnest(list_distinct(w)) as word from d) where word in (select word from v) group by word),
r as (select id, base, v.word, row_number() over (partition by id order by coalesce(n, 0), v.word) as k from v left join c on v.word = c.word),
a as (select distinct id, word from r where k <= case when base then 1 else {RARE} end),
p as (select e.*, a.word, u.at from e join a using (id), lateral (select unnest(range(1, len(e.t) + 1)) as at) u where e.t[u.at] = a.word and (not e.base or u.at = list_position(e.t, a.word))),
x as (select row, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
h as (select x.row, p.*, x.pos - p.at as start from x join p on x.word = p.word),
m as (
  select h.*, len(list_filter(range(1, len(h.t) + 1), lambda i: h.start + i >= 1 and coalesce(d.w[h.start + i] = h.t[i], false)))::double / len(h.t)::double as alike,
    coalesce(list_bool_and(list_transform(h.keys, lambda k: contains(' ' || array_to_string(d.w[greatest(h.start + 1, 1):h.start + len(h.t)], ' ') || ' ', ' ' || k || ' '))), true) as held
  from h join d on h.row = d.row),
f as (select * from m where case when base then alike = 1 else alike >= {SHARE} and held end),
g as (
  select row, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(case when base then 0.5 else alike end)::double as score from f group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join g using (row)
"""
