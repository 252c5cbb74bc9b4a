r"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause side by side: insult, threat, target, negation and reported speech. Their composition is a
product automaton whose transitions are made when first met. It emits, for each insult or threat of the clause, its flags (aimed
at someone, with intent, negated, reported). Sentence ends close a clause for all but reported speech, which a quotation carries on up to its closing
mark; an empty line closes everything. Colons, commas and single line ends close nothing.

A match is a path, and its weight the sum of its arcs: the stem's own log odds times a factor, and one weight for each of insult,
threat, intent, target, negation and speech. A text's log odds are a base plus the weights of its paths, at most `REPEATS` of equal flags (the heaviest), so a text is
scored by matched clauses and not by its words. The arcs' weights are learned from labelled texts by penalised logistic regression around the
priors ARCS, which decide where there are few matches to learn from. A negation or report thus weighs what it does in the labelled texts.

The insult transducer's stems are learned from the same texts: word prefixes and whole words that hardly ever occur in clean ones.
Equal texts, and near copies with the same COPY smallest word hashes, support a stem once. Threat, target, negation and speech words are fixed lists.

Bounds of the fit, all parameters: the `sample_rows` labelled rows of the training folds whose md5(doc_id) is smallest; stems of
SHORTEST to `longest` letters, found in `support` toxic texts and in `support_share` of those in the sample, with `precision` of their texts toxic and
`evidence` nats (a log likelihood ratio) that this is not the sample's own rate; the `most_stems` of them with most toxic texts.

Labels: a row with a null id or label is ignored; of several labels for an id the largest counts. Training rows are those whose
crc32(doc_id as text) mod 4 is not 2. Null or empty texts have no clause and score the base. Without any usable label the base is that of
`prior`. Rows that repeat are scored each for itself; extra columns are kept by score_toxicity.

Scale: the fit stages the sample's texts, found by a broadcast of at most `sample_rows` ids; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold, free_name, raw, staged, table, with_result

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
SHORTEST, LONGEST = 3, 12
SUPPORT, SUPPORT_SHARE, PRECISION, EVIDENCE, MOST_STEMS = 6, 0.01, 0.8, 12.0, 512
PRIOR = 0.05
#: Word hashes that near copies share; paths of equal flags that count.
COPY, REPEATS = 12, 3
# Words of the four closed transducers (English, German, French, Spanish).
THREATS = "kill hurt destroy beat burn shoot stab hunt töten umbringen verletzen zerstören tuer blesser frapper détruire matar golpear quemar destruir".split()
INTENT = "will shall gonna going want must werde wirst will soll vais va veux voy va quiero".split()
TARGETS = "you your yours yourself he she him her his they them their these those du dich dir dein ihr euch sie ihn tu toi te ton vous il elle ils eux tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never none nobody isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun ne nunca ningún tampoco".split()
SPEECH = "said says say told tells called calls claimed wrote quoted according sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]|[.!?;]+")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
QUOTES = frozenset("\"“”«»„")
NEGATION_SPAN, TARGET_SPAN, INTENT_SPAN = 3, 4, 3
#: Prior weights of the arcs: the base follows from `prior`; "stem" is the factor of a stem's own log odds.
ARCS = {"stem": 0.5, "insult": 0.5, "target": 0.5, "negation": -1.5, "speech": -1.0, "threat": 0.2, "intent": 0.8}
#: How firmly the priors hold, as the precision of a normal distribution.
FIRM = 0.5


class Transducer:
    """step(state, word class) gives the next state and what is emitted; states are small integers, 0 is the first."""

    def __init__(self, step: Callable[[int, str], tuple[int, str]]):
        self.step = step


def countdown(opens: str, span: int, emits: str, at: str) -> Transducer:
    """After a word of class `opens`, the next `span` words are in scope; words of classes `at` in scope emit."""

    def step(state: int, kind: str) -> tuple[int, str]:
        if kind == "stop":
            return 0, ""
        said = emits if state and kind in at else ""
        return (span if kind == opens else max(0, state - 1)), said

    return Transducer(step)


def spoken() -> Transducer:
    """After a verb of speech up to the end of the sentence, or inside quotes up to their end."""

    def step(state: int, kind: str) -> tuple[int, str]:
        if kind == "quote":
            return (0 if state == 2 else 2), ""
        if kind == "stop":
            return (2 if state == 2 else 0), ""
        return (1 if kind == "speech" and not state else state), ("R" if state and kind in ("insult", "threat") else "")

    return Transducer(step)


def threatening(state: int, kind: str) -> tuple[int, str]:
    """V: a threat's verb; W: with intent before it."""
    if kind == "stop":
        return 0, ""
    return INTENT_SPAN if kind == "intent" else max(0, state - 1), "" if kind != "threat" else "W" if state else "V"


HITS = ("insult", "threat")
#: insult, threat with intent, target, negation, reported speech.
PARTS = (
    Transducer(lambda state, kind: (0, "I" if kind == "insult" else "")),
    Transducer(threatening),
    countdown("target", TARGET_SPAN, "X", HITS),
    countdown("negation", NEGATION_SPAN, "N", HITS),
    spoken(),
)
#: The arcs that a flag stands for.
BY_FLAG = {"I": ("insult",), "V": ("threat",), "W": ("threat", "intent"), "X": ("target",), "N": ("negation",), "R": ("speech",)}


class Grammar:
    """The composition of the transducers, with the learned stems and weights."""

    def __init__(self, model: dict):
        self.stems, self.base, self.arcs = model["stems"], model["base"], model["arcs"]
        self.kinds = {w: k for k, words in (("speech", SPEECH), ("negation", NEGATIONS), ("intent", INTENT), ("target", TARGETS), ("threat", THREATS)) for w in words} | dict.fromkeys(QUOTES, "quote")
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.table: dict = {}
        literals = [*dict.fromkeys(s.rstrip("$") for s in self.stems), *THREATS]
        if len(literals) > 64:
            import ahocorasick

            found = ahocorasick.Automaton()
            for x in literals:
                found.add_word(x, True)
            found.make_automaton()
            self.may_match = lambda low: next(found.iter(low), None) is not None
        else:
            self.may_match = lambda low: any(x in low for x in literals)

    def kind(self, word: str) -> tuple[str, float]:
        if word[0] in ".!?;":
            return "stop", 0.0
        if (w := self.stems.get(f"{word}$")) is not None:
            return "insult", w
        for n in self.lengths:
            if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                return "insult", w
        return self.kinds.get(word, "other"), 0.0

    def paragraph(self, text: str) -> Iterator[tuple[str, float]]:
        """What the composed transducers emit for some clauses: flags and the stem's log odds of each match."""
        states = (0,) * len(PARTS)
        for m in TOKEN.finditer(text):
            kind, weight = self.kind(m[0])
            if (key := (states, kind)) not in self.table:
                moved = [p.step(s, kind) for p, s in zip(PARTS, states, strict=True)]
                self.table[key] = tuple(s for s, _ in moved), "".join(e for _, e in moved)
            states, flags = self.table[key]
            if flags:
                yield flags, weight

    def matches(self, text: str) -> list[tuple[str, float]]:
        low = text.lower()
        if not self.may_match(low):
            return []
        return [m for p in PARAGRAPH.split(low) if self.may_match(p) for m in self.paragraph(p)]

    def counted(self, text: str) -> list[tuple[str, float]]:
        """The matches that count: REPEATS of equal flags, those with the heaviest stems."""
        by: dict[str, list[float]] = {}
        for flags, w in self.matches(text):
            by.setdefault(flags, []).append(w)
        return [(f, w) for f in sorted(by) for w in sorted(by[f], reverse=True)[:REPEATS]]

    def weight(self, flags: str, stem: float) -> float:
        """The weight of a path: the sum of its arcs."""
        return self.arcs["stem"] * stem + sum(self.arcs[a] for f in flags for a in BY_FLAG[f])

    def score(self, text: str) -> float:
        z = self.base + sum(self.weight(f, w) for f, w in self.counted(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def evidence_of(pos: int, n: int, rate: float) -> float:
    """Nats by which a stem's own share of toxic texts explains them better than the rate of all."""
    own, rate = pos / n, min(max(rate, 1e-6), 1 - 1e-6)
    return pos * math.log(own / rate) + ((n - pos) * math.log((1 - own) / (1 - rate)) if pos < n else 0.0)


def closed_stems(rows: list[tuple[str, int, int]], prior: float, support: int = SUPPORT, precision: float = PRECISION, most_stems: int = MOST_STEMS, rate: float = PRIOR, evidence: float = EVIDENCE) -> dict[str, float]:
    """Shortest precise stems, each lengthened while nearly all its toxic uses go on alike; and their log odds. rows: stem, toxic, all."""
    pos, total = {s: p for s, p, _ in rows}, {s: n for s, _, n in rows}
    good = {s for s in pos if pos[s] >= support and pos[s] >= precision * total[s] and evidence_of(pos[s], total[s], rate) >= evidence}
    after: dict[str, list[str]] = {}
    for s in pos:
        after.setdefault(s[:-1], []).append(s)
    out = {}
    for s in sorted(good, key=lambda s: (-pos[s], s)):
        if any(s[:n] in good for n in range(SHORTEST, len(s))):
            continue
        while longer := next((x for x in after.get(s, ()) if pos[x] >= 0.98 * pos[s]), None):
            s = longer
        out[s] = math.log((pos[s] + 0.5) / (total[s] - pos[s] + 0.5)) - math.log(prior / (1 - prior))
    return dict(sorted(out.items(), key=lambda x: (-pos[x[0]], x[0]))[:most_stems])


def learned(rows: list[tuple[list[float], int, int]], prior: float) -> tuple[float, dict[str, float]]:
    """Base and arcs by Newton's method. rows: the sums of each arc over a text's paths, toxic texts, all texts."""
    start = np.array([math.log(prior / (1 - prior)), *ARCS.values()])
    x = np.array([[1.0, *f] for f, _, _ in rows]).reshape(-1, len(start))
    pos, n = np.array([p for _, p, _ in rows], float), np.array([k for _, _, k in rows], float)
    theta = start.copy()
    firm = np.diag([1e-3, *[FIRM] * len(ARCS)])  # the base is what the labels say
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (pos - n * p) - firm @ (theta - start)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + firm, gradient)
        theta += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), dict(zip(ARCS, theta[1:].tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, prior: float = PRIOR, support: int = SUPPORT, support_share: float = SUPPORT_SHARE, precision: float = PRECISION, evidence: float = EVIDENCE, longest: int = LONGEST, most_stems: int = MOST_STEMS) -> dict:
    """The model: stems with weights, the base and the arcs' weights. Its size is bounded by `most_stems`."""
    wanted = (
        labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna()
        .filter(fold(F.col("label_id"), FOLDS) != HELD_OUT)
        .groupBy("label_id").agg(F.max("label").alias("label"))
        .orderBy(F.md5(F.col("label_id").cast("string").cast("binary")), "label_id").limit(sample_rows)
    )
    texts = staged(docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), F.col("own_id") == F.col("label_id")).filter("text is not null").select("label", "text"), "labelled")
    words = texts.select("label", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("words"))
    words = words.withColumn("same", F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, COPY))
    words = staged(words.groupBy("same").agg(F.max(F.struct("label", "words")).alias("r")).select("r.label", "r.words"), "words")
    toxic, n_texts = words.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(support, math.ceil(support_share * toxic))
    each = words.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).filter(F.length("word") >= SHORTEST)
    stems = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(longest))), lambda i: F.substring(F.col("word"), F.lit(1), i))
    stems = F.concat(stems, F.array(F.concat("word", F.lit("$"))))
    counted = each.select("pos", "n", F.explode(stems).alias("stem")).groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    counted = staged(counted.filter((F.col("pos") >= least) & (F.col("pos") >= precision * F.col("n"))), "stems")
    # So far a text counts once for each word of a stem; support is by texts, which only toxic ones give.
    held = words.filter("label = 1").select(F.xxhash64("words").alias("of"), F.explode("words").alias("word")).filter(F.length("word") >= SHORTEST).select("of", F.explode(stems).alias("own_stem"))
    held = held.join(counted.select("stem"), F.col("own_stem") == F.col("stem"), "left_semi").groupBy("own_stem").agg(F.count_distinct("of").alias("texts")).filter(F.col("texts") >= least)
    rows = [(r.stem, r.pos, r.n) for r in counted.join(held, F.col("stem") == F.col("own_stem")).select("stem", "pos", "n").collect()]
    discard(counted, words)
    model = {"stems": closed_stems(rows, prior, least, precision, most_stems, toxic / max(1, n_texts), evidence), "base": 0.0, "arcs": dict(ARCS)}

    def paths(batches):
        grammar, got = Grammar(model), {}
        for b in batches:
            for label, data in zip(b.column("label").to_pylist(), raw(b.column("text")), strict=True):
                sums = dict.fromkeys(ARCS, 0.0)
                for flags, w in grammar.counted((data or b"").decode()):
                    sums["stem"] += w
                    for f in flags:
                        for a in BY_FLAG[f]:
                            sums[a] += 1
                at = got.setdefault(tuple(round(x, 6) for x in sums.values()), [0, 0])
                at[0], at[1] = at[0] + label, at[1] + 1
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([[*x] for x in got], pa.list_(pa.float64())), pa.array([x for x, _ in got.values()], pa.int64()), pa.array([x for _, x in got.values()], pa.int64())], names=["sums", "pos", "n"])

    seen = texts.mapInArrow(paths, "sums array<double>, pos bigint, n bigint").groupBy("sums").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()
    model["base"], model["arcs"] = learned(sorted((r.sums, r.pos, r.n) for r in seen), prior)
    discard(texts)
    return model


def score_toxicity(docs: DataFrame, model: dict, *, text_col: str = "text", result_col: str = "toxicity") -> DataFrame:
    """docs and the score, as a column that must not be there yet."""

    def start():
        grammar = Grammar(model)
        return lambda b: pa.array([grammar.score((x or b"").decode()) for x in raw(b.column(text_col))], pa.float64())

    return with_result(docs, start, "double", result_col)


def keep_clean(docs: DataFrame, model: dict, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    name = free_name(docs)
    return score_toxicity(docs, model, text_col=text_col, result_col=name).filter(F.col(name) < threshold).drop(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")), result_col="score")
    return r.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
