r"""Token counts that equal the library's, whole texts of any length.

Huge texts (over `huge` characters) are encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a stable
common boundary inside their overlap: a white-space character that no token of either chunk crosses, from which both have the same
tokens up to the next such character. White space between pieces is proven stable when the tokenizer keeps none of it (see
keeps_no_space); for other tokenizers the agreement of both chunks around it is what is asked for. Where an overlap has no such
boundary it is doubled, up to the whole text, so the count is exact whatever the text.

Other texts have one chunk. When the tokenizer keeps no white space, the tokens of a text are those of its pieces between ASCII
white space, so each distinct piece of a batch is encoded once, and a bounded memory of pieces is held by the task.

Special strings inside texts are handled as the library does by default; no begin, end or other tokens are added, nothing is
truncated or padded. Null or empty texts have 0 tokens. Rows that repeat are counted each for itself; an empty table gives an empty
table; extra columns are kept by count_tokens.

Scale: one pass, no shuffle. The tokenizer's file is read once on the driver and broadcast (a fixed size, 2 MB).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded_tokenizer, raw, table, with_result

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
#: Pieces of batches that are counted at once, and pieces that a task remembers.
AT_ONCE, REMEMBERED = 400_000, 300_000
SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
EDGE = re.compile(r"(?<=\S)[ \t\n\r](?=\S)")


def keeps_no_space(t) -> bool:
    """Whether tokens of texts are those of their pieces between white space."""
    if t.pre_tokenizer is None:
        return False
    text = t.normalizer.normalize_str(" a  b\tc\n") if t.normalizer else " a  b\tc\n"
    return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] == ["a", "b", "c"]


def splice(text: str, left: tuple, right: tuple, low: int, high: int) -> tuple[int, int, int] | None:
    """A stable common boundary in [low, high): tokens of `left` before it, the first of `right` from it on, and its place."""
    (la, lb, li), (ra, rb, ri) = left, right
    edges = [m.start() for m in EDGE.finditer(text, low + 1, high - 1)]
    middle = (low + high) / 2
    for k in sorted(range(len(edges) - 1), key=lambda k: abs(edges[k] - middle)):
        p, q = edges[k], edges[k + 1]
        i, j = int(np.searchsorted(la, p)), int(np.searchsorted(ra, p))
        if i and lb[i - 1] > p or j and rb[j - 1] > p:
            continue
        i2, j2 = int(np.searchsorted(la, q)), int(np.searchsorted(ra, q))
        if i2 > i and i2 - i == j2 - j and (la[i:i2] == ra[j:j2]).all() and (lb[i:i2] == rb[j:j2]).all() and (li[i:i2] == ri[j:j2]).all():
            return i, j, p
    return None


def encode_huge(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[np.ndarray]:
    """The ids of a text as arrays to be joined, from overlapping chunks."""

    def encode(a: int, b: int) -> tuple:
        e = t.encode(text[a:b], add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2) + a
        return at[:, 0], at[:, 1], np.array(e.ids, np.int64)

    out: list[np.ndarray] = []
    begin = start = 0  # the last boundary, and where the chunk that goes on from it starts
    end = min(len(text), chunk + overlap)
    left, first = encode(0, end), 0
    while end < len(text):
        wide, cut = overlap, None
        while cut is None and wide < end - begin:
            low = end - wide
            stop = min(len(text), end + chunk)
            right = encode(low, stop)
            cut = splice(text, left, right, low, end)
            wide *= 2
        if cut:
            i, j, p = cut
            out.append(left[2][first:i])
            left, first, begin, start, end = right, j, p, low, stop
        else:  # no boundary since the last one: the chunk itself grows
            end = min(len(text), end + max(chunk, end - start))
            left = encode(start, end)
            first = int(np.searchsorted(left[0], begin))
    return [*out, left[2][first:]]


class Counter:
    def __init__(self, data: str, huge: int, chunk: int, overlap: int):
        self.t, self.huge, self.chunk, self.overlap = loaded_tokenizer(data), huge, chunk, overlap
        self.by_piece, self.known = keeps_no_space(self.t), {}

    def learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 20_000):
            part = [w.decode() for w in words[a : a + 20_000]]
            lines = [part[b : b + 200] for b in range(0, len(part), 200)]
            for line, e in zip(lines, self.t.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
                ends = np.cumsum([len(w) + 1 for w in line])
                of = np.searchsorted(ends, np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], "right")
                self.known.update(zip((w.encode() for w in line), np.bincount(of, minlength=len(line)).tolist(), strict=True))

    def pieces(self, rows: list[list[bytes]]) -> np.ndarray:
        """Tokens of each row of pieces."""
        coded = pa.array([w for r in rows for w in r], pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        self.learn([w for w in words if w not in self.known])
        each = np.fromiter((self.known[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum([len(r) for r in rows])
        return total[ends] - total[ends - [len(r) for r in rows]]

    def batch(self, texts: Iterable[bytes | None]) -> list[int]:
        out, rows, at, n = [], [], [], 0

        def flush() -> None:
            for k, x in zip(at, self.pieces(rows).tolist() if rows else [], strict=True):
                out[k] = x
            rows.clear()
            at.clear()

        for k, data in enumerate(texts):
            out.append(0)
            if not data:
                continue
            if len(data) > self.huge and len(text := data.decode()) > self.huge:
                out[k] = sum(map(len, encode_huge(self.t, text, self.chunk, self.overlap)))
            elif self.by_piece:
                rows.append(data.translate(SPACE).split(b" "))
                rows[-1] = [w for w in rows[-1] if w]
                at.append(k)
                n += len(rows[-1])
                if n >= AT_ONCE:
                    flush()
                    n = 0
            else:
                out[k] = len(self.t.encode(data.decode(), add_special_tokens=False).ids)
        flush()
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", result_col: str = "counts", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs and a struct of n_bytes and n_tokens, as a column that must not be there yet."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def start():
        counter = Counter(sent.value, huge, chunk, overlap)

        def work(b: pa.RecordBatch) -> pa.Array:
            column = b.column(text_col)
            return pa.array([{"n_bytes": len(x or b""), "n_tokens": n} for x, n in zip(raw(column), counter.batch(raw(column)), strict=True)], kind)

        return work

    return with_result(docs, start, "struct<n_bytes: bigint, n_tokens: bigint>", result_col)


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    r = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    n = F.col("counts.n_tokens")
    return r.select("doc_id", F.col("counts.n_bytes").alias("n_bytes"), n.alias("n_tokens"), (n > LIMIT).alias("over_limit"))
