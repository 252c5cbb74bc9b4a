"""What the operators share: Arrow mapping, words, folds and tokenizers; staged tables come from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import table
from ..sources.shared import discard, new_path, remove, staged, write

__all__ = ["ALNUM", "SPACED", "ascii_lower", "discard", "fold", "free_name", "give_back", "loaded_tokenizer", "new_path", "pieces", "raw", "remove", "sliced", "staged", "table", "with_result", "write"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def loaded_tokenizer(data: str):
    """The library's tokenizer of a .json file, without truncation and padding, on one thread; one for each worker process and file."""
    import os
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would hold memory of their own
    held = tokenizers.__dict__.setdefault("_held_by_worker", {})  # outlives the task, as nothing pickled by value does
    if data not in held:
        held.clear()
        t = held[data] = tokenizers.Tokenizer.from_str(data)
        t.no_truncation()
        t.no_padding()
    t = held[data]
    t.encode_special_tokens = False
    return t


def free_name(df: DataFrame, name: str = "result") -> str:
    """A column name that df does not have, whatever it has; Spark's names differ by more than case."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def with_result(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.Array]], kind: str, name: str) -> DataFrame:
    """df with one more column of DDL type `kind`. start() runs once a task and returns the function of a batch."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name!r} already")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, work(b)], names=[*b.schema.names, name])
        give_back()

    return df.mapInArrow(run, schema)


def raw(column: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """The values of a text column as UTF-8, some rows at a time: a batch is not held twice."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).cast(pa.binary()).to_pylist()


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some rows, so that what is made of them stays small."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task and shares the executor's limit."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def byte_table(is_word: Callable[[int], bool]) -> bytes:
    """For bytes.translate: A-Z lower-cased, ASCII that is no word character made a space, all else kept."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or is_word(b) else 32 for b in range(256))


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122)
#: Words [^\x20\x09-\x0D]+ after lower-casing.
SPACED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))


def pieces(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Translated data in pieces of about `size` bytes, cut at spaces: no list holds all words of a huge text."""
    at = 0
    while len(data) - at > size:
        cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]
