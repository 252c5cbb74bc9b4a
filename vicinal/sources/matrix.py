"""Sparse matrices in a folder, as a data source of Spark: `sparse_matrix`.

A folder holds parts and `_matrix.json`, which names them and is replaced last: what it does not name does not count. A part is an
uncompressed .npz of numpy: `indptr`, `indices` and `data` by rows (csr) or by columns (csc), and one array for each further column of a
row (text as bytes and offsets, nulls as a mask). Values are float32, as models want them.

Reading: partitions are ranges of rows of a part; where these are over MOST_TASKS, a partition is several that follow each other, read one by one. Only the columns of the schema that is asked for are opened, and of a csr part only the
bytes of the range; comparisons of `row` leave out ranges where the session allows filters to be pushed
(spark.sql.python.filterPushdown.enabled; read_matrix() looks, elsewhere the option `pushed` says so). A column that is not there, or of another type, is an error before any part is read.

    row bigint              the number of the row in the whole matrix
    feature_indices array<int>, feature_values array<float>   what a row holds, in order of index
    x array<float>          the same as a dense vector; only if asked for
    ...                     the further columns

Writing: a task writes parts of `rowsPerPart` rows; the job's end publishes them. A task that is run again writes other names.
Paths may be of any store that pyarrow opens.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import InputError

NAME, MANIFEST = "sparse_matrix", "_matrix.json"
OWN = {"row": "bigint", "feature_indices": "array<int>", "feature_values": "array<float>", "x": "array<float>"}
#: Types of further columns, and how numpy holds them; text is bytes and offsets.
KINDS = {"bigint": "<i8", "int": "<i4", "float": "<f4", "double": "<f8", "boolean": "|b1", "string": None}
ROWS_PER_PART, ROWS_PER_PARTITION, BATCH_NUMBERS = 100_000, 50_000, 1 << 21
#: A task costs some time to start, so small ranges of a large matrix share tasks.
MOST_TASKS = 1000


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest_of(path: str) -> dict:
    store, at = located(path)
    if store.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.File:
        raise InputError(f"there is no matrix at {path}")
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class Part:
    """An open part: arrays or slices of arrays, each read from its own bytes."""

    def __init__(self, path: str, name: str):
        store, at = located(path)
        self.zip = zipfile.ZipFile(store.open_input_file(f"{at}/{name}"))
        self.names = set(self.zip.namelist())

    def __enter__(self) -> Part:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()

    def slice(self, name: str, a: int = 0, z: int | None = None) -> np.ndarray:
        with self.zip.open(f"{name}.npy") as f:
            version = np.lib.format.read_magic(f)
            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            z = shape[0] if z is None else z
            f.seek(a * kind.itemsize, io.SEEK_CUR)
            return np.frombuffer(f.read((z - a) * kind.itemsize), kind)

    def column(self, name: str, kind: str, a: int, z: int) -> pa.Array:
        null = self.slice(f"null.{name}", a, z) if f"null.{name}.npy" in self.names else None
        if KINDS[kind]:
            return pa.array(self.slice(f"obs.{name}", a, z), mask=null)
        at = self.slice(f"offsets.{name}", a, z + 1)
        held = self.slice(f"bytes.{name}", int(at[0]), int(at[-1])).tobytes()
        return pa.array([None if null is not None and null[k] else held[at[k] - at[0] : at[k + 1] - at[0]].decode() for k in range(z - a)], pa.string())

    def sparse(self, layout: str, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, indices and values of the rows from a to z."""
        if layout == "csr":
            at = self.slice("indptr", a, z + 1)
            return at - at[0], self.slice("indices", int(at[0]), int(at[-1])), self.slice("data", int(at[0]), int(at[-1]))
        at, rows = self.slice("indptr"), self.slice("indices")
        own = np.flatnonzero((rows >= a) & (rows < z))
        columns = np.searchsorted(at, own, "right") - 1
        order = np.lexsort((columns, rows[own]))
        counts = np.bincount(rows[own] - a, minlength=z - a)
        return np.concatenate([[0], np.cumsum(counts)]), columns[order].astype(np.int32), self.slice("data")[own[order]]


@dataclass
class Range(D.InputPartition):
    """Rows of a part."""

    name: str
    layout: str
    first: int  # of the part, in the matrix
    a: int
    z: int

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Ranges(D.InputPartition):
    """Ranges that follow each other."""

    held: list[Range]

    def __post_init__(self):
        super().__init__(None)


class Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, manifest: dict, rows: int):
        self.path, self.wanted, self.manifest, self.rows = path, schema, manifest, rows
        self.least, self.most = 0, manifest["rows"] - 1
        known = OWN | manifest["fields"]
        for f in schema.fields:
            if f.name not in known:
                raise InputError(f"the matrix has no column {f.name!r}; it has {', '.join(known)}")
            if f.dataType.simpleString() != known[f.name]:
                raise InputError(f"{f.name} is {known[f.name]}, not {f.dataType.simpleString()}")

    def partitions(self) -> Sequence[Range | Ranges]:
        every = (Range(p["name"], p["layout"], p["first"], a, min(a + self.rows, p["rows"])) for p in self.manifest["parts"] for a in range(0, p["rows"], self.rows))
        kept = [r for r in every if r.first + r.a <= self.most and r.first + r.z > self.least]
        share = -(-len(kept) // MOST_TASKS)
        return kept if share < 2 else [Ranges(kept[i : i + share]) for i in range(0, len(kept), share)]

    def read(self, partition: Range | Ranges | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Ranges):
            for r in partition.held:
                yield from self.read(r)
            return
        if partition is None:  # how Spark says that there is no range
            return
        names, width, fields = [f.name for f in self.wanted.fields], self.manifest["width"], self.manifest["fields"]
        step = max(1, BATCH_NUMBERS // max(1, width)) if "x" in names else 10_000
        kinds = [to_arrow_type(f.dataType) for f in self.wanted.fields]
        with Part(self.path, partition.name) as part:
            for a in range(partition.a, partition.z, step):
                z = min(a + step, partition.z)
                out: dict[str, pa.Array] = {n: part.column(n, fields[n], a, z) for n in names if n in fields}
                out["row"] = pa.array(np.arange(partition.first + a, partition.first + z))
                if {*names} & {"x", "feature_indices", "feature_values"}:
                    at, indices, values = part.sparse(partition.layout, a, z)
                    if "x" in names:
                        x = np.zeros((z - a, width), np.float32)
                        x[np.repeat(np.arange(z - a), np.diff(at)), indices] = values
                        out["x"] = pa.ListArray.from_arrays(pa.array(np.arange(z - a + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)))
                    offsets = pa.array(at.astype(np.int32))
                    out["feature_indices"], out["feature_values"] = pa.ListArray.from_arrays(offsets, pa.array(indices)), pa.ListArray.from_arrays(offsets, pa.array(values))
                yield pa.RecordBatch.from_arrays([out[n].cast(k) for n, k in zip(names, kinds, strict=True)], names=names)


class PushedReader(Reader):
    """For sessions that let filters be pushed; Spark refuses a reader that takes filters anywhere else."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Bounds of `row`; all filters are applied by Spark again, for a range may hold other rows too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, D.GreaterThan))
                if isinstance(f, (D.EqualTo, D.LessThan, D.LessThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, D.LessThan))
                if isinstance(f, D.In) and (values := [v for v in f.value if v is not None]):
                    self.least, self.most = max(self.least, min(values)), min(self.most, max(values))
            yield f


@dataclass
class Written(D.WriterCommitMessage):
    task: int
    parts: list[dict] = field(default_factory=list)


class Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, options: dict[str, str]):
        self.path, self.overwrite = path, overwrite
        self.layout, self.rows = options.get("layout", "csr"), int(options.get("rowsPerPart", ROWS_PER_PART))
        self.width = int(options["width"]) if "width" in options else None
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if self.layout not in ("csr", "csc"):
            raise InputError(f"{self.layout!r} is neither csr nor csc")
        for name in ("feature_indices", "feature_values"):
            if kinds.pop(name, None) != OWN[name]:
                raise InputError(f"{name} must be there as {OWN[name]}")
        if bad := [n for n, k in kinds.items() if k not in KINDS or n in OWN]:
            raise InputError(f"columns that a matrix can't hold: {', '.join(bad)}")
        self.fields = kinds

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, held, rows = Written(TaskContext.get().partitionId()), [], 0
        for b in iterator:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, self.rows - rows))
                at, rows = at + held[-1].num_rows, rows + held[-1].num_rows
                if rows == self.rows:
                    out.parts.append(self.part(pa.Table.from_batches(held)))
                    held, rows = [], 0
        if rows:
            out.parts.append(self.part(pa.Table.from_batches(held)))
        return out

    def part(self, t: pa.Table) -> dict:
        """Write one part; what the manifest has to say of it."""
        t = t.combine_chunks()
        lists = [t.column(n).combine_chunks() for n in ("feature_indices", "feature_values")]
        sizes = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in lists]
        if (sizes[0] != sizes[1]).any():
            raise InputError("a row has more indices than values, or fewer")
        indices, values = (x.flatten() for x in lists)
        if indices.null_count or values.null_count:
            raise InputError("an index or a value is null")
        indices, values, owner = indices.to_numpy(), values.to_numpy(), np.repeat(np.arange(len(t)), sizes[0])
        if len(indices) and (indices.min() < 0 or self.width is not None and indices.max() >= self.width):
            raise InputError(f"an index lies outside 0 to {self.width}")
        order = np.lexsort((indices, owner)) if self.layout == "csr" else np.lexsort((owner, indices))
        indices, values, owner = indices[order], values[order], owner[order]
        if ((np.diff(indices) == 0) & (np.diff(owner) == 0)).any():
            raise InputError("a row has an index twice")
        most = int(indices.max(initial=-1))
        minor, counts = (indices, np.bincount(owner, minlength=len(t))) if self.layout == "csr" else (owner, np.bincount(indices, minlength=most + 1))
        arrays = {"indptr": np.concatenate([[0], np.cumsum(counts)]).astype("<i8"), "indices": minor.astype("<i4"), "data": values.astype("<f4")}
        for name, kind in self.fields.items():
            c = t.column(name).combine_chunks()
            if c.null_count:
                arrays[f"null.{name}"] = c.is_null().to_numpy(zero_copy_only=False)
            if KINDS[kind]:
                arrays[f"obs.{name}"] = c.fill_null(False if kind == "boolean" else 0).to_numpy(zero_copy_only=False).astype(KINDS[kind])
            else:
                texts = [x.encode() for x in c.fill_null("").to_pylist()]
                arrays[f"bytes.{name}"] = np.frombuffer(b"".join(texts), "u1")
                arrays[f"offsets.{name}"] = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype("<i8")
        store, at = located(self.path)
        store.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.npz"
        with store.open_output_stream(f"{at}/{name}") as f:
            np.savez(f, **arrays)
        return {"name": name, "rows": len(t), "layout": self.layout, "most": most}

    def commit(self, messages: list[Written | None]) -> None:
        store, at = located(self.path)
        there = store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File
        before = manifest_of(self.path) if there else {"parts": [], "rows": 0, "width": 0, "fields": self.fields}
        if there and not self.overwrite and before["fields"] != self.fields:
            self.abort(messages)
            raise InputError("the matrix has other columns")
        parts = [] if self.overwrite else before["parts"]
        parts = parts + [p for m in sorted((m for m in messages if m), key=lambda m: m.task) for p in m.parts]
        first, width = 0, max([self.width or 0, *(p["most"] + 1 for p in parts), 0 if self.overwrite else before["width"]])
        for p in parts:
            p["first"] = first
            first += p["rows"]
        store.create_dir(at, recursive=True)
        new = f"{at}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as f:
            f.write(json.dumps({"width": width, "rows": first, "fields": self.fields, "parts": parts}).encode())
        store.move(new, f"{at}/{MANIFEST}")
        for p in before["parts"] if self.overwrite else []:
            store.delete_file(f"{at}/{p['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, at = located(self.path)
        for name in [p["name"] for m in messages if m for p in m.parts]:
            store.delete_file(f"{at}/{name}")


class SparseMatrix(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        fields = manifest_of(self.options["path"])["fields"]
        own = {n: OWN[n] for n in ("row", "feature_indices", "feature_values")}
        return ", ".join(f"`{n}` {k}" for n, k in ({"row": own.pop("row")} | fields | own).items())

    def reader(self, schema: T.StructType) -> Reader:
        rows = int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION))
        kind = PushedReader if self.options.get("pushed") == "true" else Reader
        return kind(self.options["path"], schema, manifest_of(self.options["path"]), rows)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite, dict(self.options))


def read_matrix(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The rows of a matrix; of the columns that are named nothing else is read. Names are those of the module's table, or of further columns."""
    spark.dataSource.register(SparseMatrix)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(NAME).options(**{"pushed": pushed, **options})
    if columns is not None:
        known = OWN | manifest_of(path)["fields"]
        if missing := [c for c in columns if c not in known]:
            raise InputError(f"the matrix has no column {missing[0]!r}; it has {', '.join(known)}")
        reader = reader.schema(", ".join(f"`{c}` {known[c]}" for c in columns))
    return reader.load(path)


def write_matrix(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Rows with feature_indices, feature_values and further columns as a matrix. Options: width, layout, rowsPerPart."""
    df.sparkSession.dataSource.register(SparseMatrix)
    df.write.format(NAME).mode(mode).options(**options).save(path)
