"""Embedding a query matrix: a model is a function of batches of rows."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def linear_model(weights: np.ndarray) -> Model:
    """x (n, genes) times weights (genes, dimension)."""
    return lambda x, total: x @ weights


def checkpoint_model(spark: SparkSession, path: str) -> Model:
    """The linear model whose weights (genes, dimension) a .npy file holds. The file is read once, and broadcast; a model has the size of one checkpoint."""
    found = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
    if not found:
        raise InputError(f"no checkpoint at {path}")
    weights = np.load(io.BytesIO(found[0].content), allow_pickle=False)
    if weights.ndim != 2:
        raise InputError(f"weights have {weights.ndim} dimensions, not 2")
    sent = spark.sparkContext.broadcast(weights)
    return lambda x, total: x @ sent.value


def embed(matrix: DataFrame, model: Model, dimension: int, *, id_col: str = "query_cell_id", x_col: str = "x", total_col: str = "total_mrna_umis") -> DataFrame:
    """id and embedding of each row of a query matrix, in batches. The model travels with the tasks; Spark broadcasts it once it is large."""
    kind = matrix.schema[id_col].dataType

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            out = np.asarray(model(x, b.column(2).to_numpy(zero_copy_only=False)), np.float64)
            if out.shape != (b.num_rows, dimension):
                raise InputError(f"the model gave {out.shape}, not {(b.num_rows, dimension)}")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dimension, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "embedding"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return matrix.select(id_col, F.col(x_col), F.col(total_col)).mapInArrow(run, schema)
