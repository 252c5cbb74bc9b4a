"""A stream of embedding batches into an index: each micro-batch is a delta of last writes.

Files come `chunk` at a time. A micro-batch writes its own rows alone, into a folder named by its number, so a batch that is run again
overwrites that folder and nothing else. Readers take the last write over all deltas, of one time that of the later batch.
compacted() folds the deltas so far into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.index_build import UPDATE_CHUNK, latest
from ..sources.shared import file_system, remove


def folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    fs, at = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in found if fs.exists(file_system(spark, f"{path}/{kind}={n}/_SUCCESS")[1]))


def current(spark: SparkSession, path: str, *, id_col: str = "id", order: str = "ts", by_turn: bool = False) -> DataFrame | None:
    """The newest compacted folder and the deltas behind it, the last write of each id. by_turn: a later delta counts whatever `order` says."""
    base = folders(spark, path, "base")
    deltas = [n for n in folders(spark, path, "delta") if not base or n > base[-1]]
    parts = [f"{path}/base={base[-1]}"] if base else []
    if not parts + deltas:
        return None
    if not deltas:
        return spark.read.parquet(*parts)
    held = [(spark.read.parquet(p), -1) for p in parts] + [(spark.read.parquet(f"{path}/delta={n}"), n) for n in deltas]
    names = held[0][0].columns
    turned_by = lambda time, turn: (turn, time) if by_turn else (time, turn)
    turned = [df.withColumn(order, F.struct(*turned_by(F.col(order).alias("time"), F.lit(n).alias("turn")))) for df, n in held]
    rows = turned[0]
    for df in turned[1:]:
        rows = rows.unionByName(df)
    return latest(rows, id_col=id_col, order=order).withColumn(order, F.col(order)["time"]).select(*names)


def compacted(spark: SparkSession, path: str, *, id_col: str = "id", order: str = "ts", by_turn: bool = False) -> None:
    """Fold all deltas into one folder, which counts once it is written; then what it replaces goes."""
    deltas, base = folders(spark, path, "delta"), folders(spark, path, "base")
    if not deltas or base and base[-1] >= deltas[-1]:
        return
    current(spark, path, id_col=id_col, order=order, by_turn=by_turn).write.mode("overwrite").parquet(f"{path}/base={deltas[-1]}")
    for kind, numbers in (("delta", deltas), ("base", base)):
        for n in numbers:
            remove(spark, f"{path}/{kind}={n}")


def upsert_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, *, id_col: str = "id", order: str = "ts", chunk: int = UPDATE_CHUNK, file_format: str = "parquet") -> StreamingQuery:
    """Start a query that takes all files there are, chunk by chunk, and ends."""
    rows = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", chunk).load(source)

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch, id_col=id_col, order=order).write.mode("overwrite").parquet(f"{target}/delta={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
