"""The lifecycle of requests as a stream: the status of each request while rows of the activity log come in.

A request has FAILED when a row says so, or when it has started and no end comes within `timeout` of the watermark, which is the latest
time of all rows less `delay`. Rows before the watermark of the micro-batches so far are dropped, so `delay` says how far out of order a
log may be. The state of a request is one row; it goes `keep` after its last row, once nothing is awaited, and rows of the same request
after that begin a new one. Each micro-batch writes the states that have changed, by rows or by the watermark, as a delta; what is the
latest of all deltas is the state that the next one joins with its own sums. A micro-batch so reads the states once, whatever has changed;
every `FOLDED` deltas they become one table. A batch that is run again overwrites its delta; progress is in the checkpoint, from which a
new start goes on.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.shared import remove
from .upsert import compacted, current, folders

ENDS = ("FAILED", "SUCCEEDED")
#: Times are microseconds.
HELD = "request_id string, start bigint, end bigint, last bigint, failed boolean, succeeded boolean, cell_count double, n_rows bigint, status string, changes bigint"
NAMES = [n.split()[0] for n in HELD.split(", ")]
#: A setting that a run leaves as it is: no state store is used.
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Deltas that are folded into one table.
FOLDED = 16


def merged(held: DataFrame, rows: DataFrame, timeout: int, delay: int, keep: int) -> DataFrame:
    """The states that change: held (HELD) by rows (request_id, event, cell_count, micros) and by the watermark behind these."""
    before = held.agg(F.max("last")).first()[0]
    if before is not None:
        rows = rows.filter(F.col("micros") >= before - delay)
    newest = rows.agg(F.max("micros")).first()[0]
    mark = max((x for x in (before, newest) if x is not None), default=0) - delay
    is_end = F.col("event").isin(*ENDS)
    own = rows.groupBy(F.col("request_id").alias("own")).agg(
        F.min(F.when(F.col("event") == "STARTED", F.col("micros"))).alias("own_start"), F.min(F.when(is_end, F.col("micros"))).alias("own_end"), F.max("micros").alias("own_last"),
        F.bool_or(F.coalesce(F.col("event") == "FAILED", F.lit(False))).alias("own_failed"), F.bool_or(F.coalesce(F.col("event") == "SUCCEEDED", F.lit(False))).alias("own_succeeded"), F.max("cell_count").alias("own_cell_count"), F.count(F.lit(1)).alias("own_n_rows"),
    )
    due = F.col("start") + timeout
    awaited = lambda to: F.col("start").isNotNull() & F.col("end").isNull() & (due >= to)
    gone = F.lit(False) if before is None else (F.col("last") + keep < before - delay) & ~awaited(before - delay)
    both = held.join(own, F.col("request_id") == F.col("own"), "full_outer")
    new = F.col("request_id").isNull() | (F.col("own").isNotNull() & gone)
    was = lambda name, none=None: F.when(~new, F.col(name)).otherwise(F.lit(none))
    out = both.select(
        F.coalesce("own", "request_id").alias("request_id"), F.least(was("start"), "own_start").alias("start"), F.least(was("end"), "own_end").alias("end"), F.greatest(was("last"), "own_last").alias("last"),
        (was("failed", False) | F.coalesce("own_failed", F.lit(False))).alias("failed"), (was("succeeded", False) | F.coalesce("own_succeeded", F.lit(False))).alias("succeeded"), F.greatest(was("cell_count"), "own_cell_count").alias("cell_count"),
        (was("n_rows", 0) + F.coalesce("own_n_rows", F.lit(0))).cast("bigint").alias("n_rows"), F.col("status").alias("before"), F.col("own").isNotNull().alias("touched"), (was("changes", 0) + 1).cast("bigint").alias("changes"),
    )
    late = F.coalesce(F.coalesce("end", F.lit(mark)) > due, F.lit(False))
    status = F.when(F.col("failed") | late, "FAILED").when(F.col("succeeded"), "SUCCEEDED").otherwise("STARTED")
    return out.withColumn("status", status).filter(F.col("touched") | (F.col("status") != F.col("before"))).select(*NAMES)


def lifecycle_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, *, timeout: datetime.timedelta, delay: datetime.timedelta = datetime.timedelta(0), keep: datetime.timedelta = datetime.timedelta(days=7), chunk: int = 1000, file_format: str = "parquet") -> StreamingQuery:
    """Start a query that takes all files there are, `chunk` at a time, and ends. The log has request_id, event, cell_count and finished_time."""
    times = [x // datetime.timedelta(microseconds=1) for x in (timeout, delay, keep)]
    log = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", chunk).load(source)
    rows = log.filter("request_id is not null and finished_time is not null").select("request_id", "event", F.col("cell_count").cast("double").alias("cell_count"), F.unix_micros(F.col("finished_time").cast("timestamp")).alias("micros"))

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if any(n >= number for n in folders(own, target, "base")):
            return  # this batch is in it
        remove(own, f"{target}/delta={number}")
        if len(folders(own, target, "delta")) >= FOLDED:
            compacted(own, target, id_col="request_id", order="changes", by_turn=True)
        held = current(own, target, id_col="request_id", order="changes", by_turn=True)
        held = own.createDataFrame([], HELD) if held is None else held
        merged(held, batch, *times).write.mode("overwrite").parquet(f"{target}/delta={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, target: str) -> DataFrame | None:
    """request_id, status, cell_count, n_rows of all requests, as of the last micro-batch; None before the first. Of a request that began anew the later one."""
    found = current(spark, target, id_col="request_id", order="changes", by_turn=True)
    return None if found is None else found.select("request_id", "status", "cell_count", "n_rows")
