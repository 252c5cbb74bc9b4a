"""Sinks: appended rows, snapshots, partitioned indexes, ontology documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import remove


def append(df: DataFrame, path: str) -> None:
    """Rows added to a table; files appear when the job commits, all or none."""
    df.write.mode("append").parquet(path)


def bulk_insert(df: DataFrame, url: str, name: str, *, batch_size: int = 10_000, **options: str) -> None:
    """Rows added to a database table, `batch_size` a statement."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=name, batchsize=str(batch_size), **options).save()


def snapshot_update(df: DataFrame, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A new snapshot: for each column (where, value), the value where the condition is true, else what was there."""
    return df.withColumns({c: F.when(where, value).otherwise(F.col(c)) for c, (where, value) in changes.items()})


def write_index(assigned: DataFrame, path: str) -> None:
    """An index from scratch: whatever is at the path goes first. Rows of a partition lie together before the write, so that files are few."""
    remove(assigned.sparkSession, path)
    assigned.repartition("partition_id").write.mode("overwrite").partitionBy("partition_id").parquet(path)


def write_document(doc: DataFrame, path: str) -> None:
    """One row as one JSON object."""
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
