"""Building a probing index: sample, centroids, assignment, upserts, consolidation.

An index is a folder of versions. A version holds its centroids and its rows by update and partition; it counts once its centroids
are there, which are written last. Updates add files and rewrite nothing; of rows with one id the latest update counts. Consolidation
writes a version anew, with centroids trained on it, and then removes the older ones. Each step overwrites its own folder, so a
step that failed is simply run again.

A build keeps a log in its version: an entry for the training and for each finished update, put in place by a rename, with a
fingerprint of the batches and settings. A build of the same batches and settings that finds such a log goes on behind its last entry;
with other ones it begins anew. Publishing the centroids ends the build, and the log goes with it.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexConfigurationError
from ..functions import vectors as V
from ..functions.scalars import MOST_PARTITIONS, partition_number
from ..retry import NONE, Retry
from ..sources.shared import discard, file_system, remove, staged
from ..sources.writers import write_index
from .search import LARGEST, arrays, closest

TRAINING_SAMPLE, UPDATE_CHUNK = 5_000_000, 50
#: Rows for each partition that a later training takes at least.
LEAST_SAMPLE = 32


def build_metric(name: str) -> str:
    """The metrics an index can be built for, in any case."""
    if name.upper() not in ("COSINE", "L2"):
        raise IndexConfigurationError(f"{name!r} is neither COSINE nor L2")
    return name.lower()


def training_batches(batches: DataFrame, sample_size: int = TRAINING_SAMPLE) -> DataFrame:
    """Whole batches in order until their rows reach the sample size; the last may overshoot. batches: batch, n_rows (a row a file)."""
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("rows_before", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).filter(F.col("rows_before") < sample_size)


def estimated_total(rows: int, used: int, batches: int) -> int:
    return int(rows / used * batches) if used else 0


def prepared(df: DataFrame, normalise: bool, *, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, V.normalised(V.doubles(vector))) if normalise else df


def mean_centroids(df: DataFrame, by: Column, *, vector: str = "embedding") -> DataFrame:
    """partition_id and centroid: the mean vector of each group, summed by position so that no group is collected."""
    parts = df.select(by.cast("int").alias("partition_id"), F.posexplode(V.doubles(vector)).alias("pos", "x"))
    means = parts.groupBy("partition_id", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("partition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda t: t["m"]).alias("centroid"))


def sampled(rows: DataFrame, n_rows: int, sample_size: int = TRAINING_SAMPLE, *, id_col: str = "id") -> DataFrame:
    """About `sample_size` of the rows, those whose hashed id is small; all of them where there are no more."""
    share = min(1.0, sample_size / max(1, n_rows))
    return rows if share == 1 else rows.filter(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 30)) < int(share * (1 << 30)))


def trained_centroids(sample: DataFrame, partitions: int, *, vector: str = "embedding", iterations: int = 10, seed: int = 42) -> DataFrame:
    """Centroids by k-means over the training sample, which is staged, for it is read in each iteration; no more of them than different vectors."""
    there = F.col(vector).isNotNull() & F.forall(V.doubles(vector), lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))
    held = staged(sample.filter(there).select(array_to_vector(V.doubles(vector)).alias("features")), "training")
    different = held.select(F.xxhash64(F.col("features").cast("string"))).distinct().limit(partitions).count()
    if not different:
        raise IndexConfigurationError("there are no vectors to train on")
    if different < partitions:  # each of them is a centroid
        got = sample.filter(there).select(V.doubles(vector).alias("centroid")).distinct()
        discard(held)
        return got.select((F.row_number().over(Window.orderBy("centroid")) - 1).cast("int").alias("partition_id"), "centroid")
    model = KMeans(k=partitions, maxIter=iterations, seed=seed, featuresCol="features").fit(held)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    discard(held)
    return sample.sparkSession.createDataFrame(rows, "partition_id int, centroid array<double>")


def assigned(df: DataFrame, centroids: DataFrame, metric: str = "l2", *, vector: str = "embedding") -> DataFrame:
    """df with the partition of its nearest centroid; ties to the smaller one. Rows are not shuffled: each meets the broadcast centroids.

    A step takes as many rows as make about 2 million distances, so memory does not grow with the centroids. A vector that takes no
    part in searches (null, or with a null or non-finite component) gets partition -1, which no search probes.
    """
    got = centroids.select(F.col("partition_id").cast("int").alias("id"), V.doubles("centroid").alias("v")).orderBy("id").toArrow()
    sent = df.sparkSession.sparkContext.broadcast((got.column("id").to_numpy(), arrays(got, None)[1]))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "partition_id"), T.StructField("partition_id", T.IntegerType())])

    def run(batches):
        ids, m = sent.value
        for b in batches:
            v = b.column(vector)
            there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            ok, x = arrays(pa.RecordBatch.from_arrays([v.drop_null().cast(pa.list_(pa.float64()))], names=["v"]), m.shape[1])
            at = np.full(b.num_rows, -1, np.int32)
            at[there[ok]] = ids[closest(metric, x, m)]
            keep = [n for n in b.schema.names if n != "partition_id"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(at, pa.int32())], names=[*keep, "partition_id"])

    return df.mapInArrow(run, schema)


def latest(rows: DataFrame, *, id_col: str = "id", order: str = "ts") -> DataFrame:
    """The last write of each id; of rows of one time the greatest, so reruns agree. Rows pre-aggregate, so an id that is written again and again costs a task one row."""
    rest = [c for c in rows.columns if c not in (id_col, order)]
    last = rows.groupBy(id_col).agg(F.max(F.struct(order, *rest)).alias("r"))
    return last.select(*(id_col if c == id_col else F.col("r")[c].alias(c) for c in rows.columns))


def upserted(index: DataFrame, update: DataFrame, *, id_col: str = "id", order: str = "ts") -> DataFrame:
    """The index after an update: rows of the update replace those with the same id unless these are later."""
    turn = lambda df, n: df.select(*(c for c in df.columns if c != order), F.struct(F.col(order).alias("time"), F.lit(n).alias("turn")).alias(order))
    got = latest(turn(index, 0).unionByName(turn(update, 1)), id_col=id_col, order=order)
    return got.withColumn(order, F.col(order)["time"]).select(*index.columns)


def consolidated(rows: DataFrame, n_partitions: int, metric: str = "l2", **columns: str) -> tuple[DataFrame, DataFrame]:
    """Compacted rows, assigned to centroids that are trained on them anew; and the centroids."""
    compact = latest(rows, id_col=columns.get("id_col", "id"), order=columns.get("order", "ts"))
    centroids = trained_centroids(compact, n_partitions)
    return assigned(compact, centroids, metric), centroids


def create_index(rows: DataFrame, path: str, *, metric: str = "COSINE", normalise: bool = True, max_partitions: int = MOST_PARTITIONS, partitions: int | None = None, vector: str = "embedding", sample_size: int = TRAINING_SAMPLE) -> DataFrame:
    """Train on a sample, assign all rows and write; returns the centroids. The partition count follows the number of rows unless it is given."""
    kind = build_metric(metric)
    ready, n_rows = prepared(rows, normalise, vector=vector), rows.count()
    centroids = trained_centroids(sampled(ready, n_rows, sample_size), partitions or partition_number(n_rows, max_partitions), vector=vector)
    write_index(assigned(ready, centroids, kind, vector=vector), path)
    return centroids


# The life of an index: created from the first batches, updated by the others, consolidated.


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of an index, oldest first."""
    fs, at = file_system(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = sorted(int(n.removeprefix("version=")) for n in found if n.startswith("version="))
    return [n for n in numbers if fs.exists(file_system(spark, f"{path}/version={n}/centroids/_SUCCESS")[1])]


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, embedding, partition_id) and centroids of the newest version. A consolidated version is one update, read as it lies."""
    found = versions(spark, path)
    if not found:
        raise IndexConfigurationError(f"no index at {path}")
    at = f"{path}/version={found[-1]}"
    rows = spark.read.parquet(f"{at}/rows")
    updates = rows.select("update").distinct().limit(2).count()
    rows = latest(rows, order="update") if updates > 1 else rows
    return rows.select("id", "embedding", "partition_id"), spark.read.parquet(f"{at}/centroids")


def write_update(rows: DataFrame, centroids: DataFrame, path: str, version: int, update: int, metric: str) -> None:
    """Rows (id, embedding) of an update, the last of each id, by partition; files of a partition lie together."""
    placed = assigned(rows.select("id", "embedding"), centroids, metric)
    placed.repartition("partition_id").write.mode("overwrite").partitionBy("partition_id").parquet(f"{path}/version={version}/rows/update={update}")


def last_of_batches(rows: DataFrame) -> DataFrame:
    return latest(rows.select("id", "batch", "embedding"), order="batch").select("id", "embedding")


def build_index(batches: DataFrame, path: str, *, metric: str = "COSINE", normalise: bool = True, sample_size: int = TRAINING_SAMPLE, max_partitions: int = MOST_PARTITIONS, partitions: int | None = None, chunk: int = UPDATE_CHUNK, retry: Retry = NONE) -> None:
    """An index of batches (batch, id, embedding), in order of batch: trained and created on the first whole batches that make the
    sample, updated by the others `chunk` at a time, and consolidated if there were any. What was at the path goes when the new version is
    complete. A build that failed goes on where it stopped when it is called again, and each step is tried again as `retry` says."""
    spark, kind = batches.sparkSession, build_metric(metric)
    before = versions(spark, path)
    version = before[-1] + 1 if before else 0
    ready = prepared(batches.select("batch", "id", "embedding"), normalise)
    sizes = retry.frame(lambda: batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows")), "batches")
    used = staged(training_batches(sizes, sample_size), "used")
    n_used, n_rows, last = used.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0)), F.max("batch")).first()
    rest = [r.batch for r in sizes.filter(F.col("batch") > F.lit(last)).orderBy("batch").collect()] if n_used else []  # names of files
    n = partitions or partition_number(estimated_total(n_rows, n_used, n_used + len(rest)), max_partitions)
    log = BuildLog(spark, f"{path}/version={version}", sizes, (kind, normalise, n, sample_size, chunk))
    first = None
    if not log.done("trained"):
        first = retry.frame(lambda: last_of_batches(ready.filter(F.col("batch") <= F.lit(last))), "first")
        retry.call(lambda: trained_centroids(first, n).coalesce(1).write.mode("overwrite").parquet(log.centroids))
        log.add("trained")
    centroids = spark.read.parquet(log.centroids)
    if not log.done("update-0"):
        first = first or retry.frame(lambda: last_of_batches(ready.filter(F.col("batch") <= F.lit(last))), "first")
        retry.call(lambda: write_update(first, centroids, path, version, 0, kind))
        log.add("update-0")
    for k in range(0, len(rest), chunk):
        if not log.done(f"update-{k // chunk + 1}"):
            own = ready.filter((F.col("batch") >= F.lit(rest[k])) & (F.col("batch") <= F.lit(rest[min(k + chunk, len(rest)) - 1])))
            retry.call(lambda own=own, k=k: write_update(last_of_batches(own), centroids, path, version, k // chunk + 1, kind))
            log.add(f"update-{k // chunk + 1}")
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}/centroids")
    log.close()
    discard(first, used, sizes)
    if rest:
        retry.call(lambda: consolidate(spark, path, metric=metric, sample_size=sample_size, partitions=n))
    else:
        vacuum(spark, path)


class BuildLog:
    """The finished steps of a build, as files in its version. What was written under another fingerprint goes when the log is opened."""

    def __init__(self, spark: SparkSession, version: str, sizes: DataFrame, settings: tuple):
        self.spark, self.path, self.centroids = spark, f"{version}/build", f"{version}/build/centroids"
        # Order does not matter to a sum; one row comes back however many batches there are.
        batches = sizes.agg(F.count(F.lit(1)), F.sum(F.xxhash64("batch", "n_rows").cast("decimal(38,0)"))).first()
        self.mark = hashlib.sha256(json.dumps([[str(x) for x in batches], [str(x) for x in settings]]).encode()).hexdigest()[:16]
        fs, at = file_system(spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        if not any(n.endswith(f".{self.mark}") for n in names):
            remove(spark, version)

    def _entry(self, step: str):
        return file_system(self.spark, f"{self.path}/{step}.{self.mark}")

    def done(self, step: str) -> bool:
        fs, at = self._entry(step)
        return fs.exists(at)

    def add(self, step: str) -> None:
        fs, at = self._entry(step)
        half = at.suffix(".half")
        fs.create(half, True).close()
        if not fs.rename(half, at):
            raise IndexConfigurationError(f"the step {step} could not be entered in {self.path}")

    def close(self) -> None:
        remove(self.spark, self.path)


def consolidate(spark: SparkSession, path: str, *, metric: str = "COSINE", sample_size: int = TRAINING_SAMPLE, partitions: int | None = None) -> None:
    """A new version: the last write of each id, centroids trained on a sample of them, one update; then the older versions go."""
    rows, before = read_index(spark, path)
    version = versions(spark, path)[-1] + 1
    held = staged(rows.select("id", "embedding"), "compact")
    n = partitions or before.count()
    centroids = trained_centroids(sampled(held, held.count(), max(sample_size, LEAST_SAMPLE * n)), n)
    write_update(held, centroids, path, version, 0, build_metric(metric))
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}/centroids")
    discard(held)
    vacuum(spark, path)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove all versions but the newest complete one."""
    fs, at = file_system(spark, path)
    newest = versions(spark, path)[-1]
    for name in [s.getPath().getName() for s in fs.listStatus(at)]:
        if name.startswith("version=") and name != f"version={newest}":
            remove(spark, f"{path}/{name}")
