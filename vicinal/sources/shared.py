"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Folders made here that nobody has discarded, with their sessions; they go when the program ends.
_LEFT: dict[str, SparkSession] = {}
#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Where it is unset, a new local folder in local mode and an error on a cluster, whose machines would each write into their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the program ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_discard_left)
    _LEFT[path] = spark
    return path


def write(spark: SparkSession, writer: DataFrameWriter, path: str, table: str | None = None) -> None:
    """Write what is read once it is there: the shuffles that made it are removed at the end, and not whenever the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.option("path", path).saveAsTable(table) if table else writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(spark, df.write, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove staged tables whose readers are done; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "staged_at", None):
            remove(df.sparkSession, path)


def _discard_left() -> None:
    for path, spark in [*_LEFT.items()]:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session's JVM may have ended before
            return


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
    _LEFT.pop(path, None)


def copied(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder copied between any two file systems that Hadoop knows: up to a store, down from it, or within."""
    (from_fs, from_at), (to_fs, to_at) = file_system(spark, source), file_system(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, from_at, to_fs, to_at, False, True, spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, prefix: str) -> DataFrame:
    """path and length of the files below a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select("path", "length", "modificationTime")
