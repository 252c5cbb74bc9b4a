"""Annotating a query matrix from start to end: who may, how much is left, embed, search, sum up, and what the log says of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..retry import SEARCH, Retry
from ..sources.readers import checked_matrix
from ..sources.shared import staged
from ..sources.writers import append
from . import activity as A
from . import catalog as C
from . import consensus as K
from . import lookup as L
from . import search as N
from .embedding import Model, embed


@dataclass(frozen=True)
class Service:
    """The tables and the index that annotations are made from. The log is a folder that rows are appended to."""

    models: DataFrame
    users: DataFrame
    log: str
    metadata: DataFrame
    index: DataFrame
    settings: N.IndexSettings
    centroids: DataFrame | N.Centroids | None = None
    columns: list[str] = field(default_factory=lambda: ["cell_type"])
    graphs: DataFrame | None = None
    retry: Retry = SEARCH


def annotate(service: Service, matrix: DataFrame, model: Model, *, user_id: int, model_name: str, trace_header: str, now: Column, is_admin: bool = False, strategy: str = "summary_statistics", **options) -> DataFrame:
    """What the neighbours of each query cell say together. The result is staged, so an error of any step is known when the log is written.

    Refusals (no such model, not for this user, a matrix of a wrong shape, more cells than the quota leaves) leave no row. Else
    the log has STARTED and then SUCCEEDED or FAILED, with the request's cells; an error of the log itself does not hide the first.
    """
    spark = matrix.sparkSession
    C.authorised(service.models, model_name, is_admin)
    cells = checked_matrix(matrix).count()
    request = spark.createDataFrame([(user_id, trace_header, model_name, f"annotate_{strategy}", cells)], "user_id bigint, trace_header string, model_name string, method string, cell_count bigint")
    so_far = A.read_log(spark, service.log)
    left = A.quota_report(so_far, service.users.filter(F.col("user_id") == user_id), now).select("user_id", F.col("remaining_weekly_quota").alias("remaining"))
    A.require_quota(request.select("user_id", "cell_count"), left)
    append(A.activity_rows(request, "STARTED", now), service.log)
    try:
        queries = staged(embed(matrix, model, service.settings.embedding_dimension), "embedded")
        near = service.retry.frame(lambda: N.search(queries, service.index, service.settings, service.centroids, service.graphs), "near")
        near = N.checked_response(queries, near)
        out = staged(K.summarize(strategy, L.with_metadata(near, service.metadata, service.columns), **options), "annotated")
    except Exception:
        try:
            append(A.activity_rows(request, "FAILED", now), service.log)
        except Exception as e:  # noqa: BLE001
            print(f"the log could not be written: {e}")
        raise
    append(A.activity_rows(request, "SUCCEEDED", now), service.log)
    return out
