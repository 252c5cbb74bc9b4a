"""Metadata of ids, in the order asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MetadataError
from ..sources.shared import staged


def requested_ids(spark: SparkSession, ids: list[int]) -> DataFrame:
    """pos and id of a request; an empty one is an error."""
    if not ids:
        raise MetadataError("no ids are asked for")
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos bigint, cas_cell_index bigint")


def metadata_by_ids(ids: DataFrame, metadata: DataFrame, names: list[str], *, id_col: str = "cas_cell_index") -> DataFrame:
    """pos, id and the named columns. Missing ids are left out, ids that repeat give rows that repeat. The request is the small side."""
    columns = [c for c in names if c != id_col]
    return ids.select("pos", id_col).join(metadata.select(id_col, *columns), id_col).select("pos", id_col, *columns).orderBy("pos")


def with_metadata(neighbours: DataFrame, metadata: DataFrame, names: list[str], *, id_col: str = "cas_cell_index", check: bool = True) -> DataFrame:
    """Neighbours with the named columns. Metadata is read once for each distinct id; a neighbour without any is an error.

    With the check the neighbours are staged first (k rows a query), so that their search runs once."""
    if check and not hasattr(neighbours, "staged_at"):
        neighbours = staged(neighbours, "near")
    wanted = neighbours.select(id_col).distinct()
    found = metadata.select(id_col, *[c for c in names if c != id_col]).join(wanted, id_col, "left_semi")
    if check and not wanted.join(metadata.select(id_col), id_col, "left_anti").isEmpty():
        raise MetadataError("a neighbour has no metadata")
    return neighbours.join(found, id_col)
