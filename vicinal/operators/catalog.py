"""Models, their metadata sources and indexes, and who may see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AccessDenied, NotFound
from ..functions.predicates import where

#: The columns by which lists can be filtered.
BROWSE = {
    "cells": ["cas_cell_index", "cas_ingest_id", "original_cell_id", "cell_type", "cell_type_ontology_term_id", "assay", "development_stage", "tissue", "disease", "dataset_id"],
    "features": ["cas_feature_index", "original_feature_id", "feature_name", "feature_biotype", "feature_is_filtered", "feature_reference"],
    "ingests": ["cas_ingest_id", "dataset_id", "ingest_timestamp"],
    "users": ["created_at"],
}


def one(df: DataFrame, condition: Column, *, unique: bool = False):
    """The row that meets a condition; none is an error, and so are several where one only may exist."""
    found = df.filter(condition).limit(2).collect()
    if not found:
        raise NotFound("no such row")
    if unique and len(found) > 1:
        raise LookupError("more than one row")
    return found[0]


def visible(models: DataFrame, is_admin: bool) -> DataFrame:
    return models.filter(F.lit(is_admin) | ~F.col("admin_use_only"))


def authorised(models: DataFrame, name: str, is_admin: bool):
    found = one(models, F.col("model_name") == name)
    if found.admin_use_only and not is_admin:
        raise AccessDenied(f"{name} is for administrators")
    return found


def with_relations(models: DataFrame, metadata: DataFrame, columns: DataFrame, indexes: DataFrame | None = None, legacy: DataFrame | None = None) -> DataFrame:
    """Models with their metadata source, its ontology columns as an array in order of id, and their indexes; all optional."""
    held = columns.groupBy("cell_info_metadata_id").agg(F.array_sort(F.collect_list(F.struct(*["id", *[c for c in columns.columns if c not in ("id", "cell_info_metadata_id")]]))).alias("ontological_columns"))
    out = models.join(metadata.select(F.col("id").alias("cell_info_metadata_id"), F.struct(*metadata.columns).alias("cell_info_metadata")), "cell_info_metadata_id", "left")
    out = out.join(held, "cell_info_metadata_id", "left")
    for name, df in (("vector_index", indexes), ("matching_engine", legacy)):
        if df is not None:
            out = out.join(df.select(F.col("model_id").alias("id"), F.struct(*df.columns).alias(name)), "id", "left")
    return out


def cells_with_ingest(cells: DataFrame, ingests: DataFrame) -> DataFrame:
    return cells.join(ingests.select("cas_ingest_id", "dataset_id"), "cas_ingest_id", "left")


def browsed(df: DataFrame, kind: str, filters: dict | None = None) -> DataFrame:
    """Rows that meet filters on the columns that lists of this kind can be filtered by."""
    for key in filters or {}:
        if key.split("__")[0] not in BROWSE[kind]:
            raise NotFound(f"{kind} cannot be filtered by {key.split('__')[0]}")
    return df.filter(where(filters))


def page(df: DataFrame, key: str, number: int, size: int = 50) -> DataFrame:
    return df.orderBy(key).offset(number * size).limit(size)


def with_default(models: DataFrame, name: str) -> DataFrame:
    """A snapshot in which the named model alone is the default."""
    return models.withColumn("is_default_model", F.col("model_name") == name)


def feedback_declined(users: DataFrame, user_id: int) -> DataFrame:
    return users.withColumn("ask_for_feedback", F.when(F.col("id") == user_id, False).otherwise(F.col("ask_for_feedback")))


def feature_schemas(spark: SparkSession, database: str) -> DataFrame:
    """Names of the tables of a database."""
    return spark.sql(f"show tables in {database}").filter("not isTemporary").select(F.col("tableName").alias("schema_name"))


def features(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """index and feature_name of a schema, in order. The name is an identifier of the plan, never text of it."""
    full = f"{database}.{name}" if database else name
    return spark.sql("select index, feature_name from identifier(:name) order by index", args={"name": full})
