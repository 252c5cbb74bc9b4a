"""One-time changes of tables, each as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unique_suffix


def metadata_from_models(models: DataFrame, created: Column) -> DataFrame:
    """A metadata source for each model that has a uri: its name and ' metadata'."""
    return models.filter("cell_metadata_uri is not null").select(F.concat("model_name", F.lit(" metadata")).alias("name"), F.col("cell_metadata_uri").alias("soma_dataframe_uri"), created.alias("created_date"))


def with_ids(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("id", F.row_number().over(Window.orderBy(order)).cast("long"))


def update_from(target: DataFrame, source: DataFrame, key: str, changes: dict[str, str]) -> DataFrame:
    """target, with columns taken from the row of source that has the same key, where there is one. source has a row a key at most."""
    own = source.select(F.col(key).alias("own_key"), F.lit(True).alias("met"), *(F.col(s).alias(f"new_{t}") for t, s in changes.items()))
    joined = target.join(own, F.col(key) == F.col("own_key"), "left")
    return joined.withColumns({t: F.when(F.col("met"), F.col(f"new_{t}")).otherwise(F.col(t)) for t in changes}).drop("own_key", "met", *(f"new_{t}" for t in changes))


def filled(df: DataFrame, constants: dict[str, Column]) -> DataFrame:
    """Columns set to constants throughout."""
    return df.withColumns(constants)


def raised_default_quota(users: DataFrame) -> DataFrame:
    return users.withColumn("cell_quota", F.when(F.col("cell_quota") == 50_000, F.lit(100_000)).otherwise(F.col("cell_quota")))


def marked_increased(users: DataFrame) -> DataFrame:
    return users.withColumn("quota_increased", F.when(F.col("lifetime_cell_quota") == 200_000, True).otherwise(F.col("quota_increased")))


def with_unique_names(df: DataFrame, name: str, base: str) -> DataFrame:
    """A name for each row: the base with a random suffix."""
    return df.withColumn(name, unique_suffix(F.col(base)))


def parsed_json(df: DataFrame, column: str) -> DataFrame:
    """Text as variant values."""
    return df.withColumn(column, F.try_parse_json(column))
