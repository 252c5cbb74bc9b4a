r"""Mixing sources to target weights.

A document's size is its number of words `[^\x20\x09-\x0D]+` (null: 0). Sources in order of code point, null last, weigh 1, 2, 3,
repeating (or what `weights` says), and share the total of all sizes. A target stops at `most` times its source's size; what is
over is shared again by weight until no target is above. With sources in order of (most * size / weight) the capped ones are a
prefix, so running sums find the level. A source's repetition rate is target / size; each document is taken floor(rate) times
and once more when its draw, 52 bits of md5(seed, doc_id), is below the fraction: reruns agree, and so do repeated rows, which
share a draw. Null ids draw as the empty text. Null or empty texts have size 0 and are emitted at their source's rate as well.
A source all of whose documents are empty has rate 0. An empty table gives an empty table. Extra columns are kept by mix().

Scale: sizes are pre-aggregated by source before the shuffle, so a hot source costs one row a task. Sources are ranked and summed in
ranges, whose totals alone meet in one task. The per-source table is
joined by broadcast when it has at most `broadcast_sources` rows, else by a shuffle that Spark splits where one source is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, staged, table

MOST = 3
SEED = "mix"
#: Columns that plan_mix() adds.
SIZE, SOURCE_SIZE, TARGET, COPIES = "__mix_size", "__mix_source_size", "__mix_target", "__mix_copies"
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df, dealt out by ranges of `order`, with before_x: the sum of x over all rows before a row. Only one row a range is summed in one task."""
    parts = staged(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(*(F.sum(x).alias(x) for x in sums))
    totals = totals.select(F.col("part").alias("of"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"all_{x}") for x in sums))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(totals), F.col("part") == F.col("of")).select(*df.columns, *((F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"all_{x}")).alias(f"before_{x}") for x in sums))


def targets(sizes: DataFrame, *, source_col: str = "source", most: int = MOST, cycle: int = 3) -> DataFrame:
    """One row a source: own_source, source_size, target. sizes: source and size."""
    name = F.col("own_source").asc_nulls_last()
    by = sizes.groupBy(F.col(source_col).alias("own_source")).agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    weighed = running(by, [name], ["one"]).select("own_source", "source_size", (F.col("before_one") % cycle + 1).alias("weight"), (most * F.col("source_size")).alias("cap"))
    order = [F.col("cap") / F.col("weight"), name]
    filled = staged(running(weighed, order, ["cap", "weight"]), "filled")
    everyone = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    # If all sources before this one are capped, this is the level of the rest; those whose cap is lower than the level stop there.
    # Behind the first that does not stop, levels only fall.
    level = (F.lit(everyone["size"]) - F.col("before_cap")) / (F.lit(everyone["weight"]) - F.col("before_weight"))
    flagged = filled.withColumn("level", level).withColumn("capped", F.col("cap") < F.col("weight") * F.col("level"))
    reached = flagged.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0]
    return flagged.select("own_source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(reached)).alias("target"))


def copies(rate: Column, id_col: Column, seed: str) -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, cycle: int = 3, seed: str = SEED, broadcast_sources: int = BROADCAST_SOURCES, names: Sequence[str] = (SIZE, SOURCE_SIZE, TARGET, COPIES)) -> DataFrame:
    """docs, and the columns SIZE, SOURCE_SIZE, TARGET and COPIES, which it must not have yet."""
    goal = targets(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), most=most, cycle=cycle)
    size, source_size, target, copied = names
    key = free_name(docs, "__mix_source")
    goal = goal.select(F.col("own_source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    goal = staged(goal, "targets")
    few = goal.count() <= broadcast_sources
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    return (
        docs.withColumn(size, size_of(F.col(text_col)))
        .join(F.broadcast(goal) if few else goal.hint("merge"), F.col(source_col).eqNullSafe(F.col(key)), "left")
        .drop(key)
        .withColumn(copied, copies(rate, F.col(id_col), seed))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each document as many times as the mix takes it, with its columns and mix_copy, the number of the copy from 1; the name gets a `_` where docs has a column of that name."""
    own = [free_name(docs, c) for c in (SIZE, SOURCE_SIZE, TARGET, COPIES)]
    planned = plan_mix(docs, names=own, **options).filter(F.col(own[3]) > 0)
    return planned.withColumn(free_name(docs, "mix_copy"), F.explode(F.sequence(F.lit(1).cast("long"), own[3]))).drop(*own)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col(SIZE).alias("size"), F.col(SOURCE_SIZE).alias("source_size"), F.col(TARGET).alias("target"), (F.col(SIZE) * F.col(COPIES)).alias("taken"))


SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as weight, 3 * source_size as cap from s),
f as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cast(cap as double) / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by cast(cap as double) / weight, encode(source) nulls last rows between current row and unbounded following))::double as level from w),
c as (select *, cap < weight * level as capped from f),
t as (select source, source_size, case when capped then cap::double else weight * (select max(level) from c where not capped) end as target from c),
r as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0::double as draw
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) as bigint) as taken from r
"""
