"""URL filters: expressions of host suffix and path prefix, joined to the rules by a short hash, confirmed by the full digest.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. A null
url, or one without `://`, has an empty host and path. A rule fits its host and all subdomains when the url's path starts with the
rule's path. Of the rules that fit, the longest wins (host and path together; then the longer host; then block before allow). A
url that no rule fits gets `default`. Rules with a null host, path or verdict are ignored; a rule with an empty host fits no url
unless the url's host is empty too. Rows that repeat are judged alike and all returned. Extra columns are ignored.

Scale: each url yields one expression for each (host labels, path length) that some rule has, so the work a url costs follows the
rules' shapes and not its own length; the shapes are one literal of the plan, however many they are. The candidates of a row stay in its task
up to the partial maximum of the rules' ranks, so the one shuffle moves
about a row for each url; rows with the same id and url are pre-aggregated too. The rules are broadcast only when their count is
at most `broadcast_rules`; beyond it both sides are shuffled by the hash prefix, where the rows' own entries have keys of their own, and
Spark splits large partitions of that join.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules of the contract's query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
BROADCAST_RULES = 100_000


def judge_urls(df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """For each row of df: id, url, host, path, rule (host and path, else null) and verdict. rules: host, path, verdict."""
    own = (
        rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .dropna()
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("labels", F.size(F.split("rule_host", "\\.", -1)))
        .withColumn("chars", F.length("rule_path"))
        .groupBy("rule_host", "rule_path", "rule", "labels", "chars")
        .agg(F.max("verdict").alias("verdict"))  # block before allow
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
        .withColumn("short", F.substring("digest", 1, 8))
        .withColumn("rank", F.length("rule").cast("long") * (1 << 32) + F.length("rule_host") * 2 + (F.col("verdict") == "block").cast("long"))
    )
    shapes = sorted((r.labels, r.chars) for r in own.select("labels", "chars").distinct().collect())
    n_rules = own.count() if shapes else 0
    rest = F.expr(f"case when instr({url_col}, '://') > 0 then substring({url_col}, instr({url_col}, '://') + 3) else '' end")
    urls = (
        df.select(F.col(id_col), F.col(url_col), rest.alias("rest"))
        .withColumn("at", F.regexp_extract(F.coalesce("rest", F.lit("")), r"^[^/?#]*", 0))
        .withColumn("host", ascii_lower(F.col("at")))
        .withColumn("path", F.regexp_extract(F.expr("substring(coalesce(rest, ''), length(at) + 1)"), r"^[^?#]*", 0))
        .select(id_col, url_col, "host", "path")
    )
    if not shapes:
        return urls.select(id_col, url_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # The first entry stands for the row itself; it carries the row's count and has no expression, but a key that no rule has.
    dots = F.size(F.split("host", "\\.", -1))
    literal = F.from_json(F.lit(json.dumps([{"labels": k, "chars": n} for k, n in shapes])), "array<struct<labels: int, chars: int>>")
    fits = F.filter(literal, lambda x: (dots >= x["labels"]) & (F.length("path") >= x["chars"]))
    tried = F.transform(fits, lambda x: F.concat_ws("\n", F.array_join(F.slice(F.split("host", "\\.", -1), F.greatest(dots - x["labels"] + 1, F.lit(1)), x["labels"]), "."), F.substr(F.col("path"), F.lit(1), x["chars"])))
    tries = F.concat(F.array(F.lit(None).cast("string")), tried)
    cand = urls.select(id_col, url_col, "host", "path", F.posexplode(tries).alias("pos", "expression")).withColumn("own_digest", F.sha2("expression", 256))
    cand = cand.withColumn("own_short", F.coalesce(F.substring("own_digest", 1, 8), F.concat(F.lit("-"), F.hex(F.xxhash64(id_col, url_col)))))
    right = own.select("short", "digest", "rule", "verdict", "rank")
    right = F.broadcast(right) if n_rules <= broadcast_rules else right.hint("merge")
    fit = F.col("digest") == F.col("own_digest")
    return (
        cand.join(right, cand.own_short == right.short if n_rules > broadcast_rules else F.col("own_short") == F.col("short"), "left")
        .groupBy(id_col, url_col, "host", "path")
        .agg(F.max_by(F.when(fit, F.struct("rule", "verdict")), F.when(fit, F.col("rank"))).alias("best"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"))
        .select(id_col, url_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .drop("copy")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with r(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, coalesce(rest, '') as rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as own from u),
p as (
  select row_number() over () as row, page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') as path from h),
f as (
  select row, page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by row order by length(r.host || r.path) desc nulls last, length(r.host) desc, r.verdict desc) as k
  from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1
"""
