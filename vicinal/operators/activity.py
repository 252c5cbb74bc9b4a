"""Activity log and quotas. Users: user_id, created_at, quotas; activity: user_id, request_id, cell_count, event, finished_time.

Usage is one pass over the log: requests are pre-aggregated by user and request, then by user.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuotaExceeded
from ..functions.scalars import in_week_of, trace_id
from ..sources.shared import file_system, staged

INCREASED_QUOTA = 200_000


def activity_rows(requests: DataFrame, event: str, finished: Column | None = None) -> DataFrame:
    """Log rows of an event: the request id is the trace id of the request's header."""
    return requests.select("user_id", trace_id(F.col("trace_header")).alias("request_id"), "model_name", "method", "cell_count", F.lit(event).alias("event"), (F.current_timestamp().cast("timestamp_ntz") if finished is None else finished).alias("finished_time"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows appended to a log so far; none where nothing was appended yet."""
    fs, at = file_system(spark, path)
    kind = "user_id bigint, request_id string, model_name string, method string, cell_count bigint, event string, finished_time timestamp_ntz"
    return spark.read.schema(kind).parquet(path) if fs.exists(at) else spark.createDataFrame([], kind)


def weekly_usage(activity: DataFrame, users: DataFrame, start: Column) -> DataFrame:
    """user_id and the cells of this week's requests, 0 without any. A request counts its largest count, unless it failed; one that
    is still running counts. start is an expression over users."""
    own = users.select("user_id", start.alias("week_start"))
    recent = activity.filter("request_id is not null").join(own, "user_id").filter(F.col("finished_time") >= F.col("week_start"))
    requests = recent.groupBy("user_id", "request_id").agg(F.max("cell_count").alias("cells"), F.bool_or(F.col("event") == "FAILED").alias("failed"))
    used = requests.filter("not coalesce(failed, false)").groupBy("user_id").agg(F.sum("cells").alias("cells"))
    return own.select("user_id").join(used, "user_id", "left").select("user_id", F.coalesce("cells", F.lit(0)).alias("used"))


def week_start(today: Column) -> Column:
    """Of a user with created_at: the weekday of sign-up is the anchor."""
    return in_week_of(today, F.col("created_at"))


def lifetime(activity: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, total_cells, total_requests: what users carry, and the succeeded rows of the log (rows, not distinct requests)."""
    done = activity.filter("event = 'SUCCEEDED'").groupBy("user_id").agg(F.sum("cell_count").alias("cells"), F.count(F.lit(1)).alias("n"))
    return users.join(done, "user_id", "left").select("user_id", (F.col("cells_processed") + F.coalesce("cells", F.lit(0))).alias("total_cells"), (F.col("requests_processed") + F.coalesce("n", F.lit(0))).alias("total_requests"))


def remaining(weekly_quota: Column, used: Column, lifetime_quota: Column, total: Column) -> Column:
    """The smaller of what week and lifetime leave, at least 0; without a lifetime quota the week's."""
    return F.greatest(F.least(weekly_quota - used, lifetime_quota - total), F.lit(0))


def reset_date(now: Column, created: Column) -> Column:
    """Midnight today and as many days as the weekday is past that of sign-up, a week more if it isn't past. Kept as clients know it;
    next_anchor() is the day on which the week really starts anew."""
    days = F.weekday(now) - F.weekday(created)
    return F.date_add(now.cast("date"), F.when(days <= 0, days + 7).otherwise(days)).cast("timestamp_ntz")


def next_anchor(now: Column, created: Column) -> Column:
    days = F.pmod(F.weekday(created) - F.weekday(now), F.lit(7))
    return F.date_add(now.cast("date"), F.when(days == 0, 7).otherwise(days)).cast("timestamp_ntz")


def quota_report(activity: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    used, life = weekly_usage(activity, users, week_start(now)), lifetime(activity, users)
    return users.join(used, "user_id").join(life, "user_id").select(
        "user_id",
        F.col("cell_quota").alias("weekly_quota"),
        remaining(F.col("cell_quota"), F.col("used"), F.col("lifetime_cell_quota"), F.col("total_cells")).alias("remaining_weekly_quota"),
        reset_date(now, F.col("created_at")).alias("quota_reset_date"),
        F.col("lifetime_cell_quota").alias("lifetime_quota"),
        (F.col("lifetime_cell_quota") - F.col("total_cells")).alias("remaining_lifetime_quota"),
        "quota_increased",
    )


def admitted(requests: DataFrame, left: DataFrame) -> DataFrame:
    """Requests (user_id, cell_count) with whether they fit; as many as are left is allowed."""
    return requests.join(left, "user_id").withColumn("admitted", F.col("cell_count") <= F.col("remaining"))


def admitted_in_order(requests: DataFrame, left: DataFrame, *, order: Sequence[str], cells: str = "cell_count") -> DataFrame:
    """Requests with `remaining` (what the user had before all of them) and `admitted`: whether they fit into what those admitted before them leave.

    left: user_id, remaining, a row a user; requests of other users are left out, as are those without a user. A request of null, NaN or
    fewer than 0 cells is never admitted. Requests that tie in `order` may come either way, so give columns that tell them apart.

    Users whose requests fit together, and requests that are larger than all there was, need no order and stay in their tasks. The others
    are sorted by user and time, a sort that spills, and pass through as a stream: a task holds one number, what the present user has left.
    """
    own = {c.lower() for c in requests.columns} & {"remaining", "admitted"}
    if own:
        raise ValueError(f"requests have columns of the names {sorted(own)}")
    asked = F.col(cells).cast("double")
    fair = F.coalesce((asked >= 0) & ~F.isnan(asked), F.lit(False))
    wanted = requests.groupBy(F.col("user_id").alias("of")).agg(F.sum(F.when(fair, asked)).alias("__wanted"))
    users = left.select(F.col("user_id").alias("of"), "remaining").join(wanted, "of").select(F.col("of").alias("__of"), "remaining", "__wanted")
    met = requests.join(users, F.col("user_id") == F.col("__of")).drop("__of")
    # Sums may differ in their last digits by order; what is that near goes the long way.
    spare = F.col("__wanted") * (1 + 1e-9) <= F.col("remaining")
    alone = fair & (asked <= F.col("remaining"))
    held = staged(met.withColumn("__way", F.when(~F.coalesce(alone, F.lit(False)), 0).when(F.coalesce(spare, F.lit(False)), 1).otherwise(2)).drop("__wanted"), "requests")
    easy = held.filter("__way < 2").withColumn("admitted", F.col("__way") == 1).drop("__way")
    hard = held.filter("__way = 2").drop("__way")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, rest = None, 0.0
        for b in batches:
            out = np.zeros(b.num_rows, bool)
            names, first, sizes = b.column("user_id").to_pylist(), b.column("remaining").to_pylist(), b.column(cells).to_pylist()
            for k, (u, c) in enumerate(zip(names, sizes, strict=True)):
                if u != user:
                    user, rest = u, first[k]
                if c <= rest:
                    rest -= c
                    out[k] = True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "admitted"])

    sorted_ = hard.repartition("user_id").sortWithinPartitions("user_id", *order)
    return easy.unionByName(sorted_.mapInArrow(fold, easy.schema))


def require_quota(requests: DataFrame, left: DataFrame) -> DataFrame:
    got = admitted(requests, left)
    if not got.filter("not admitted").isEmpty():
        raise QuotaExceeded("more cells are asked for than are left")
    return got.drop("admitted", "remaining")


def increased_once(users: DataFrame, who: Column) -> DataFrame:
    """The lifetime quota of the chosen users raised, once."""
    now = who & ~F.col("quota_increased")
    return users.withColumns({"lifetime_cell_quota": F.when(now, F.lit(INCREASED_QUOTA)).otherwise(F.col("lifetime_cell_quota")), "quota_increased": F.col("quota_increased") | now})


def request_status_with_timeout(activity: DataFrame, timeout: Column, now: Column) -> DataFrame:
    """Like request_status(), where a request that has started and not ended within `timeout` has FAILED once `now` is past that time."""
    ended = F.col("event").isin("FAILED", "SUCCEEDED")
    by = activity.filter("request_id is not null").groupBy("request_id").agg(
        F.min(F.when(F.col("event") == "STARTED", F.col("finished_time"))).alias("start"), F.min(F.when(ended, F.col("finished_time"))).alias("end"),
        F.bool_or(F.col("event") == "FAILED").alias("failed"), F.bool_or(F.col("event") == "SUCCEEDED").alias("succeeded"), F.max("cell_count").alias("cell_count"), F.count(F.lit(1)).alias("n_rows"),
    )
    late = F.coalesce(F.col("end"), now) > F.col("start") + timeout
    status = F.when(F.coalesce("failed", F.lit(False)) | F.coalesce(late, F.lit(False)), "FAILED").when(F.col("succeeded"), "SUCCEEDED").otherwise("STARTED")
    return by.select("request_id", status.alias("status"), "cell_count", "n_rows")


def request_status(activity: DataFrame) -> DataFrame:
    """Per request: FAILED if any row failed, else SUCCEEDED if any did, else STARTED; and its cells."""
    return activity.filter("request_id is not null").groupBy("request_id").agg(
        F.when(F.bool_or(F.col("event") == "FAILED"), "FAILED").when(F.bool_or(F.col("event") == "SUCCEEDED"), "SUCCEEDED").otherwise("STARTED").alias("status"),
        F.max("cell_count").alias("cell_count"),
        F.count(F.lit(1)).alias("n_rows"),
    )
