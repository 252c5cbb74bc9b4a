"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import VersionError

MIN_CLIENT_VERSION = "1.8.0"
LEAST_PARTITIONS, MOST_PARTITIONS = 4096, 65_536


def shortened(c: Column, most: int = 20) -> Column:
    """Null as the empty text; more than `most` characters as the first of them and three periods."""
    return F.when(c.isNull(), F.lit("")).when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def partition_count(n: Column, most: int = MOST_PARTITIONS) -> Column:
    """The power of two nearest to n / 1000 between 4096 and `most`, upwards on a tie. Never under 4096, and over `most` if that is no power."""
    target = F.greatest(F.lit(LEAST_PARTITIONS), F.least(F.lit(most), F.floor(n / 1000))).cast("double")
    above = F.pow(F.lit(2.0), F.ceil(F.log2(target)))
    return F.when(above - target <= target - above / 2, above).otherwise(above / 2).cast("long")


def partition_number(n: int, most: int = MOST_PARTITIONS) -> int:
    target = max(LEAST_PARTITIONS, min(most, n // 1000))
    above = 1 << (target - 1).bit_length()
    return above if above - target <= target - above // 2 else above // 2


VERSION = r"^\s*v?(\d+(?:\.\d+)*)((?:a|b|rc|\.dev)\d+)?(\.post\d+)?\s*$"


def version_at_least(version: Column, least: str = MIN_CLIENT_VERSION) -> Column:
    """Whether a release is `least` or later; pre-releases come before their release, and what is no version gives null."""
    of = F.transform(F.split(F.regexp_extract(version, VERSION, 1), r"\."), lambda x: x.try_cast("int"))
    want = [int(x) for x in least.split(".")]
    at = lambda i: F.coalesce(F.get(of, F.lit(i)), F.lit(0))
    later, same = F.lit(False), F.lit(True)
    for i in range(max(4, len(want))):
        w = want[i] if i < len(want) else 0
        later, same = later | (same & (at(i) > w)), same & (at(i) == w)
    ok = later | (same & (F.regexp_extract(version, VERSION, 2) == ""))
    return F.when(version.rlike(VERSION), ok)


def check_version(spark, version: str, least: str = MIN_CLIENT_VERSION) -> bool:
    got = spark.range(1).select(version_at_least(F.lit(version), least).alias("ok")).first().ok
    if got is None:
        raise VersionError(f"{version!r} is no version")
    return got


TRACE = r"^([a-f0-9]+)/([a-f0-9]+)(;o=(.*))?$"


def trace_id(header: Column) -> Column:
    """The first part of trace/span;o=options; null when the header has another form."""
    return F.when(header.rlike(TRACE), F.regexp_extract(header, TRACE, 1))


def span_id(header: Column) -> Column:
    return F.when(header.rlike(TRACE), F.regexp_extract(header, TRACE, 2))


def unique_suffix(name: Column) -> Column:
    """A name with 8 hex digits of a random uuid."""
    return F.concat(name, F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def in_week_of(today: Column, created: Column) -> Column:
    """The last day up to today whose weekday is that of sign-up, at midnight."""
    return F.date_add(today.cast("date"), -F.pmod(F.weekday(today) - F.weekday(created), F.lit(7))).cast("timestamp_ntz")
