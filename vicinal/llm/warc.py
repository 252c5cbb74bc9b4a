r"""WARC: monolithic gzip archives, and their normaliser.

write_monolithic() writes a record for each page with Spark's text writer, whose line end is the blank line that ends a record
and whose codec makes each file one gzip stream. normalise() inflates such a stream once, cuts records by their Content-Length and
writes each as a gzip member of its own. build_index() walks the members and writes the sidecar index: file, offset, length and what
the record says. read_records() fetches single records by index rows.

The payload is the html as UTF-8 (null: empty). Of pages with equal payloads of at least `least` bytes the one with the largest id
is the response and the others are revisits of it; smaller ones are all responses. Rows that repeat the largest id are responses
too. A null id is smaller than all others, is written as such and comes back null; when all ids of a group are null, all are
responses. A null url has no WARC-Target-URI; line ends inside urls are percent-encoded. An empty table gives no records. Extra
columns are ignored.

Between groups of members stands an empty gzip member (the writer's line end), which readers skip; a file ends with one, as BGZF's do.

Scale: payloads are never shuffled while the ids of shared payloads are few (`broadcast_groups`); beyond it the join is a
shuffle that Spark splits where one payload is large. Equal payloads are pre-aggregated to one digest a task. Files hold
`records_per_file` records at most, and fewer where pages are so large that these would pass FILE_BYTES; a task holds one file's
compressed bytes and one record. Digests of all pages are staged once, and what is staged goes when it has been read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, remove, staged, table

BLANK = "\r\n\r\n"
#: A gzip member without content, as Latin-1.
EMPTY = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 20_000
#: Payload bytes of a file, on average; compressed it is a fraction of that.
FILE_BYTES = 256 << 20
BROADCAST_GROUPS = 100_000
#: Compressed bytes that are inflated at a step, and bytes of members that are written at once.
STEP, AT_ONCE = 1 << 14, 1 << 20
LEVEL = 6


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, each 4 digits to the base 32."""
    digest = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_monolithic(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, broadcast_groups: int = BROADCAST_GROUPS, records_per_file: int = RECORDS_PER_FILE) -> None:
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    known = staged(own.select("id", "digest", "bytes"), "digests")
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    records_per_file = max(1, min(records_per_file, FILE_BYTES * n // max(1, total)))
    shared = known.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("shared_digest"), "keeper")
    shared = staged(shared, "shared")
    discard(known)
    few = shared.count()
    if few:
        on = (F.col("digest") == F.col("shared_digest")) & (F.col("bytes") >= least)
        own = own.join(F.broadcast(shared) if few <= broadcast_groups else shared.hint("merge"), on, "left")
    else:
        own = own.withColumn("keeper", F.lit(None).cast("long"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(BLANK))
    header = F.concat(
        F.when(revisit, F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n")).otherwise(F.lit("WARC/1.1\r\nWARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\r\n")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("keeper")), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Length: "), F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes")),
        F.lit(BLANK), http,
    )
    record = F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    own.select(record.alias("value")).write.option("lineSep", BLANK).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    discard(shared)


def inflated(data: memoryview) -> Iterator[bytes]:
    """The content of gzip members one after another, in pieces."""
    d, at = zlib.decompressobj(31), 0
    while at < len(data):
        fed = data[at : at + (STEP << 4)]
        out = d.decompress(fed)
        at += len(fed) - len(d.unused_data)
        if out:
            yield out
        if d.eof:
            d = zlib.decompressobj(31)


def header_of(record: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int]:
    """The named fields from `at` on, and where the block starts; -1 if the header has not ended."""
    end = record.find(b"\r\n\r\n", at)
    if end < 0:
        return {}, -1
    lines = bytes(record[at:end]).decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, cut by Content-Length, from the content of an archive in pieces."""
    held, at = bytearray(), 0
    need = 0
    for part in parts:
        held += part
        while len(held) - at >= need:
            fields, block = header_of(held, at)
            if block < 0:
                need = len(held) - at + 1
                break
            end = block + int(fields["content-length"]) + 4
            if end > len(held):
                need = end - at
                break
            yield bytes(held[at:end])
            at, need = end, 0
        if at > 1 << 20 or at == len(held):
            del held[:at]
            at = 0
    if len(held) > at:
        raise ValueError("the archive ends inside a record")


def member(record: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """The records of the archives in `source` as members of their own, in as many archives in `target`."""

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                out = bytearray()
                for r in records(inflated(memoryview(data.as_buffer()))):
                    out += member(r)
                    if len(out) >= AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["value"])
                        out.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["value"])

    rows = files(spark, source).select("content").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", EMPTY).option("encoding", "ISO-8859-1").option("compression", "none").text(target)


INDEX = "file string, offset bigint, length bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each member that has content."""
    at = begin = 0
    d, parts = zlib.decompressobj(31), []
    while at < len(data):
        fed = data[at : at + STEP]
        parts.append(d.decompress(fed))
        at += len(fed) - len(d.unused_data)
        if d.eof:
            if content := b"".join(parts):
                yield begin, at - begin, content
            d, parts, begin = zlib.decompressobj(31), [], at
    if begin != len(data):
        raise ValueError("the archive ends inside a member")


def described(record: bytes) -> tuple:
    """What the index says of a record: the payload's size and digest are those of the bytes, where it has them."""
    fields, block = header_of(record)
    http, payload = header_of(record, block)
    if fields["warc-type"] == "response":
        size, digest = len(record) - 4 - payload, base64.b32encode(hashlib.sha1(memoryview(record)[payload:-4]).digest()).decode()
        if f"sha1:{digest}" != fields["warc-payload-digest"]:
            raise ValueError(f"{fields['warc-record-id']} does not have the payload that it names")
    else:
        size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    return page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], page_of(fields.get("warc-refers-to"))


def build_index(spark: SparkSession, archives: str, index: str) -> DataFrame:
    """The sidecar index of normalised archives, written to `index` and read again."""

    def run(batches):
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in INDEX.split(", ")]
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                for offset, length, content in members(memoryview(data.as_buffer())):
                    rows.append((path, offset, length, *described(content)))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path", "content")
    read.mapInArrow(run, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_records(spark: SparkSession, archives: str, wanted: DataFrame) -> DataFrame:
    """file, offset and the record's bytes, for index rows: only their members are inflated."""
    spans = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    got = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).join(spans, F.col("path") == F.col("file")).select("file", "content", F.explode("spans").alias("s"))
    cut = got.select("file", F.col("s.offset").alias("offset"), F.expr("substring(content, cast(s.offset + 1 as int), cast(s.length as int))").alias("record"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.decompress(x, 31) for x in b.column(2).to_pylist()], pa.binary())], names=["file", "offset", "record"])

    return cut.mapInArrow(run, "file string, offset bigint, record binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "warc")
    write_monolithic(table(spark, sf_dir, "pages"), f"{at}/whole")
    normalise(spark, f"{at}/whole", f"{at}/records")
    remove(spark, f"{at}/whole")
    index = build_index(spark, f"{at}/records", f"{at}/index")
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as keeper, count(*) as n from p group by h),
j as (select page_id, strlen(html) as payload_bytes, p.h, case when n > 1 and page_id is distinct from keeper then keeper end as refers_to from p join g using (h))
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, cast(1 + 5 * (j // 4) as bigint), 5) as bigint) >> cast(15 - 5 * (j % 4) as integer)) & 31 as bigint), 1)), '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from j
"""
