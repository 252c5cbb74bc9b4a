"""WARC: an exact round trip through both kinds of archive."""

import base64
import glob
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vicinal.llm import warc as W

PAGES = [
    (1, "http://a.com/", "<p>one</p>"), (2, "http://b.com/", "<p>one</p>"), (9, "http://c.com/", "<p>one</p>"), (3, None, None), (4, "http://d.com/\r\nX: y", ""), (5, "http://e.com/", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (6, "http://f.com/", "é漢😀\x00\n\r"), (7, "http://g.com/", "x" * 3_000_000), (9, "http://c.com/", "<p>one</p>"), (None, "http://h.com/", "<p>one</p>"), (None, None, "only null"), (None, None, "only null"), (-8, "u", "minus"), (11, "v", "minus"),
]


def expected(least=0):
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "")]
        keeper = max((j for j in same if j is not None), default=None)
        revisit = len(same) > 1 and len(data) >= least and keeper is not None and i != keeper
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, id int").repartition(3)


def written(spark, pages, at, **options):
    W.write_monolithic(pages, f"{at}/whole", **options)
    W.normalise(spark, f"{at}/whole", f"{at}/records")
    return W.build_index(spark, f"{at}/records", f"{at}/index")


@pytest.mark.parametrize("options", [{}, {"least": 12}, {"broadcast_groups": 0}])
def test_round_trip(spark, pages, tmp_path, options):
    index = written(spark, pages, tmp_path, **options)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()), key=str) == expected(options.get("least", 0))


def test_archives_and_index(spark, pages, tmp_path):
    index = written(spark, pages, tmp_path)
    for f in glob.glob(f"{tmp_path}/whole/*.gz"):
        d = zlib.decompressobj(31)
        d.decompress(open(f, "rb").read())
        assert d.eof and not d.unused_data  # one stream
    whole = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/whole/*.gz")))
    records = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/records/part-*")))
    assert sorted(W.records(iter([whole]))) == sorted(W.records(iter([records])))
    for r in index.collect():
        data = open(r.file.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        d = zlib.decompressobj(31)
        record = d.decompress(data)
        assert d.eof and not d.unused_data and W.page_of(W.header_of(record)[0]["warc-record-id"]) == r.page_id
    some = index.filter("page_id in (6, 7)")
    got = {len(r.record) for r in W.read_records(spark, f"{tmp_path}/records", some).collect()}
    assert len(got) == 2 and max(got) > 3_000_000


def test_records_come_out_whole_in_any_pieces():
    one = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhe\r\nl\r\n\r\n"
    for n in range(1, 30):
        data = one * 4
        assert [*W.records(data[i : i + n] for i in range(0, len(data), n))] == [one] * 4
    with pytest.raises(ValueError, match="inside a record"):
        [*W.records(iter([one[:-1]]))]


def test_damage_is_found(spark, pages, tmp_path):
    written(spark, pages, tmp_path)
    record = next(W.records(iter([gzip.open(next(f for f in glob.glob(f"{tmp_path}/records/part-*") if gzip.open(f).read())).read()])))
    with pytest.raises(ValueError, match="payload"):
        W.described(record[:-5] + bytes([record[-5] ^ 1]) + record[-4:]) if b"response" in record[:40] else W.described(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Payload-Digest: sha1:Q\r\nContent-Length: 4\r\n\r\nH\r\n\r\n\r\n\r\n")


def test_native_digest(pages):
    for r in pages.select("html", W.base32_sha1(F.coalesce("html", F.lit(""))).alias("d")).collect():
        assert r.d == base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode()


def test_empty_table(spark, pages, tmp_path):
    assert written(spark, pages.limit(0), tmp_path).count() == 0
