"""URL filters against a loop over all rules."""

import re

from vicinal.llm import urls as U

RULES = [*U.RULES, ("a.org", "/", "block"), ("org", "/xyz", "allow"), ("t.de", "/p", "allow"), ("t.de", "/p", "block"), (None, "/", "block"), ("UP.com", "/Q", "block")]
URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/7", "http://x.example.com/en/770?q", "https://example.com/en/8#t", "http://notexample.com/en/7", "http://com/en/", "http://a.com/EN/", "ftp://b.net/de/8", "ftp://example.net/de/81", "ftp://www.example.net/de/9",
    "http://z.org/es/x", "http://a.org", "http://a.org/", "http://b.a.org/xyz", "http://t.de/p/1", "http://up.com/Q", "http://up.com/q", "x://y://z.org/es/", "http://h.com/" + "en/" * 20000, "http://" + "s." * 2000 + "com/en/", "http://a.com\n/en/", "http://u@example.com:80/en/7", "http://.com/en/", "http://a.com?/en/",
]


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    own = re.match(r"[^/?#]*", rest)[0]
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), own), re.match(r"[^?#]*", rest[len(own) :])[0]
    fits = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def frame(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[5], "x"), (None, None, "x"), (3, URLS[3], "x"), (3, "http://a.org/", "x")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, host string").repartition(3)


def check(got, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(([r.page_id, r.host, r.path, r.rule, r.verdict] for r in got), key=key) == sorted(([i, *brute(u)] for i, u, _ in rows), key=key)


def test_equals_brute_force(spark):
    rows, df = frame(spark)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    check(U.judge_urls(df, rules).collect(), rows)
    check(U.judge_urls(df, rules, broadcast_rules=0).collect(), rows)


def test_empty_tables(spark):
    rows, df = frame(spark)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert U.judge_urls(df.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in U.judge_urls(df, rules.limit(0), default="block").collect()} == {(None, "block")}
