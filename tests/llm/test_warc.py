"""WARC parsing and revisit resolution on hand-written and random records."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from vitrine.llm import warc


def raw(kind, record_id, url, at, headers, status=200, body=b"", profile=warc.PROFILE, digest="md5:x"):
    http = f"HTTP/1.1 {status} X\r\n".encode() + "".join(f"{n}: {v}\r\n" for n, v in headers).encode() + b"\r\n" + body
    date = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    extra = f"WARC-Profile: {profile}\r\n" if kind == "revisit" else ""
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nwarc-target-uri: {url}\r\nWARC-Date: {date}\r\n{extra}"
            f"WARC-Payload-Digest: {digest}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n").encode() + http + b"\r\n\r\n"


def test_parse():
    got = warc.parse_record(raw("response", "a", "http://x/", 10, [("ETag", '"1"'), ("X", "a: b"), ("Set-Cookie", "1"), ("set-cookie", "2")], body=b"\r\n\r\nbody"))
    assert (got["type"], got["record_id"], got["at"], got["status"], got["payload_length"]) == ("response", "a", 10, 200, 8)
    assert got["headers"] == [{"name": "etag", "value": '"1"'}, {"name": "x", "value": "a: b"}, {"name": "set-cookie", "value": "1"}, {"name": "set-cookie", "value": "2"}]
    for bad in (None, b"", b"x", b"WARC/1.1\r\n\r\n", raw("response", "a", "u", 1, [])[:-30], b"WARC/1.1\r\nContent-Length: -4\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n\r\n"):
        assert warc.parse_record(bad)["type"] == "malformed"


def test_canonical(spark):
    pairs = [("HTTP://WWW.Ex.org:80", "http://ex.org/"), ("https://u@ex.org:443/A?b=2&a=1&utm_source=q#f", "https://ex.org/A?a=1&b=2"),
             ("http://ex.org:8080/?sid=1", "http://ex.org:8080/"), (" mailto:x ", "mailto:x"), ("", ""), (None, None), ("http://ex.org?x", "http://ex.org/?x")]
    got = spark.createDataFrame(pairs, "u string, w string").select("w", warc.canonical_url(F.col("u"))).collect()
    assert [r[1] for r in got] == [r[0] for r in got]


def test_cases(spark):
    records = [
        raw("response", "r1", "http://a.org/", 10, [("ETag", '"1"'), ("Content-Type", "text/html"), ("Cache-Control", "no-cache"), ("Content-Length", "3")], body=b"one"),
        raw("response", "r2", "http://a.org/", 20, [("ETag", '"2"'), ("Last-Modified", "then")], body=b"two"),
        raw("response", "r3", "http://a.org/", 30, [("ETag", '"9"')], status=404),
        raw("revisit", "v1", "HTTP://A.ORG:80/#x", 15, [("ETag", 'W/"1"'), ("Cache-Control", "max-age=1"), ("Content-Length", "0"), ("Age", "4")], status=304),
        raw("revisit", "v2", "http://a.org", 40, [("ETag", '"1"')], status=304),
        raw("revisit", "v3", "http://a.org", 40, [("Last-Modified", "then")], status=304),
        raw("revisit", "v4", "http://a.org", 40, [], status=304), raw("revisit", "v5", "http://a.org", 10, [("ETag", '"1"')], status=304),
        raw("revisit", "v6", "http://b.org", 40, [("ETag", '"1"')], status=304), raw("revisit", "v7", "http://a.org", 40, [], profile="other"),
        b"nothing", None]
    df = spark.createDataFrame([(r, 5, "x") for r in [*records, records[3]]], "record binary, at int, url string").repartition(3)
    found = warc.resolve_revisits(warc.parse_warc(df)).collect()
    got = {r.record_id: (r.outcome, r.original_id) for r in found}
    assert got == {"v1": ("resolved", "r1"), "v2": ("mismatch", "r2"), "v3": ("resolved", "r2"), "v4": ("unverified", "r2"), "v5": ("no original", None),
                   "v6": ("no original", None)}
    assert len(found) == 7
    one = next(r for r in found if r.record_id == "v1")
    assert sorted(map(tuple, one.headers)) == [("age", "4"), ("cache-control", "max-age=1"), ("content-length", "3"), ("content-type", "text/html"), ("etag", '"1"')]
    assert (one.status, one.payload_length) == (200, 3)
    assert next(r for r in found if r.record_id == "v2").headers is None
    assert warc.resolve_revisits(warc.parse_warc(df.limit(0))).count() == 0


def test_hot_url(spark):
    """One URL with most records, with and without the blocked scan, against a plain walk."""
    rnd = random.Random(1)
    captures = []
    for i in range(400):
        url, at, full = ("http://hot.org/" if rnd.random() < 0.7 else f"http://c{rnd.randrange(9)}.org/"), rnd.randrange(150), rnd.random() < 0.4
        captures.append((f"i{i:03}", url, at, full, str(rnd.randrange(3))))
    want = set()
    for name, url, at, full, tag in captures:
        if not full:
            best = max(((a, n, t) for n, u, a, f, t in captures if f and u == url and a < at), default=None)
            want.add((name, "no original" if best is None else "resolved" if best[2] == tag else "mismatch", best and best[1]))
    df = spark.createDataFrame([(raw("response" if f else "revisit", n, u, a, [("ETag", t)]),) for n, u, a, f, t in captures], "record binary").repartition(5)
    for limit in ("2000000", "20"):
        spark.conf.set("vitrine.scan.hotRows", limit)
        try:
            got = {(r.record_id, r.outcome, r.original_id) for r in warc.resolve_revisits(warc.parse_warc(df)).collect()}
        finally:
            spark.conf.unset("vitrine.scan.hotRows")
        assert got == want
