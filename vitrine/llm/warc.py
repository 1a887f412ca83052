"""WARC records: writing, parsing, and resolution of not-modified revisits.

A revisit says that the server answered 304: the page is as it was. It is resolved by an as-of join: the latest
earlier full response of the same canonical URL, whichever spelling either used. Its validators must agree with the
revisit's. The answer then has the stored headers, replaced where the 304 may replace them.

The join is one ordered scan over responses and revisits of a URL, which stays parallel when one URL holds a large
part of all records. Payloads stay where they are; only headers go through it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordered import last_before, scan
from vitrine.session import write_table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
# header fields of a stored response that a 304 doesn't replace: they tell of the stored body or of one connection
FIXED = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
         "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
TRACKING = r"^(utm_[a-z]+|sid|sessionid|phpsessid|jsessionid)(=|$)"
HEADERS = "array<struct<name:string,value:string>>"
PARSED = (f"record_id string, type string, url string, at long, profile string, status int, headers {HEADERS}, "
          "payload_digest string, payload_length long")


def warc_record(kind: Column, record_id: Column, url: Column, at: Column, digest: Column, http: Column) -> Column:
    """One WARC/1.1 record as binary. ``at`` is in seconds, ``http`` the whole HTTP answer; a revisit is given its profile."""
    date = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    profile = F.when(kind == "revisit", F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: "), date, F.lit("\r\n"), profile, F.lit("WARC-Payload-Digest: "), digest,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"),
        F.lit("\r\n\r\n"), http, F.lit("\r\n\r\n")).cast("binary")


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Named fields of a header block after its first line; a line that starts with white space goes on."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse_record(raw: bytes | None) -> dict:
    """Fields of one record; ``type`` is "malformed" where it can't be read as a record."""
    empty = dict.fromkeys(("record_id", "type", "url", "at", "profile", "status", "headers", "payload_digest", "payload_length"))
    head, split, rest = (raw or b"").partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not split:
        return empty | {"type": "malformed"}
    warc = {n.lower(): v for n, v in _fields(head)}
    try:
        length = int(warc.get("content-length", ""))
        date = datetime.fromisoformat(warc["warc-date"])
        at = int(date.replace(tzinfo=date.tzinfo or timezone.utc).timestamp())
    except (KeyError, ValueError, OverflowError):
        return empty | {"type": "malformed"}
    if not 0 <= length <= len(rest):
        return empty | {"type": "malformed"}
    out = empty | {"record_id": warc.get("warc-record-id", "").strip("<>") or None, "type": warc.get("warc-type"), "at": at,
                   "url": warc.get("warc-target-uri"), "profile": warc.get("warc-profile"), "payload_digest": warc.get("warc-payload-digest")}
    if "application/http" in warc.get("content-type", ""):
        http, _, _ = rest[:length].partition(b"\r\n\r\n")
        words = http.split(b"\r\n", 1)[0].split()
        out["status"] = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) == 3 else None
        out["headers"] = [{"name": n.lower(), "value": v} for n, v in _fields(http)]
        out["payload_length"] = max(0, length - len(http) - 4)
    return out


def parse_warc(records: DataFrame, record_col: str = "record") -> DataFrame:
    """One row per row of ``records``, a WARC record in binary each. Unreadable and NULL records give the type "malformed"."""
    row = pa.struct([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("at", pa.int64()), ("profile", pa.string()),
                     ("status", pa.int32()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
                     ("payload_digest", pa.string()), ("payload_length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                parsed = [parse_record(x.as_py()) for x in b.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_struct_array(pa.array(parsed, row))

    return records.select(F.col(record_col).cast("binary").alias("record")).mapInArrow(run, PARSED)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without user, leading www., default port and fragment; "/" for no path; parameters
    sorted, those that only track a visit left out. What has no scheme and host is only trimmed."""
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(F.trim(url), whole, i)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"^.*@", ""), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    query = F.array_join(F.array_sort(F.filter(F.split(part(4), "&"), lambda q: (q != "") & ~F.rlike(F.lower(q), F.lit(TRACKING)))), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(part(3) == "", F.lit("/")).otherwise(part(3)), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(1) == "", F.trim(url)).otherwise(made)


def _header(headers: Column, name: str) -> Column:
    """The first value of a header field, or NULL."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit of ``records`` (the columns of parse_warc): record_id, canonical url, at, outcome,
    original_id, status, headers, payload_digest, payload_length.

    ``outcome``: "resolved"; "no original", without an earlier full response (status 200) of the URL; "mismatch", where the
    revisit's ETag (weak comparison), or without one its Last-Modified, isn't the original's; "unverified", where the
    revisit has neither: resolved, but on the URL alone. A mismatch keeps the original's id, but not its headers.
    Responses of the same second as a revisit aren't earlier; of responses of one second the largest record_id, then
    digest, counts as the latest. A revisit without URL or date has no original. Repeated rows each stay; records of
    other types, other profiles and malformed ones give no row. Extra columns are left out."""
    full = (F.col("type") == "response") & (F.col("status") == 200)
    revisit = (F.col("type") == "revisit") & (F.col("profile") == PROFILE)
    kept = records.where((full & F.col("url").isNotNull() & F.col("at").isNotNull()) | revisit)
    kept = write_table(kept.select(
        F.coalesce("record_id", F.lit("")).alias("record_id"), canonical_url(F.col("url")).alias("url"), "at", "headers",
        F.coalesce("payload_digest", F.lit("")).alias("payload_digest"), "payload_length", "status", full.alias("full"),
        # a total order within a URL: revisits before responses of their second, repeated rows apart
        full.cast("int").alias("kind"), F.monotonically_increasing_id().alias("row")), "captures")
    placed = kept.where(F.col("url").isNotNull() & F.col("at").isNotNull())
    stored = F.when(F.col("full"), F.struct("record_id", "headers", "status", "payload_digest", "payload_length"))
    ahead = scan(placed, ["url"], ["at", "kind", "record_id", "payload_digest", "row"], {"original": last_before(stored)})
    ahead = ahead.where(~F.col("full"))
    lost = kept.where(~F.col("full") & (F.col("url").isNull() | F.col("at").isNull()))
    rows = ahead.unionByName(lost, allowMissingColumns=True)
    etag, tag = _header(F.col("headers"), "etag"), _header(F.col("original.headers"), "etag")
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    changed, change = _header(F.col("headers"), "last-modified"), _header(F.col("original.headers"), "last-modified")
    agree = F.when(etag.isNotNull(), F.coalesce(strong(etag) == strong(tag), F.lit(False))).otherwise(F.coalesce(changed == change, F.lit(False)))
    outcome = (F.when(F.col("original").isNull(), "no original").when(etag.isNull() & changed.isNull(), "unverified")
               .when(agree, "resolved").otherwise("mismatch"))
    new = F.filter(F.coalesce("headers", F.array().cast(HEADERS)), lambda h: ~h["name"].isin(*FIXED))
    old = F.filter(F.coalesce("original.headers", F.array().cast(HEADERS)), lambda h: ~F.array_contains(F.transform(new, lambda x: x["name"]), h["name"]))
    good = F.col("outcome").isin("resolved", "unverified")
    return rows.withColumn("outcome", outcome).select(
        "record_id", "url", "at", "outcome", F.col("original.record_id").alias("original_id"), F.when(good, F.col("original.status")).alias("status"),
        F.when(good, F.concat(old, new)).alias("headers"), F.when(good, F.col("original.payload_digest")).alias("payload_digest"),
        F.when(good, F.col("original.payload_length")).alias("payload_length"))
