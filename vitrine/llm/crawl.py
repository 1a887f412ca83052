"""A crawl derived from the given pages: each was fetched once or twice and revisited once or twice.

Every page is first fetched at 60 seconds times its id. It is asked for again one to five days later under another
spelling of its URL; the 304 has the same ETag, a weak one, or a wrong one. Every third page changes on the third day
and is fetched again. Every second page is revisited on the eighth day by Last-Modified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.warc import warc_record

START, DAY = 1577836800, 86400


def crawl(pages: DataFrame) -> DataFrame:
    """(record): WARC records of ``pages`` (page_id, url, html). Pages without id or URL were not fetched."""
    page, url, html = F.col("page_id"), F.col("url"), F.coalesce("html", F.lit(""))
    first = F.lit(START) + page * 60
    authority = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    scheme, rest = F.regexp_extract(url, authority, 1), F.regexp_replace(url, authority, "")
    port = F.when(F.lower(scheme) == "https", ":443").otherwise(":80")
    spelt = F.when(scheme == "", url).otherwise(F.concat(F.upper(scheme), F.lit("://"), F.upper(F.regexp_extract(url, authority, 2)), port, rest, F.lit("#again")))
    tag = lambda version: F.substring(F.md5(F.concat(html, F.lit(version))), 1, 12)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    second = lambda n: n.cast("string")

    def full(nth: int, at: Column, version: str) -> Column:
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: "), quoted(tag(version)), F.lit("\r\nLast-Modified: "),
                        second(at), F.lit("\r\nCache-Control: no-cache\r\nContent-Length: "), F.octet_length(html).cast("string"),
                        F.lit("\r\n\r\n"), html)
        return one("response", nth, url, at, F.concat(F.lit("md5:"), tag(version)), http)

    def again(nth: int, address: Column, at: Column, validator: Column) -> Column:
        http = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\n"), validator, F.lit("\r\nCache-Control: max-age="), (page % 1000).cast("string"),
                        F.lit("\r\nContent-Length: 0\r\nAge: "), F.lit(str(nth)), F.lit("\r\n\r\n"))
        return one("revisit", nth, address, at, F.lit("md5:"), http)

    def one(kind: str, nth: int, address: Column, at: Column, digest: Column, http: Column) -> Column:
        name = F.concat(F.lit("urn:page:"), page.cast("string"), F.lit(f":{nth}"))
        return warc_record(F.lit(kind), name, address, at, digest, http)

    etag = F.concat(F.lit("ETag: "), F.when(page % 4 == 0, F.lit('"0"')).when(page % 4 == 1, F.concat(F.lit("W/"), quoted(tag("")))).otherwise(quoted(tag(""))))
    changed = F.concat(F.lit("Last-Modified: "), second(F.when(page % 6 == 0, first + 3 * DAY).otherwise(first)))
    records = F.array_compact(F.array(
        full(0, first, ""), again(1, spelt, first + (1 + page % 5) * DAY, etag),
        F.when(page % 3 == 0, full(2, first + 3 * DAY, "2")), F.when(page % 2 == 0, again(3, url, first + 8 * DAY, changed))))
    return pages.where(page.isNotNull() & url.isNotNull()).select(F.explode(records).alias("record"))
