"""Column functions: key shapes, token numbers, membership rules, image and URI choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base58 alphabet and the accepted text lengths of keys and signatures.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
PUBKEY_PATTERN = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
SIGNATURE_PATTERN = "^[1-9A-HJ-NP-Za-km-z]{86,88}$"
NUMBER_PATTERN = r"#\s*(\d{1,9})(?!\d)"
# Event kinds shown to the public, and all that may be stored.
PUBLIC_KINDS = ("mint", "transfer", "sale", "burn")


def is_pubkey(c: Column) -> Column:
    return c.rlike(PUBKEY_PATTERN)


def is_signature(c: Column) -> Column:
    return c.rlike(SIGNATURE_PATTERN)


def token_number(name: Column) -> Column:
    """First ``#`` followed by one to nine digits, as an integer."""
    return F.regexp_extract(name, NUMBER_PATTERN, 1).try_cast("int")


def membership_rule(standard: Column, address: Column, creator: Column) -> Column:
    return (
        F.when((standard == "core") & address.isNotNull(), F.lit("core_collection"))
        .when((standard == "token_metadata") & address.isNotNull(), F.lit("tm_collection"))
        .when((standard == "token_metadata") & creator.isNotNull(), F.lit("tm_allowlist"))
    )


def metadata_source_uri(template: Column, address: Column, uri: Column) -> Column:
    """The collection's template with the asset's address filled in, else the chain's URI."""
    return F.coalesce(F.replace(template, F.lit("{mint}"), address), uri)


def observed_owner(owner: Column, burnt: Column) -> Column:
    """Owner a snapshot states: empty text is unknown, a burnt asset has none."""
    return F.when(~F.coalesce(burnt, F.lit(False)), F.nullif(owner, F.lit("")))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def asset_image(content: Column) -> Column:
    """Linked image, else the first file with an image type or none stated."""
    usable = F.filter(content["files"], lambda f: (
        (f["mime"].isNull() | f["mime"].startswith("image/")) & _filled(f["uri"]).isNotNull()))
    return F.coalesce(_filled(content["links"]["image"]), F.try_element_at(usable, F.lit(1))["uri"])


def document_image(doc: Column) -> Column:
    usable = F.filter(doc["properties"]["files"], lambda f: _filled(f["uri"]).isNotNull())
    return F.coalesce(_filled(doc["image"]), F.try_element_at(usable, F.lit(1))["uri"])


def url_safe_base64(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/", "-_"), F.lit("="))
