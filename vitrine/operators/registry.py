"""The registry of collections, allowlists and tokens: lookups and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import is_pubkey
from vitrine.operators.integrity import broken
from vitrine.operators.ordered import row_number, scan

SLUG_PATTERN = "^[a-z0-9]+(-[a-z0-9]+)*$"


def enabled_in_order(collections: DataFrame) -> DataFrame:
    """Enabled collections with their place in id order."""
    rows = collections.where("enabled").withColumn("_all", F.lit(0))
    return scan(rows, ["_all"], ["id"], {"place": row_number()}).drop("_all")


def by_slug(collections: DataFrame, slug: str) -> DataFrame:
    return collections.where(F.col("slug") == slug)


def allowlist(mints: DataFrame, collection_id: int) -> DataFrame:
    return mints.where(F.col("collection_id") == collection_id).select("mint").orderBy("mint")


def tokens_in_order(tokens: DataFrame) -> DataFrame:
    return tokens.where("enabled").orderBy("created_order", "mint").select("mint", "symbol", "name", "decimals")


def _bad_key(c: str) -> Column:
    return ~is_pubkey(F.col(c))


def _bad_length(c: str, most: int) -> Column:
    return ~F.length(c).between(1, most)


def collection_rules() -> dict[str, Column]:
    """Rules over seed rows joined with ``copies`` (rows sharing the slug) and ``n_mints``."""
    c = F.col
    core, tm = c("standard") == "core", c("standard") == "token_metadata"
    no_standard = c("standard").isNull()
    tm_fields = c("verified_creator").isNotNull() | c("symbol").isNotNull() | c("update_authority").isNotNull() | (
        c("n_mints") > 0)
    no_address, no_creator = c("address").isNull(), c("verified_creator").isNull()
    template = c("metadata_uri_template")
    return {
        "bad_slug": ~c("slug").rlike(SLUG_PATTERN) | (F.length("slug") > 64),
        "duplicate_slug": c("copies") > 1,
        "bad_name": _bad_length("name", 128),
        "bad_address": _bad_key("address"),
        "bad_program": _bad_key("program"),
        "bad_creator": _bad_key("verified_creator"),
        "bad_authority": _bad_key("update_authority"),
        "bad_symbol": _bad_length("symbol", 10),
        "empty_exclude": F.exists("facet_exclude", lambda t: t == ""),
        "bad_template": ~(template.startswith("https://") & F.contains(template, F.lit("{mint}"))),
        "core_with_token_fields": core & tm_fields,
        "core_without_address": core & c("enabled") & no_address,
        "token_with_program": tm & c("program").isNotNull(),
        "token_unresolvable": tm & c("enabled") & no_address & no_creator,
        "allowlist_empty": tm & no_address & ~no_creator & (c("n_mints") == 0),
        "enabled_without_standard": no_standard & c("enabled"),
        "placeholder_with_keys": no_standard & (tm_fields | ~no_address | c("program").isNotNull()),
    }


def dq_registry(seeds: DataFrame, mints: DataFrame, tokens: DataFrame) -> DataFrame:
    """Every broken rule of a registry: (subject, problem), one row each.

    ``mints``: (slug, mint) as listed, repeats included."""
    listed = mints.groupBy("slug").agg(F.count(F.lit(1)).alias("n_mints"))
    copies = seeds.groupBy("slug").agg(F.count(F.lit(1)).alias("copies"))
    rows = seeds.join(listed, "slug", "left").join(copies, "slug").withColumn(
        "n_mints", F.coalesce("n_mints", F.lit(0)))
    collections = rows.select(F.col("slug").alias("subject"), F.explode(broken(collection_rules())).alias("problem"))
    per_mint = mints.groupBy("mint").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("slug").alias("slugs"))
    lists = per_mint.select(F.col("mint").alias("subject"), F.explode(broken({
        "bad_mint": ~is_pubkey(F.col("mint")),
        "listed_twice": F.col("n") > F.col("slugs"),
        "listed_elsewhere": F.col("slugs") > 1,
    })).alias("problem"))
    named = tokens.join(tokens.groupBy("mint").agg(F.count(F.lit(1)).alias("copies")), "mint")
    fungible = named.select(F.col("mint").alias("subject"), F.explode(broken({
        "bad_token_mint": ~is_pubkey(F.col("mint")),
        "duplicate_token": F.col("copies") > 1,
        "bad_token_symbol": _bad_length("symbol", 10),
        "bad_token_name": _bad_length("name", 128),
    })).alias("problem"))
    return collections.unionByName(lists).unionByName(fungible).distinct()
