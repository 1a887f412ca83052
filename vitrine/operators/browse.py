"""Catalogue pages and grouped search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalar import is_pubkey
from vitrine.operators.predicates import contains_literal, enabled_gate, filtered, keyset_after, population

# What a missing sort key counts as.
LAST_NUMBER = 2147483647
NO_ACTIVITY = -1

CARD = ["collection_id", "id", "address", "name", "number", "image_uri", "image_status", "burned", "owner",
        "last_activity_at", "rarity_score", "rarity_rank"]


@dataclass(frozen=True)
class Sort:
    key: Column
    descending: bool = False


def sort_of(name: str) -> Sort:
    """``number``, ``name``, ``activity`` or ``rarity``; a leading ``-`` reverses."""
    keys = {
        "number": lambda: F.coalesce("number", F.lit(LAST_NUMBER)),
        "name": lambda: F.col("name"),
        "activity": lambda: F.coalesce("last_activity_slot", F.lit(NO_ACTIVITY)),
        "rarity": lambda: F.coalesce("rarity_rank", F.lit(LAST_NUMBER)),
    }
    bare = name.removeprefix("-")
    if bare not in keys:
        raise ValueError(f"unknown sort: {name}")
    return Sort(keys[bare](), name.startswith("-"))


def browse_page(assets: DataFrame, attributes: DataFrame, collection_id: int, sort: str = "number",
                selections: dict[str, list[str]] | None = None, q: str | None = None,
                after: tuple | None = None, limit: int = 24) -> DataFrame:
    """One keyset page of cards; ask for one more than is shown to learn of a next page."""
    by = sort_of(sort)
    rows = filtered(assets, attributes, selections, q, collection_id).withColumn("sort_key", by.key)
    key, tie = F.col("sort_key"), F.col("id")
    if after is not None:
        rows = rows.where(keyset_after(key, tie, *after, descending=by.descending))
    order = [key.desc(), tie.desc()] if by.descending else [key, tie]
    return rows.orderBy(*order).limit(limit).select(*[c for c in CARD if c in rows.columns], "sort_key")


def search_interpret(inputs: DataFrame, column: str = "q") -> DataFrame:
    """What each search input is: an address, a token number, or text."""
    q = F.col(column)
    digits = F.regexp_extract(q, "^#?([0-9]{1,9})$", 1)
    kind = F.when(is_pubkey(q), "address").when(digits != "", "number").otherwise("text")
    number = F.when(~is_pubkey(q), F.nullif(digits, F.lit("")).try_cast("int"))
    return inputs.withColumn("interpreted_as", kind).withColumn("number", number)


def _hits(collections: DataFrame, assets: DataFrame, number: int | None, text: str | None,
          collection_id: int | None) -> DataFrame:
    hits = enabled_gate(population(assets), collections)
    hits = hits.where(F.col("number") == number) if number is not None else hits.where(contains_literal("name", text))
    return hits if collection_id is None else hits.where(F.col("collection_id") == collection_id)


def search_grouped(collections: DataFrame, assets: DataFrame, *, number: int | None = None, text: str | None = None,
                   collection_id: int | None = None, per_group: int = 10) -> DataFrame:
    """Per collection the exact number of hits and its first ``per_group`` cards.

    The count is a separate aggregate: next to it in one window, Spark could not cut each
    group to its first rows before the shuffle."""
    hits = _hits(collections, assets, number, text, collection_id)
    first = Window.partitionBy("collection_id").orderBy(F.coalesce("number", F.lit(LAST_NUMBER)), "id")
    top = hits.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= per_group)
    totals = hits.groupBy("collection_id").agg(F.count(F.lit(1)).alias("total"))
    return top.join(totals, "collection_id")


def search_route(inputs: DataFrame, collections: DataFrame, assets: DataFrame) -> DataFrame:
    """Where each input leads: an exact asset, else a wallet that holds something, else an
    exact slug of an enabled collection. ``inputs``: (q); answered for all inputs in one job."""
    asked = search_interpret(inputs.select("q").distinct())
    enabled = collections.where("enabled")
    asset = assets.select(F.col("address").alias("q"), F.lit(True).alias("is_asset"))
    held = enabled_gate(population(assets), collections).where(F.col("owner").isNotNull()).groupBy(
        F.col("owner").alias("q")).agg(F.count(F.lit(1)).alias("held"))
    slug = enabled.select(F.col("slug").alias("q"), F.lit(True).alias("is_slug"))
    address, text = F.col("interpreted_as") == "address", F.col("interpreted_as") == "text"
    route = (F.when(address & F.col("is_asset"), "nft").when(address & F.col("held").isNotNull(), "wallet")
             .when(text & F.col("is_slug"), "collection"))
    return asked.join(asset, "q", "left").join(held, "q", "left").join(slug, "q", "left").select(
        "q", "interpreted_as", route.alias("route"),
        F.when(route == "wallet", F.col("held")).alias("wallet_total"))


def search_groups(collections: DataFrame, assets: DataFrame, **match) -> DataFrame:
    """Groups of a search, most hits first, each with its cards as one JSON list."""
    hits = search_grouped(collections, assets, **match)
    cards = F.array_sort(F.collect_list(F.struct("rn", "address", "name")))
    groups = hits.groupBy("collection_id", "total").agg(cards.alias("cards"))
    slugs = collections.select(F.col("id").alias("collection_id"), "slug")
    return groups.join(slugs, "collection_id").select("slug", "total", F.to_json(F.transform(
        "cards", lambda c: F.struct(c["address"].alias("address"), c["name"].alias("name")))).alias("nfts")
    ).orderBy(F.desc("total"), "slug")
