"""Rows as they are served: one JSON object a row, camelCase, every key present, ids and lamports as decimal strings, times in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.predicates import kind_filter
from vitrine.operators.skew import lookup_join
from vitrine.operators.stats import collections_overview, wallet_page

WITH_NULLS = {"ignoreNullFields": "false"}


def _time(c: str | Column) -> Column:
    """Times are stored as wall time in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _camel(**columns: str | Column) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]


def _json(fields: list[Column]) -> Column:
    return F.to_json(F.struct(*fields), WITH_NULLS)


def _card() -> list[Column]:
    return _camel(address="address", name="name", number="number", imageUri="image_uri", imageStatus="image_status", burned="burned", owner="owner",
                  lastActivityAt=_time("last_activity_at"), rarityRank="rarity_rank", rarityScore="rarity_score",
                  collection=F.struct(F.col("_slug").alias("slug"), F.col("_collection").alias("name")))


def _named(assets: DataFrame, collections: DataFrame) -> DataFrame:
    """Assets of enabled collections with what a card says about theirs."""
    c = collections.where("enabled").select(F.col("id").alias("collection_id"), F.col("slug").alias("_slug"), F.col("name").alias("_collection"))
    return assets.join(c, "collection_id")


def cards(assets: DataFrame, collections: DataFrame) -> DataFrame:
    """A card for each asset of an enabled collection. ``assets`` has its rank and score, NULL before the first pass."""
    return _named(assets, collections).select("id", "collection_id", _json(_card()).alias("json"))


def wallet_cards(collections: DataFrame, assets: DataFrame, wallet: str | Column, **page) -> DataFrame:
    """One page of the cards that a wallet holds, by collection and id; ``page`` as for ``wallet_page``."""
    shown = wallet_page(collections, assets, wallet, **page).select("id")
    return cards(assets.join(shown, "id", "left_semi"), collections).orderBy("collection_id", "id")


def _event() -> list[Column]:
    return _camel(id=F.col("id").cast("string"), kind="kind", signature="signature", seq="seq", slot="slot", blockTime=_time("block_time"),
                  fromOwner="from_owner", toOwner="to_owner", priceLamports=F.col("price_lamports").cast("string"), marketplace="marketplace")


def events(activity: DataFrame) -> DataFrame:
    """Timeline entries of the public kinds."""
    return kind_filter(activity).select("id", "asset_id", _json(_event()).alias("json"))


def feed(activity: DataFrame, assets: DataFrame, collections: DataFrame) -> DataFrame:
    """Entries of the collection feeds: an event next to the card it happened to. An asset with very many events is spread."""
    card = _named(assets, collections).select(F.col("id").alias("asset_id"), F.struct(*_card()).alias("_nft"))
    happened = lookup_join(kind_filter(activity), card, ["asset_id"], spread="id", how="inner")
    return happened.select("id", "collection_id", _json([*_event(), F.col("_nft").alias("nft")]).alias("json"))


def intervals(signed: DataFrame) -> DataFrame:
    """Ownership intervals with the signatures that opened and closed them, as ``interval_rebuild`` or ``owners_signatures_join`` give them."""
    shape = _camel(owner="owner", fromSlot="from_slot", fromTs=_time("from_ts"), toSlot="to_slot", toTs=_time("to_ts"), isCurrent=F.col("to_slot").isNull(),
                   openedBySignature="opened_by_signature", closedBySignature="closed_by_signature")
    return signed.select("asset_id", "opened_by", _json(shape).alias("json"))


def collection_shapes(collections: DataFrame, assets: DataFrame, activity: DataFrame, as_of: str) -> DataFrame:
    """Enabled collections with their statistics as of a time."""
    held = F.from_json("holder_buckets", "array<struct<label string, holders bigint, assets bigint>>")
    stats = F.struct(*_camel(supply="supply", holders="holders", burned="burned", indexed="indexed", activity24h="activity_24h", activity7d="activity_7d",
                             lastActivityAt=_time("last_activity_at"), holderDistribution=held, asOf=_time(F.lit(as_of).cast("timestamp_ntz"))))
    counted = collections_overview(collections, assets, activity, as_of).select(F.col("collection_id").alias("id"), stats.alias("_stats"))
    shape = _camel(slug="slug", name="name", standard="standard", membershipRule="membership_rule", address="address", symbol="symbol", stats="_stats")
    return collections.where("enabled").join(counted, "id").select("id", _json(shape).alias("json"))
