"""Event and ownership timelines, work queues, and the detail view of one asset or all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.scalar import PUBLIC_KINDS
from vitrine.operators.predicates import enabled_gate, keyset_after, kind_filter, population

EVENT = ["id", "asset_id", "kind", "signature", "seq", "slot", "block_time", "from_owner", "to_owner",
         "price_lamports", "marketplace"]
REF = ["id", "address", "collection_id", "owner", "owner_slot", "burned", "last_activity_slot"]


def newest(rows: DataFrame, key: str, tie: str, after: tuple | None, limit: int) -> DataFrame:
    """One keyset page, newest first."""
    if after is not None:
        rows = rows.where(keyset_after(F.col(key), F.col(tie), *after, descending=True))
    return rows.orderBy(F.desc(key), F.desc(tie)).limit(limit)


def asset_timeline(activity: DataFrame, asset_id: int, kinds: list[str] | None = None,
                   after: tuple | None = None, limit: int = 24) -> DataFrame:
    rows = kind_filter(activity.where(F.col("asset_id") == asset_id), kinds)
    return newest(rows.select(*EVENT), "slot", "id", after, limit)


def collection_feed(activity: DataFrame, assets: DataFrame, collection_id: int, kinds: list[str] | None = None,
                    after: tuple | None = None, limit: int = 24) -> DataFrame:
    """Newest events of a collection with their cards; the page is cut before the join."""
    rows = kind_filter(activity.where(F.col("collection_id") == collection_id), kinds)
    page = newest(rows.select(*EVENT), "slot", "id", after, limit)
    cards = assets.select(F.col("id").alias("asset_id"), "address", "name", "image_uri", "burned")
    return F.broadcast(page).join(cards, "asset_id").orderBy(F.desc("slot"), F.desc("id"))


def owners_signatures_join(history: DataFrame, activity: DataFrame) -> DataFrame:
    """Intervals with the signatures that opened and closed them."""
    opened = activity.select(F.col("id").alias("opened_by"), F.col("signature").alias("opened_by_signature"))
    closed = activity.select(F.col("id").alias("closed_by"), F.col("signature").alias("closed_by_signature"))
    return history.join(opened, "opened_by", "left").join(closed, "closed_by", "left")


def owners_page(history: DataFrame, activity: DataFrame, asset_id: int, after: tuple | None = None,
                limit: int = 24) -> DataFrame:
    page = newest(history.where(F.col("asset_id") == asset_id), "from_slot", "opened_by", after, limit)
    events = activity.where(F.col("asset_id") == asset_id)
    return owners_signatures_join(page, events).select(
        "owner", "from_slot", "from_ts", "to_slot", "to_ts", F.col("to_slot").isNull().alias("is_current"),
        "opened_by_signature", "closed_by_signature").orderBy(F.desc("from_slot"))


def last_activity(activity: DataFrame) -> DataFrame:
    """Latest slot of each asset, with the time of its latest event in that slot."""
    latest = F.max_by(F.struct("slot", "block_time"), F.struct("slot", "id"))
    return activity.groupBy("asset_id").agg(latest.alias("e")).select(
        "asset_id", F.col("e.slot").alias("last_activity_slot"), F.col("e.block_time").alias("last_activity_at"))


def merge_last_activity(assets: DataFrame, batch: DataFrame) -> DataFrame:
    """Move an asset's last activity forward only."""
    new = last_activity(batch).select(
        F.col("asset_id").alias("id"), F.col("last_activity_slot").alias("_slot"), F.col("last_activity_at").alias("_at"))
    moved = F.coalesce(F.col("_slot") > F.coalesce("last_activity_slot", F.lit(-1)), F.lit(False))
    return assets.join(new, "id", "left").select(
        *[c for c in assets.columns if not c.startswith("last_activity")],
        F.when(moved, F.col("_slot")).otherwise(F.col("last_activity_slot")).alias("last_activity_slot"),
        F.when(moved, F.col("_at")).otherwise(F.col("last_activity_at")).alias("last_activity_at"),
        moved.alias("moved"))


# -- work queues ---------------------------------------------------------------
def assets_after(assets: DataFrame, collection_id: int, after_id: int, limit: int) -> DataFrame:
    rows = population(assets).where((F.col("collection_id") == collection_id) & (F.col("id") > after_id))
    return rows.orderBy("id").limit(limit).select(*REF)


def image_candidates(assets: DataFrame, collection_id: int, after_id: int, days: int, as_of: str,
                     limit: int) -> DataFrame:
    """Assets whose image was never checked or not within ``days``."""
    stale = F.col("image_checked_at") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    rows = assets.where((F.col("collection_id") == collection_id) & F.col("image_uri").isNotNull()
                        & (F.col("id") > after_id) & ((F.col("image_status") == "unknown") | stale))
    return rows.orderBy("id").limit(limit).select("id", "address", "image_uri")


def collection_assets(assets: DataFrame, documents: DataFrame) -> DataFrame:
    """State of every asset for a diff, and whether its document is stored."""
    return document_state_join(assets.select(*REF, "metadata_source_uri"), documents)


def document_state_join(assets: DataFrame, documents: DataFrame) -> DataFrame:
    stored = documents.select(F.col("asset_id").alias("id"), F.lit(True).alias("_has"))
    return assets.join(stored, "id", "left").withColumn("has_document", F.col("_has").isNotNull()).drop("_has")


def dirty_assets(assets: DataFrame, limit: int | None = None) -> DataFrame:
    rows = assets.where("ownership_dirty").select(*REF).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def pending_signatures(signatures: DataFrame) -> DataFrame:
    return signatures.where(F.col("classified_at").isNull()).select(
        "asset_id", "signature", "slot", "block_time", "failed").orderBy("asset_id", "slot", "signature")


# -- detail --------------------------------------------------------------------
def activity_summary(activity: DataFrame, history: DataFrame, minted: bool = False) -> DataFrame:
    """Per asset: sales, transfers, distinct owners, and the last sale. ``minted``: and its first mint, in the same pass."""
    sale = F.col("kind") == "sale"
    last = F.max_by(F.struct("price_lamports", "block_time", "marketplace"), F.when(sale, F.struct("slot", "id")))
    events = activity.where(F.col("kind").isin(*PUBLIC_KINDS)).groupBy("asset_id").agg(
        F.count_if(sale).alias("sales_count"), F.count_if(F.col("kind") == "transfer").alias("transfer_count"),
        last.alias("s"), *([F.min_by(_mint(), F.when(F.col("kind") == "mint", F.struct("slot", "id"))).alias("m")] if minted else []))
    owners = history.groupBy("asset_id").agg(F.countDistinct("owner").alias("owner_count"))
    return events.join(owners, "asset_id", "left").select(
        "asset_id", *(_minted() if minted else []), "sales_count", "transfer_count", F.coalesce("owner_count", F.lit(0)).alias("owner_count"),
        F.col("s.price_lamports").alias("last_sale_price_lamports"), F.col("s.block_time").alias("last_sale_at"),
        F.col("s.marketplace").alias("last_sale_marketplace"))


def _mint() -> Column:
    return F.struct("block_time", "slot", "signature")


def _minted() -> list[Column]:
    return [F.col("m.block_time").alias("minted_at"), F.col("m.slot").alias("mint_slot"), F.col("m.signature").alias("mint_signature")]


def mint_info(activity: DataFrame) -> DataFrame:
    """First mint of each asset."""
    first = F.min_by(_mint(), F.struct("slot", "id"))
    return activity.where(F.col("kind") == "mint").groupBy("asset_id").agg(first.alias("m")).select("asset_id", *_minted())


def open_intervals(history: DataFrame) -> DataFrame:
    return history.where(F.col("to_slot").isNull())


def holder_since(assets: DataFrame, history: DataFrame) -> DataFrame:
    """Since when the observed owner holds, and by which transaction if the history is signed; NULL where the open interval names another."""
    signed = ["opened_by_signature"] if "opened_by_signature" in history.columns else []
    opened = open_intervals(history).select(
        F.col("asset_id").alias("id"), F.col("owner").alias("_owner"), "from_ts", "from_slot", "opened_by", *signed)
    agrees = F.col("owner") == F.col("_owner")
    return assets.select("id", "owner").join(opened, "id", "left").select(
        "id", "owner", F.when(agrees, F.col("from_ts")).alias("held_since"),
        F.when(agrees, F.col("from_slot")).alias("held_since_slot"),
        F.when(agrees, F.col("opened_by")).alias("_opened_by"),
        *[F.when(agrees, F.col(c)).alias("acquired_by_signature") for c in signed])


def attribute_lists(attributes: DataFrame) -> DataFrame:
    """Attributes of each asset, excluded types too, in source order, as one JSON list."""
    cell = F.struct("position", F.col("trait_type").alias("traitType"), "value", F.col("is_facet").alias("isFacet"))
    return attributes.groupBy("asset_id").agg(F.to_json(F.array_sort(F.collect_list(cell))).alias("attributes"))


def nft_detail(assets: DataFrame, collections: DataFrame, attributes: DataFrame, history: DataFrame,
               activity: DataFrame) -> DataFrame:
    """Everything shown about an asset of an enabled collection; removed and burned ones included.

    ``history``: with the signatures of its events, or else these come from ``activity`` by one more join."""
    slugs = collections.where("enabled").select(F.col("id").alias("collection_id"), F.col("slug").alias("collection_slug"), "standard")
    if "opened_by_signature" in history.columns:
        since = holder_since(assets, history).drop("owner", "_opened_by")
    else:
        acquired = activity.select(F.col("id").alias("_opened_by"), F.col("signature").alias("acquired_by_signature"))
        since = holder_since(assets, history).drop("owner").join(acquired, "_opened_by", "left").drop("_opened_by")
    asset = assets.select("id", "address", "collection_id", "name", "number", "symbol", "burned", "owner",
                          "owner_slot", "membership_status", "removed_at")
    out = asset.join(slugs, "collection_id").join(since, "id", "left")
    for piece in (attribute_lists(attributes), activity_summary(activity, history, minted=True)):
        out = out.join(piece.withColumnRenamed("asset_id", "id"), "id", "left")
    return out


def serve_shape(assets: DataFrame, collections: DataFrame) -> DataFrame:
    """Cards as served: camelCase, every key present, 64-bit values as decimal strings."""
    c = collections.select(F.col("id").alias("collection_id"), F.col("slug").alias("_slug"), F.col("name").alias("_cname"))
    card = F.struct(
        "address", "name", "number", F.col("image_uri").alias("imageUri"),
        F.col("image_status").alias("imageStatus"), "burned", "owner",
        F.col("owner_slot").cast("string").alias("ownerSlot"),
        F.date_format("last_activity_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastActivityAt"),
        F.struct(F.col("_slug").alias("slug"), F.col("_cname").alias("name")).alias("collection"))
    return assets.join(c, "collection_id").select(
        F.col("id").cast("string").alias("id"), F.to_json(card, {"ignoreNullFields": "false"}).alias("card"))
