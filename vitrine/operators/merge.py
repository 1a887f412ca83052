"""Upserts as *stored snapshot + batch -> new snapshot + what happened to each row*.

Rows are compared null-safely before they count as changed, so running a batch again
changes nothing. Writers put the new snapshot under a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import is_pubkey

ACTION = "action"


def _pack(columns: list[str]) -> Column:
    return F.struct(*columns)


def merge_guarded(stored: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert new keys, overwrite ``columns`` where they differ, keep the rest.

    ``action``: inserted, updated, unchanged, or kept (not in the batch)."""
    old = stored.select(*keys, _pack(columns).alias("_old"))
    new = batch.select(*keys, _pack(columns).alias("_new"))
    action = (F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept")
              .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated"))
    out = old.join(new, keys, "full_outer")
    now = F.coalesce("_new", "_old")
    return out.select(*keys, *[now[c].alias(c) for c in columns], action.alias(ACTION))


def action_counts(merged: DataFrame, *by: str) -> DataFrame:
    return merged.groupBy(*by, ACTION).agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key. An aggregate, so copies of a hot key combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


# -- assets ------------------------------------------------------------------------
ASSET_TEXT = ["name", "symbol", "metadata_uri", "metadata_source_uri", "image_uri"]
STATE = ["burned", "owner", "owner_slot"]


def upsert_assets(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Apply a snapshot batch; ``batch`` carries ``owner_slot`` (when it was read) and ``ord``.

    Malformed addresses are ``invalid``, an address of another collection is
    ``skipped_foreign``, and only the first of several batch rows per address is used.
    Burning is monotone; an owner moves only at a greater slot; source and image URIs stick."""
    shaped = batch.withColumn("owner", F.when(is_pubkey(F.col("owner")), F.col("owner")))
    invalid = shaped.where(~F.coalesce(is_pubkey(F.col("address")), F.lit(False)))
    rows = first_of(shaped.where(is_pubkey(F.col("address"))), ["address"], ["ord"])
    fields = ["collection_id", *ASSET_TEXT, *STATE]
    old = stored.select("address", F.struct(*fields).alias("o"))
    new = rows.select("address", F.struct(*fields).alias("n"))
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    fresh, absent = F.col("o").isNull(), F.col("n").isNull()
    foreign = o("collection_id") != n("collection_id")
    burned = F.coalesce(o("burned"), F.lit(False)) | n("burned")
    # a row without an owner carries no slot
    slot = F.when(n("owner").isNotNull(), n("owner_slot"))
    later = o("owner_slot").isNull() | F.coalesce(slot > o("owner_slot"), F.lit(False))
    text = {
        "name": n("name"), "symbol": n("symbol"), "metadata_uri": n("metadata_uri"),
        "metadata_source_uri": F.coalesce(n("metadata_source_uri"), o("metadata_source_uri")),
        "image_uri": F.coalesce(n("image_uri"), o("image_uri")),
    }
    owner = F.when(burned, F.lit(None)).when(fresh | later, n("owner")).otherwise(o("owner"))
    owner_slot = F.when(burned, F.lit(None)).when(fresh | later, slot).otherwise(o("owner_slot"))
    changed = (~F.struct(*[text[c].alias(c) for c in ASSET_TEXT]).eqNullSafe(
                   F.struct(*[o(c).alias(c) for c in ASSET_TEXT]))
               | (n("burned") & ~o("burned"))
               | (~burned & later & ~o("owner").eqNullSafe(n("owner"))))
    action = (F.when(absent, "kept").when(fresh, "inserted").when(foreign, "skipped_foreign")
              .when(changed, "updated").otherwise("unchanged"))
    write = action.isin("inserted", "updated")
    take = lambda c, value: F.when(write, value).otherwise(o(c)).alias(c)
    merged = old.join(new, "address", "full_outer").select(
        "address", F.coalesce(o("collection_id"), n("collection_id")).alias("collection_id"),
        *[take(c, text[c]) for c in ASSET_TEXT], take("burned", burned), take("owner", owner),
        take("owner_slot", owner_slot), action.alias(ACTION))
    rejected = invalid.select(
        "address", "collection_id", *ASSET_TEXT, *STATE, F.lit("invalid").alias(ACTION))
    return merged.unionByName(rejected)


def apply_state(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Owner and burned status only, under the same guards; never inserts.

    ``observed``: (address, collection_id, owner, burned, slot)."""
    seen = observed.where(is_pubkey(F.col("address"))).select(
        "address", "collection_id", F.struct("owner", "burned", "slot").alias("x"))
    x = lambda c: F.col(f"x.{c}")
    c = F.col
    burned = c("burned") | x("burned")
    later = c("owner_slot").isNull() | (x("slot") > c("owner_slot"))
    burn = x("burned") & ~c("burned")
    move = ~burned & x("owner").isNotNull() & later & ~c("owner").eqNullSafe(x("owner"))
    hit = F.coalesce(burn | move, F.lit(False))
    return stored.join(seen, ["address", "collection_id"], "left").select(
        *[col for col in stored.columns if col not in STATE],
        F.when(hit, burned).otherwise(c("burned")).alias("burned"),
        F.when(hit & burned, F.lit(None)).when(hit, x("owner")).otherwise(c("owner")).alias("owner"),
        F.when(hit & burned, F.lit(None)).when(hit, x("slot")).otherwise(c("owner_slot")).alias("owner_slot"),
        hit.alias("changed"))


def set_membership(stored: DataFrame, moves: DataFrame, as_of: str) -> DataFrame:
    """Remove or restore assets. ``moves``: (address, collection_id, removed)."""
    status = F.when(F.col("_removed"), "removed").otherwise("member")
    hit = F.coalesce(F.col("_removed").isNotNull() & (F.col("membership_status") != status), F.lit(False))
    asked = moves.select("address", "collection_id", F.col("removed").alias("_removed"))
    return stored.join(asked, ["address", "collection_id"], "left").select(
        *[c for c in stored.columns if c not in ("membership_status", "removed_at")],
        F.when(hit, status).otherwise(F.col("membership_status")).alias("membership_status"),
        F.when(hit & F.col("_removed"), F.lit(as_of).cast("timestamp")).when(hit, F.lit(None))
        .otherwise(F.col("removed_at")).alias("removed_at"), hit.alias("changed"))


def set_image_status(stored: DataFrame, checks: DataFrame, as_of: str) -> DataFrame:
    """Write determined outcomes (address, collection_id, status); undetermined rows are absent."""
    asked = checks.where(F.col("status").isNotNull()).select("address", "collection_id", "status")
    return stored.join(asked, ["address", "collection_id"], "left").select(
        *[c for c in stored.columns if c not in ("image_status", "image_checked_at")],
        F.coalesce("status", "image_status").alias("image_status"),
        F.when(F.col("status").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("image_checked_at"))
        .alias("image_checked_at"))


def dirty_flags(assets: DataFrame, marked: DataFrame) -> DataFrame:
    """Flag assets for a rebuild; ``flagged`` tells the newly flagged. ``marked``: (id)."""
    hit = F.col("_m").isNotNull()
    return assets.join(marked.select("id").distinct().withColumn("_m", F.lit(True)), "id", "left").select(
        *[c for c in assets.columns if c != "ownership_dirty"],
        (F.col("ownership_dirty") | hit).alias("ownership_dirty"),
        (hit & ~F.col("ownership_dirty")).alias("flagged"))


# -- attributes ----------------------------------------------------------------------
ATTRIBUTE = ["asset_id", "collection_id", "trait_type", "value"]


def attribute_dedupe(attributes: DataFrame) -> DataFrame:
    """One row per (asset, type, value): the lowest position."""
    return attributes.groupBy(*ATTRIBUTE).agg(F.min("position").alias("position"))


def replace_attributes(stored: DataFrame, scope: DataFrame, observed: DataFrame) -> DataFrame:
    """Replace the attributes of the assets in ``scope`` (asset_id: attributes were observed);
    an asset in scope without rows loses all of its own, one out of scope keeps them."""
    old = stored.select(*ATTRIBUTE, F.col("position").alias("_old"))
    new = attribute_dedupe(observed.join(scope.select("asset_id"), "asset_id", "left_semi")).select(
        *ATTRIBUTE, F.col("position").alias("_new"))
    seen = scope.select("asset_id").distinct().withColumn("_seen", F.lit(True))
    both = old.join(new, ATTRIBUTE, "full_outer").join(seen, "asset_id", "left")
    action = (F.when(F.col("_old").isNull(), "inserted")
              .when(F.col("_new").isNull(), F.when(F.col("_seen"), "removed").otherwise("kept"))
              .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated"))
    return both.select(*ATTRIBUTE, F.coalesce("_new", "_old").alias("position"), action.alias(ACTION))


def trait_dictionary(attributes: DataFrame, collections: DataFrame) -> DataFrame:
    """Distinct types and values per collection; a type the collection excludes is no facet."""
    pairs = attributes.select("collection_id", "trait_type", "value").distinct()
    return sync_trait_facets(pairs, collections)


def sync_trait_facets(types: DataFrame, collections: DataFrame) -> DataFrame:
    """Derive the facet flag of (collection_id, trait_type) rows from the registry."""
    rule = collections.select(F.col("id").alias("collection_id"), "facet_exclude")
    return types.join(rule, "collection_id").withColumn(
        "is_facet", ~F.array_contains("facet_exclude", F.col("trait_type"))).drop("facet_exclude")


def rarity_dirty(collections: DataFrame, upserts: DataFrame, attribute_changes: DataFrame,
                 moves: DataFrame) -> DataFrame:
    """Collections whose ranks are stale: an insert, an attribute change or a membership move."""
    hits = (upserts.where(F.col(ACTION) == "inserted").select("collection_id")
            .union(attribute_changes.where(F.col(ACTION).isin("inserted", "updated", "removed")).select("collection_id"))
            .union(moves.where("changed").select("collection_id"))).distinct()
    marked = hits.select(F.col("collection_id").alias("id"), F.lit(True).alias("_m"))
    return collections.join(marked, "id", "left").select(
        "id", (F.col("rarity_dirty") | F.col("_m").isNotNull()).alias("rarity_dirty"))


# -- signatures and events --------------------------------------------------------------
def signature_fill(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert new (asset, signature) rows; fill a missing block time, never replace one."""
    key = ["asset_id", "signature"]
    fields = ["slot", "block_time", "failed"]
    old = stored.select(*key, F.struct(*fields).alias("o"))
    new = first_of(batch.select(*key, *fields), key, ["slot"]).select(*key, F.struct(*fields).alias("n"))
    filled = F.col("o.block_time").isNull() & F.col("n.block_time").isNotNull()
    action = (F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept")
              .when(filled, "updated").otherwise("unchanged"))
    return old.join(new, key, "full_outer").select(
        *key, F.coalesce("o.slot", "n.slot").alias("slot"),
        F.coalesce("o.block_time", "n.block_time").alias("block_time"),
        F.coalesce("o.failed", "n.failed").alias("failed"), action.alias(ACTION))


def mark_classified(stored: DataFrame, classified: DataFrame, as_of: str) -> DataFrame:
    key = ["asset_id", "signature"]
    done = classified.select(*key).distinct().withColumn("_d", F.lit(as_of).cast("timestamp"))
    return stored.join(done, key, "left").withColumn(
        "classified_at", F.coalesce("classified_at", "_d")).drop("_d")


def signature_dedupe(events: DataFrame, arrival: list[str]) -> DataFrame:
    """First row to arrive per (asset, signature, seq)."""
    return first_of(events, ["asset_id", "signature", "seq"], arrival)


def reclassify_reset(assets: DataFrame, activity: DataFrame, history: DataFrame, signatures: DataFrame,
                     chosen: DataFrame) -> dict[str, DataFrame]:
    """Drop all that was derived for the ``chosen`` assets (id); raw signatures stay, unclassified."""
    by_asset = chosen.select(F.col("id").alias("asset_id"))
    hit = chosen.select("id").distinct().withColumn("_c", F.lit(True))
    marked = assets.join(hit, "id", "left")
    reset = F.col("_c").isNotNull()
    cleared = marked.select(
        *[c for c in assets.columns if c not in ("last_activity_slot", "last_activity_at", "ownership_dirty")],
        F.when(~reset, F.col("last_activity_slot")).alias("last_activity_slot"),
        F.when(~reset, F.col("last_activity_at")).alias("last_activity_at"),
        (F.col("ownership_dirty") & ~reset).alias("ownership_dirty"))
    raw = signatures.join(hit.withColumnRenamed("id", "asset_id"), "asset_id", "left").select(
        *[c for c in signatures.columns if c != "classified_at"],
        F.when(~reset, F.col("classified_at")).alias("classified_at"))
    return {"assets": cleared, "activity": activity.join(by_asset, "asset_id", "left_anti"),
            "history": history.join(by_asset, "asset_id", "left_anti"), "signatures": raw}


def promote_to_sale(activity: DataFrame, venues: DataFrame) -> DataFrame:
    """Stored transfers with a positive candidate price and a known venue become sales."""
    from vitrine.operators.classify import venue_first_match

    lamports = F.get_json_object("details", "$.price_candidate.lamports").cast("long")
    programs = F.from_json(F.get_json_object("details", "$.programs"), "array<string>")
    waiting = activity.where((F.col("kind") == "transfer") & (lamports > 0)).select("id", programs.alias("programs"))
    found = venue_first_match(waiting, venues, "id").select("id", F.col("venue").alias("_venue"))
    hit = F.col("_venue").isNotNull()
    return activity.join(found, "id", "left").select(
        *[c for c in activity.columns if c not in ("kind", "price_lamports", "marketplace")],
        F.when(hit, "sale").otherwise(F.col("kind")).alias("kind"),
        F.when(hit, lamports).otherwise(F.col("price_lamports")).alias("price_lamports"),
        F.coalesce("_venue", "marketplace").alias("marketplace"), hit.alias("promoted"))


# -- registry and run state ---------------------------------------------------------------
IDENTITY = ["standard", "address", "verified_creator"]
REGISTRY = ["name", *IDENTITY, "update_authority", "symbol", "metadata_uri_template", "enabled", "program"]


def registry_upsert(stored: DataFrame, seed: DataFrame, assets: DataFrame) -> DataFrame:
    """Upsert collections by slug. One whose identity would change although it has assets is
    ``refused``; one missing from the seed is ``extra`` and stays."""
    used = assets.select(F.col("collection_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    ids = stored.select("id", "slug").join(used, "id", "left").select("slug", "id", F.col("_used").isNotNull().alias("_used"))
    old = stored.select("slug", F.struct(*REGISTRY).alias("o"))
    new = seed.select("slug", F.struct(*REGISTRY).alias("n"))
    moved = ~F.struct(*[F.col(f"o.{c}") for c in IDENTITY]).eqNullSafe(F.struct(*[F.col(f"n.{c}") for c in IDENTITY]))
    action = (F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "extra")
              .when(F.coalesce("_used", F.lit(False)) & moved, "refused")
              .when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("updated"))
    out = old.join(new, "slug", "full_outer").join(ids, "slug", "left").withColumn(ACTION, action)
    now = F.when(F.col(ACTION).isin("inserted", "updated"), F.col("n")).otherwise(F.col("o"))
    return out.select("id", "slug", *[now[c].alias(c) for c in REGISTRY], ACTION)


def foreign_owner_join(listed: DataFrame, mints: DataFrame) -> DataFrame:
    """Listed mints that already belong to another collection."""
    stored = mints.select("mint", F.col("collection_id").alias("owned_by"))
    return listed.join(stored, "mint").where(F.col("collection_id") != F.col("owned_by"))


def checkpoint_max(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stream positions (stream, slot) only move forward."""
    return stored.unionByName(batch).groupBy("stream").agg(F.max("slot").alias("slot"))


def run_log_upsert(runs: DataFrame) -> DataFrame:
    """Latest row per (collection, kind) of an append-only run log ordered by ``run_id``."""
    rest = [c for c in runs.columns if c not in ("collection_id", "kind")]
    return runs.groupBy("collection_id", "kind").agg(F.max_by(F.struct(*rest), "run_id").alias("r")).select(
        "collection_id", "kind", *[F.col(f"r.{c}").alias(c) for c in rest])
