"""Derived state against observed state, and the rules every table must keep.

Each quality operator returns the rows that break a rule together with the names of the
broken rules; no rows means healthy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import PUBLIC_KINDS, is_pubkey, is_signature
from vitrine.operators.facets import facet_types
from vitrine.operators.intervals import interval_overlap
from vitrine.operators.predicates import enabled_gate, population
from vitrine.operators.timeline import REF, open_intervals


# -- joins the views are made of -------------------------------------------------
def latest_state_left_join(assets: DataFrame, history: DataFrame) -> DataFrame:
    """Every asset with the owner of its open interval, if any."""
    held = open_intervals(history).select(F.col("asset_id").alias("id"), F.col("owner").alias("derived_owner"))
    return assets.join(held, "id", "left")


def has_history_semi(assets: DataFrame, history: DataFrame) -> DataFrame:
    return assets.join(history.select(F.col("asset_id").alias("id")), "id", "left_semi")


def allowlist_anti(assets: DataFrame, mints: DataFrame) -> DataFrame:
    """Assets absent from the allowlist of their collection."""
    listed = mints.select("collection_id", F.col("mint").alias("address"))
    return assets.join(listed, ["collection_id", "address"], "left_anti")


# -- views -----------------------------------------------------------------------
def owner_mismatch(assets: DataFrame, history: DataFrame) -> DataFrame:
    """Assets with history whose observed owner is not the one derived from it."""
    # history per asset in one pass: any interval, and the owner of the open one
    derived = history.groupBy(F.col("asset_id").alias("id")).agg(
        F.max(F.when(F.col("to_slot").isNull(), F.col("owner"))).alias("derived_owner"))
    return assets.select("id", "address", "burned", "owner").join(derived, "id").where(
        ~F.col("owner").eqNullSafe(F.col("derived_owner"))).select(
        F.col("id").alias("asset_id"), "address", "burned", F.col("owner").alias("observed_owner"), "derived_owner")


def owner_agrees(assets: DataFrame, history: DataFrame) -> DataFrame:
    bad = owner_mismatch(assets, history).select(F.col("asset_id").alias("id"), F.lit(True).alias("_bad"))
    return assets.select("id").join(bad, "id", "left").select("id", F.col("_bad").isNull().alias("agrees"))


def drifted_assets(assets: DataFrame, collections: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    bad = owner_mismatch(assets, history).select(F.col("asset_id").alias("id"))
    rows = enabled_gate(population(assets), collections).join(bad, "id", "left_semi").select(*REF).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def allowlist_violation(assets: DataFrame, collections: DataFrame, mints: DataFrame) -> DataFrame:
    ruled = collections.where(F.col("membership_rule") == "tm_allowlist").select(
        F.col("id").alias("collection_id"), "slug")
    return allowlist_anti(assets.join(ruled, "collection_id"), mints).select(
        F.col("id").alias("asset_id"), "address", "slug")


def symbol_mismatch(assets: DataFrame, collections: DataFrame) -> DataFrame:
    ruled = collections.where(F.col("membership_rule") == "tm_allowlist").select(
        F.col("id").alias("collection_id"), "slug", F.col("symbol").alias("expected_symbol"))
    return assets.join(ruled, "collection_id").where(F.col("symbol") != F.col("expected_symbol")).select(
        F.col("id").alias("asset_id"), "address", "slug", F.col("symbol").alias("asset_symbol"), "expected_symbol")


def rarity_broken(assets: DataFrame, collections: DataFrame, attributes: DataFrame) -> DataFrame:
    """Enabled collections with facets whose ranks are not exactly 1..N."""
    faceted = facet_types(attributes).select(F.col("collection_id").alias("id"))
    ruled = collections.where("enabled").join(faceted, "id", "left_semi").select(
        F.col("id").alias("collection_id"), "slug")
    members = population(assets).groupBy("collection_id").agg(
        F.count_if(F.col("rarity_rank").isNull()).alias("unranked"), F.count(F.lit(1)).alias("members"),
        F.countDistinct("rarity_rank").alias("distinct_ranks"), F.max("rarity_rank").cast("long").alias("max_rank"))
    return ruled.join(members, "collection_id").where(
        (F.col("unranked") > 0) | (F.col("distinct_ranks") != F.col("members"))
        | (F.col("max_rank") != F.col("members")))


def integrity_snapshot(assets: DataFrame, collections: DataFrame, mints: DataFrame, attributes: DataFrame,
                       history: DataFrame) -> DataFrame:
    """The five counts that should be zero."""
    views = {
        "owner_mismatch": owner_mismatch(assets, history),
        "allowlist_violation": allowlist_violation(assets, collections, mints),
        "symbol_mismatch": symbol_mismatch(assets, collections),
        "ownership_dirty": assets.where("ownership_dirty"),
        "rarity_broken": rarity_broken(assets, collections, attributes),
    }
    counts = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, v in views.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# -- rules -----------------------------------------------------------------------
def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition (true = broken) holds."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rows with the rules they break; valid rows have an empty list."""
    return df.withColumn("problems", broken(rules))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = quarantine(df, rules)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def event_rules() -> dict[str, Column]:
    c = F.col
    kind = c("kind")
    has = {n: c(n).isNotNull() for n in ("from_owner", "to_owner", "price_lamports", "marketplace")}
    return {
        "unknown_kind": ~kind.isin(*PUBLIC_KINDS),
        "mint_shape": (kind == "mint") & (has["from_owner"] | ~has["to_owner"]),
        "burn_shape": (kind == "burn") & has["to_owner"],
        "receiver_missing": kind.isin("transfer", "sale") & ~has["to_owner"],
        "sale_without_price": (kind == "sale") & ~has["price_lamports"],
        "price_not_sale": (kind != "sale") & (has["price_lamports"] | has["marketplace"]),
        "negative_price": c("price_lamports") < 0,
        "bad_from_owner": ~is_pubkey(c("from_owner")),
        "bad_to_owner": ~is_pubkey(c("to_owner")),
        "bad_signature": ~is_signature(c("signature")),
    }


def asset_rules() -> dict[str, Column]:
    c = F.col
    return {
        "burned_has_owner": c("burned") & c("owner").isNotNull(),
        "owner_without_slot": c("owner").isNotNull() & c("owner_slot").isNull(),
        "removed_without_time": (c("membership_status") == "removed") != c("removed_at").isNotNull(),
        "half_activity": c("last_activity_slot").isNull() != c("last_activity_at").isNull(),
        "half_rarity": c("rarity_score").isNull() != c("rarity_rank").isNull(),
        "rank_below_one": c("rarity_rank") < 1,
    }


def dq_interval_rules(history: DataFrame) -> DataFrame:
    """Intervals that break a rule: order, half-closed, overlapping, or a second open one."""
    key = ["asset_id", "opened_by"]
    single = quarantine(history, {
        "ends_before_start": F.col("to_slot") < F.col("from_slot"),
        "half_closed": F.col("to_slot").isNull() != F.col("to_ts").isNull(),
    }).where(F.size("problems") > 0).select(*key, F.explode("problems").alias("problem"))
    over = interval_overlap(history).select(*key, F.lit("overlap").alias("problem"))
    many = open_intervals(history).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("opened_by").alias("opened_by")).where(F.col("n") > 1).select(
        *key, F.lit("many_open").alias("problem"))
    return single.unionByName(over).unionByName(many)


def dq_attribute_scope(attributes: DataFrame, assets: DataFrame) -> DataFrame:
    """Attributes filed under another collection than their asset."""
    home = assets.select(F.col("id").alias("asset_id"), F.col("collection_id").alias("asset_collection"))
    return attributes.join(home, "asset_id").where(F.col("collection_id") != F.col("asset_collection"))
