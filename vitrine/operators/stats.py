"""Collection statistics, holders and wallets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.predicates import enabled_gate, keyset_after, population
from vitrine.operators.skew import HEAVY_ROWS, lookup_join

# Holder cohorts as (label, lowest, highest or None).
BUCKETS = (("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21+", 21, None))


def collection_stats(collections: DataFrame, assets: DataFrame, activity: DataFrame, as_of: str) -> DataFrame:
    """Supply, holders, recent events and last activity of every collection at ``as_of``."""
    burned = F.col("burned")
    members = population(assets).groupBy("collection_id").agg(
        F.count_if(~burned).alias("supply"), F.countDistinct("owner").alias("holders"),
        F.count_if(burned).alias("burned"), F.count(F.lit(1)).alias("indexed"),
        F.max("last_activity_at").alias("last_activity_at"))
    now = F.lit(as_of).cast("timestamp")
    week, day = now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 24 HOURS")
    events = activity.where(F.col("block_time") >= week).groupBy("collection_id").agg(
        F.count_if(F.col("block_time") >= day).alias("activity_24h"), F.count(F.lit(1)).alias("activity_7d"))
    ids = collections.select(F.col("id").alias("collection_id"))
    zero = ["supply", "holders", "activity_24h", "activity_7d", "burned", "indexed"]
    return ids.join(members, "collection_id", "left").join(events, "collection_id", "left").select(
        "collection_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "last_activity_at")


def held_per_owner(assets: DataFrame) -> DataFrame:
    return population(assets).where(F.col("owner").isNotNull()).groupBy("collection_id", "owner").agg(
        F.count(F.lit(1)).alias("held"))


def holder_buckets(collections: DataFrame, assets: DataFrame) -> DataFrame:
    """Holders and assets per cohort; empty cohorts are present."""
    label = None
    for name, low, high in BUCKETS:
        fits = (F.col("held") >= low) if high is None else F.col("held").between(low, high)
        label = F.when(fits, name) if label is None else label.when(fits, name)
    counts = held_per_owner(assets).groupBy("collection_id", label.alias("label")).agg(
        F.count(F.lit(1)).alias("holders"), F.sum("held").alias("assets"))
    cohorts = F.array(*[
        F.struct(F.lit(n).alias("label"), F.lit(lo).alias("min_count"), F.lit(hi).cast("int").alias("max_count"))
        for n, lo, hi in BUCKETS])
    rows = collections.select(F.col("id").alias("collection_id"), F.inline(cohorts))
    return rows.join(counts, ["collection_id", "label"], "left").select(
        "collection_id", "label", "min_count", "max_count",
        F.coalesce("holders", F.lit(0)).alias("holders"), F.coalesce("assets", F.lit(0)).alias("assets"))


def collections_overview(collections: DataFrame, assets: DataFrame, activity: DataFrame, as_of: str) -> DataFrame:
    """Every enabled collection with its statistics and its cohorts as one JSON list."""
    enabled = collections.where("enabled")
    stats = collection_stats(enabled, assets, activity, as_of)
    cohorts = holder_buckets(enabled, assets).groupBy("collection_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("min_count", "label", "holders", "assets"))),
        lambda b: F.struct(b["label"].alias("label"), b["holders"].alias("holders"), b["assets"].alias("assets")))
    ).alias("holder_buckets"))
    return enabled.select(F.col("id").alias("collection_id"), "slug", "name").join(stats, "collection_id").join(
        cohorts, "collection_id").orderBy("collection_id")


def holder_rank(collections: DataFrame, assets: DataFrame) -> DataFrame:
    """Holders of enabled collections ranked by holdings; ties share a rank and gaps follow.

    A rank is one more than the number of holders with more, so only the histogram of
    holdings is ordered: a collection of n assets has under sqrt(2n) + 1 distinct holdings."""
    owners = enabled_gate(held_per_owner(assets), collections)
    histogram = owners.groupBy("collection_id", "held").agg(F.count(F.lit(1)).alias("n"))
    more = Window.partitionBy("collection_id").orderBy(F.desc("held"))
    ranks = histogram.select("collection_id", "held", (F.sum("n").over(more) - F.col("n") + 1).alias("rank"))
    heavy = histogram.where(F.col("n") > HEAVY_ROWS).select("collection_id", "held")
    return lookup_join(owners, ranks, ["collection_id", "held"], spread="owner", heavy=heavy).select(
        "collection_id", F.col("owner").alias("address"), F.col("held").alias("count"), "rank")


def top_holders(collections: DataFrame, assets: DataFrame, collection_id: int, limit: int = 100) -> DataFrame:
    ranked = holder_rank(collections, assets.where(F.col("collection_id") == collection_id))
    return ranked.orderBy("rank", "address").limit(limit)


def wallet_holder_ranks(collections: DataFrame, assets: DataFrame, wallet: str) -> DataFrame:
    """A wallet's rank in each collection it holds, among all holders."""
    return holder_rank(collections, assets).where(F.col("address") == wallet)


def _held(collections: DataFrame, assets: DataFrame) -> DataFrame:
    return enabled_gate(population(assets).where(F.col("owner").isNotNull()), collections)


def wallet_collections_join(collections: DataFrame, assets: DataFrame) -> DataFrame:
    """Holdings of every wallet with the enabled collection they are in."""
    enabled = collections.where("enabled").select(F.col("id").alias("collection_id"), "slug")
    return population(assets).where(F.col("owner").isNotNull()).join(enabled, "collection_id").select(
        "owner", "id", "collection_id", "slug")


def wallet_total(collections: DataFrame, assets: DataFrame) -> DataFrame:
    return _held(collections, assets).groupBy("owner").agg(F.count(F.lit(1)).alias("total"))


def wallet_holdings(collections: DataFrame, assets: DataFrame) -> DataFrame:
    return _held(collections, assets).groupBy("owner", "collection_id").agg(F.count(F.lit(1)).alias("count"))


def wallet_page(collections: DataFrame, assets: DataFrame, wallet: str, collection_id: int | None = None,
                after: tuple[int, int] | None = None, limit: int = 24) -> DataFrame:
    rows = enabled_gate(population(assets).where(F.col("owner") == wallet), collections)
    if collection_id is not None:
        rows = rows.where(F.col("collection_id") == collection_id)
    if after is not None:
        rows = rows.where(keyset_after(F.col("collection_id"), F.col("id"), *after))
    return rows.orderBy("collection_id", "id").limit(limit).select("collection_id", "id", "address", "name")


def wallet_portfolio(collections: DataFrame, assets: DataFrame) -> DataFrame:
    """Per wallet its total, and per collection the count and the holder rank."""
    ranks = holder_rank(collections, assets)
    totals = ranks.groupBy("address").agg(F.sum("count").alias("total_count"))
    slugs = collections.select(F.col("id").alias("collection_id"), "slug")
    return ranks.join(totals, "address").join(slugs, "collection_id").select(
        "address", "total_count", "slug", "count", F.col("rank").alias("holder_rank"))


def member_count(assets: DataFrame) -> DataFrame:
    return population(assets).groupBy("collection_id").agg(F.count(F.lit(1)).alias("members"))
