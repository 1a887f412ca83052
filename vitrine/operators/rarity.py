"""Statistical rarity: sum over facet types of N / (members sharing the value), where
having no value of a type is a value too. All sums are decimals, so the order of addition
cannot change a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.facets import facet_types
from vitrine.operators.ordered import key_sizes, row_number, scan
from vitrine.operators.predicates import population
from vitrine.operators.skew import HEAVY_ROWS, lookup_join
from vitrine.session import durable

CELL = ["collection_id", "trait_type", "value"]
# Wide enough for a term, and narrow enough that differences and sums keep all twelve places: at 38 digits they give up places.
TERM, TOTAL = "decimal(30,12)", "decimal(37,12)"


def _share(n: Column, carriers: Column) -> Column:
    whole = "decimal(18,0)"
    return F.round(n.cast(whole) / carriers.cast(whole), 12).cast(TERM)


def _members(assets: DataFrame) -> DataFrame:
    return population(assets).select(F.col("id").alias("asset_id"), "collection_id")


def _facets(members: DataFrame, attributes: DataFrame) -> DataFrame:
    rows = attributes.where("is_facet").select("asset_id", *CELL)
    return rows.join(members.select("asset_id"), "asset_id", "left_semi")


def _freq(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Members per cell, the absent value as NULL, next to the collection's size."""
    members = _members(assets)
    facets = durable(_facets(members, attributes))
    types = _type_totals(members, facets, attributes)
    present = facets.groupBy(*CELL).agg(F.count(F.lit(1)).alias("carriers")).join(
        types.select("collection_id", "trait_type", "n"), ["collection_id", "trait_type"])
    absent = types.where(F.col("absent") > 0).select(
        "collection_id", "trait_type", F.lit(None).cast("string").alias("value"),
        F.col("absent").alias("carriers"), "n")
    return present.select(*CELL, "carriers", "n").unionByName(absent)


def rarity_freq(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Members per (collection, type, value), the absent value as NULL."""
    return _freq(assets, attributes).drop("n")


def _type_totals(members: DataFrame, facets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per (collection, type): N, and how many members have no value of the type."""
    sizes = members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    having = facets.groupBy("collection_id", "trait_type").agg(F.countDistinct("asset_id").alias("having"))
    return facet_types(attributes).join(sizes, "collection_id").join(
        having, ["collection_id", "trait_type"], "left").select(
        "collection_id", "trait_type", "n", (F.col("n") - F.coalesce("having", F.lit(0))).alias("absent"))


def rarity_score(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Score of every member of a collection that has a facet type.

    No member x type matrix is built: each collection's sum of absent-value terms is
    granted to every member, less the terms of the types the member does have."""
    members = _members(assets)
    # read by five aggregates and joins below, and itself a large join
    facets = durable(_facets(members, attributes))
    types = durable(_type_totals(members, facets, attributes).withColumn(
        "absent_term", F.when(F.col("absent") > 0, _share(F.col("n"), F.col("absent"))).otherwise(
            F.lit(0).cast(TERM))))
    freq = facets.groupBy(*CELL).agg(F.count(F.lit(1)).alias("carriers"))
    # one row per distinct value, read as heavy keys, as their terms and as all other terms
    terms = durable(freq.join(types, ["collection_id", "trait_type"]).select(
        *CELL, "carriers", _share(F.col("n"), F.col("carriers")).alias("term"), "absent_term"))
    heavy = terms.where(F.col("carriers") > HEAVY_ROWS).select(*CELL)
    cells = lookup_join(facets, terms.drop("carriers"), CELL, spread="asset_id", heavy=heavy)
    own = cells.groupBy("asset_id", "trait_type").agg(
        F.sum("term").alias("term"), F.max("absent_term").alias("absent_term"))
    own = own.groupBy("asset_id").agg(F.sum(F.col("term") - F.col("absent_term")).alias("own"))
    base = types.groupBy("collection_id").agg(F.sum("absent_term").alias("base"))
    scored = members.join(base, "collection_id").join(own, "asset_id", "left")
    total = F.col("base").cast(TOTAL) + F.coalesce(F.col("own"), F.lit(0)).cast(TOTAL)
    return scored.select("asset_id", "collection_id", F.round(total, 6).cast("decimal(38,6)").alias("score"))


def rarity_rank(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Exact ranks 1..N per collection, highest score first, ties by asset id."""
    scored = rarity_score(assets, attributes).withColumn("_low", -F.col("score"))
    # the members bound each collection's rows without computing any score
    sizes = key_sizes(_members(assets), ["collection_id"])
    ranked = scan(scored, ["collection_id"], ["_low", "asset_id"], {"rank": row_number()}, sizes=sizes)
    return ranked.select("asset_id", "collection_id", F.col("score").cast("double").alias("rarity_score"),
                         F.col("rank").cast("int").alias("rarity_rank"))


def rarity_rankable(collections: DataFrame, attributes: DataFrame) -> DataFrame:
    """Collections with any facet type."""
    types = facet_types(attributes).select(F.col("collection_id").alias("id"))
    return collections.join(types, "id", "left_semi")


def cell_matrix(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every (member, facet type) with its values; NULL where the member has none."""
    members = _members(assets)
    types = facet_types(attributes).groupBy("collection_id").agg(F.collect_set("trait_type").alias("types"))
    wanted = lookup_join(members, types, ["collection_id"], spread="asset_id", how="inner").select(
        "asset_id", "collection_id", F.explode("types").alias("trait_type"))
    values = attributes.where("is_facet").select("asset_id", "trait_type", "value")
    return wanted.join(values, ["asset_id", "trait_type"], "left").select("asset_id", *CELL)


def _cells_with_freq(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    keys = ["collection_id", "trait_type", "_v", "_none"]
    shown = [F.coalesce("value", F.lit("")).alias("_v"), F.col("value").isNull().alias("_none")]
    freq = _freq(assets, attributes).select("collection_id", "trait_type", *shown, "carriers", "n")
    heavy = freq.where(F.col("carriers") > HEAVY_ROWS).select(*keys)
    cells = cell_matrix(assets, attributes).select("*", *shown)
    return lookup_join(cells, freq, keys, spread="asset_id", heavy=heavy)


def null_safe_freq_join(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every cell with the number of members sharing it, NULL matching NULL."""
    return _cells_with_freq(assets, attributes).select("asset_id", *CELL, "carriers")


def rarity_terms(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per member and cell its carriers and its term of the score."""
    return _cells_with_freq(assets, attributes).select(
        "asset_id", *CELL, "carriers", _share(F.col("n"), F.col("carriers")).alias("term"))


def rarity_explain(assets: DataFrame, attributes: DataFrame, address: Column | str) -> DataFrame:
    """The terms of one asset, largest first. Counts come from its whole collection."""
    target = assets.where(F.col("address") == address).select(F.col("id").alias("asset_id"), "collection_id")
    peers = assets.join(target.select("collection_id"), "collection_id", "left_semi")
    traits = attributes.join(target.select("collection_id"), "collection_id", "left_semi")
    freq = rarity_freq(peers, traits).select(
        "collection_id", "trait_type", F.col("value").alias("_value"), "carriers")
    sizes = population(peers).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    own = cell_matrix(peers.where(F.col("address") == address), traits).join(sizes, "collection_id")
    out = own.join(freq, ["collection_id", "trait_type"]).where(F.col("value").eqNullSafe(F.col("_value")))
    return out.select("trait_type", "value", "carriers", _share(F.col("n"), F.col("carriers")).cast("double")
                      .alias("term")).orderBy(F.desc("term"), "trait_type")


def rarity_apply(stored: DataFrame, ranked: DataFrame) -> DataFrame:
    """New score and rank of every asset that has or had one, and whether it changed.

    ``stored``: (asset_id, collection_id, rarity_score, rarity_rank)."""
    old = stored.where(F.col("rarity_rank").isNotNull()).select(
        "asset_id", F.col("collection_id").alias("_oc"), F.struct("rarity_score", "rarity_rank").alias("_old"))
    new = ranked.select(
        "asset_id", F.col("collection_id").alias("_nc"), F.struct("rarity_score", "rarity_rank").alias("_new"))
    out = old.join(new, "asset_id", "full_outer")
    return out.select(
        "asset_id", F.coalesce("_nc", "_oc").alias("collection_id"), F.col("_new.rarity_score").alias("rarity_score"),
        F.col("_new.rarity_rank").alias("rarity_rank"), F.col("_new").isNotNull().alias("ranked"),
        (~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"))


def rarity_apply_counts(applied: DataFrame, collections: DataFrame) -> DataFrame:
    """Per collection how many ranked and changed, and its version: moved only by a change."""
    counts = applied.groupBy("collection_id").agg(
        F.count_if("ranked").alias("ranked"), F.count_if("changed").alias("changed"))
    return collections.join(counts, F.col("id") == F.col("collection_id"), "left").select(
        F.col("id").alias("collection_id"), F.coalesce("ranked", F.lit(0)).alias("ranked"),
        F.coalesce("changed", F.lit(0)).alias("changed"),
        (F.col("rarity_version") + (F.coalesce("changed", F.lit(0)) > 0).cast("int")).alias("rarity_version"))


def rarity_verify(assets: DataFrame, attributes: DataFrame, stored: DataFrame) -> DataFrame:
    """Scores recomputed from the cells in integer fixed point, against the stored ones."""
    wide = "decimal(38,0)"
    cells = _cells_with_freq(assets, attributes)
    # round(n * 10^12 / c) without division of decimals
    micro = F.expr("cast((2 * cast(n as decimal(18,0)) * 1000000000000 + carriers) div (2 * carriers) as bigint)")
    sums = cells.groupBy("asset_id", "collection_id").agg(F.sum(micro.cast(wide)).alias("_s"))
    millionths = F.expr("cast((2 * _s + 1000000) div 2000000 as bigint)")
    again = sums.select("asset_id", "collection_id", millionths.alias("millionths"))
    kept = stored.select("asset_id", F.round(F.col("rarity_score") * 1000000).cast("bigint").alias("_stored"))
    return again.join(kept, "asset_id", "left").groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if(~F.col("millionths").eqNullSafe(F.col("_stored"))).alias("mismatches"))


def not_ranked_anti(stored: DataFrame, ranked: DataFrame) -> DataFrame:
    """Stored ranks whose asset is no longer ranked."""
    return stored.where(F.col("rarity_rank").isNotNull()).join(ranked.select("asset_id"), "asset_id", "left_anti")
