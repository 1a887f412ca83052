"""Facet counts, plain and disjunctive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.predicates import filtered, matches_text, population, satisfied

FACET = ["collection_id", "trait_type", "value"]


def facet_types(attributes: DataFrame) -> DataFrame:
    return attributes.where("is_facet").select("collection_id", "trait_type").distinct()


def facet_counts(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Members per facet value, no filter."""
    members = population(assets).select(F.col("id").alias("asset_id"))
    return attributes.where("is_facet").join(members, "asset_id", "left_semi").groupBy(*FACET).agg(
        F.count(F.lit(1)).alias("n"))


def facet_disjunctive(assets: DataFrame, attributes: DataFrame, selections: dict[str, list[str]],
                      q: str | None = None, collection_id: int | None = None) -> DataFrame:
    """Counts per value with every filter applied except the value's own type.

    One pass: an asset that meets all k chosen types counts for all its values; one that
    misses exactly one type counts for its values of that type."""
    members = population(assets).where(matches_text(q))
    if collection_id is not None:
        members = members.where(F.col("collection_id") == collection_id)
        attributes = attributes.where(F.col("collection_id") == collection_id)
    facets = attributes.where("is_facet")
    members = members.select(F.col("id").alias("asset_id"))
    if not selections:
        kept = facets.join(members, "asset_id", "left_semi")
    else:
        k = len(selections)
        met = satisfied(attributes, selections)
        if k == 1:
            near = members.join(met, "asset_id", "left").withColumn("_met", F.coalesce("_met", F.array().cast("array<string>")))
        else:
            near = members.join(met.where(F.size("_met") >= k - 1), "asset_id")
        chosen = F.array(*[F.lit(t) for t in selections])
        near = near.select("asset_id", F.get(F.array_except(chosen, "_met"), F.lit(0)).alias("_missed"))
        kept = facets.join(near, "asset_id").where(
            F.col("_missed").isNull() | (F.col("_missed") == F.col("trait_type")))
    return kept.groupBy(*FACET).agg(F.count(F.lit(1)).alias("n"))


def filtered_total(assets: DataFrame, attributes: DataFrame, selections: dict[str, list[str]] | None = None,
                   q: str | None = None, collection_id: int | None = None) -> DataFrame:
    """Assets per collection under every filter."""
    return filtered(assets, attributes, selections, q, collection_id).groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("total"))


def facets_response(collections: DataFrame, assets: DataFrame, attributes: DataFrame,
                    selections: dict[str, list[str]], q: str | None = None) -> DataFrame:
    """Per enabled collection and facet type: the filtered total and one JSON list of counts,
    most frequent value first. The list holds one entry per value with a count."""
    total = filtered_total(assets, attributes, selections, q)
    counts = facet_disjunctive(assets, attributes, selections, q)
    entry = F.struct((-F.col("n")).alias("o"), F.col("value"), F.col("n").alias("count"))
    groups = counts.groupBy("collection_id", "trait_type").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    groups = groups.select("collection_id", "trait_type", F.to_json(F.transform(
        "v", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))).alias("values"))
    enabled = collections.where("enabled").select(F.col("id").alias("collection_id"), "slug")
    return enabled.join(total, "collection_id", "left").join(groups, "collection_id", "left").select(
        "slug", F.coalesce("total", F.lit(0)).alias("total"), "trait_type", "values")


def trait_cardinality(attributes: DataFrame) -> DataFrame:
    """Distinct values and distinct assets per trait type."""
    return attributes.groupBy("collection_id", "trait_type", "is_facet").agg(
        F.countDistinct("value").alias("values"), F.countDistinct("asset_id").alias("assets"))


def facet_cardinality_warn(attributes: DataFrame, min_assets: int = 200, ratio: float = 0.5) -> DataFrame:
    """Facet types whose values are nearly one per asset."""
    return trait_cardinality(attributes).where(
        F.col("is_facet") & (F.col("assets") >= min_assets) & (F.col("values") > F.col("assets") * ratio))


def bench_scenarios(assets: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per facet type the two commonest values, the one at 30 % and the rarest."""
    from vitrine.operators.ordered import row_number, scan

    counts = facet_counts(assets, attributes).withColumn("_less", -F.col("n"))
    by = ["collection_id", "trait_type"]
    placed = scan(counts, by, ["_less", "value"], {"place": row_number()})
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    at = F.col("place") - 1
    role = (F.when(at == 0, "commonest").when(at == 1, "second")
            .when(at == F.expr("_k * 30 div 100"), "p30").when(at == F.col("_k") - 1, "rarest"))
    return placed.join(sizes, by).withColumn("role", role).where(F.col("role").isNotNull()).select(
        *FACET, "n", "role")
