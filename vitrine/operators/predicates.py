"""Shared filters: who is in the catalogue, and which of them a request selects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import PUBLIC_KINDS



NUMBER_QUERY = re.compile(r"^#?[0-9]{1,9}$")


def population(assets: DataFrame) -> DataFrame:
    """The browse population: members, burned ones included, removed ones not."""
    return assets.where(F.col("membership_status") == "member")


def enabled_gate(df: DataFrame, collections: DataFrame, on: str = "collection_id") -> DataFrame:
    """Rows of enabled collections."""
    enabled = collections.where("enabled").select(F.col("id").alias(on))
    return df.join(enabled, on, "left_semi")


def matches_text(q: str | None) -> Column:
    """Address prefix, token number, or case-insensitive name substring; no text, no filter."""
    q = (q or "").strip()
    if not q:
        return F.lit(True)
    hit = F.startswith(F.col("address"), F.lit(q)) | F.contains(F.lower("name"), F.lit(q.lower()))
    if NUMBER_QUERY.match(q):
        hit = hit | F.coalesce(F.col("number") == int(q.lstrip("#")), F.lit(False))
    return hit


def contains_literal(c: Column | str, needle: str) -> Column:
    """Case-insensitive substring test in which ``%`` and ``_`` mean themselves."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def kind_filter(activity: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    kinds = kinds or list(PUBLIC_KINDS)
    unknown = sorted(set(kinds) - set(PUBLIC_KINDS))
    if unknown:
        raise ValueError(f"unknown event kinds: {unknown}")
    return activity.where(F.col("kind").isin(*kinds))


def selected(selections: dict[str, list[str]]) -> Column:
    """Does an attribute row carry one of the chosen values of a chosen type?"""
    hit = F.lit(False)
    for trait_type, values in selections.items():
        hit = hit | ((F.col("trait_type") == trait_type) & F.col("value").isin(*values))
    return hit


def satisfied(attributes: DataFrame, selections: dict[str, list[str]]) -> DataFrame:
    """Per asset, the chosen types of which it has a chosen value; a chosen type need not be one that is counted."""
    return attributes.where(selected(selections)).groupBy("asset_id").agg(F.collect_set("trait_type").alias("_met"))


def trait_filter(assets: DataFrame, attributes: DataFrame, selections: dict[str, list[str]]) -> DataFrame:
    """Assets with one of the values of every chosen type."""
    if not selections:
        return assets
    keep = satisfied(attributes, selections).where(F.size("_met") == len(selections)).select(F.col("asset_id").alias("id"))
    return assets.join(keep, "id", "left_semi")


def filtered(assets: DataFrame, attributes: DataFrame, selections: dict[str, list[str]] | None = None,
             q: str | None = None, collection_id: int | None = None) -> DataFrame:
    """The one predicate behind pages, totals and facet counts."""
    out = population(assets)
    if collection_id is not None:
        out = out.where(F.col("collection_id") == collection_id)
        attributes = attributes.where(F.col("collection_id") == collection_id)
    return trait_filter(out.where(matches_text(q)), attributes, selections or {})


def keyset_after(key: Column, tie: Column, last_key, last_tie, descending: bool = False) -> Column:
    """Rows after ``(last_key, last_tie)``, spelled out so that file statistics can prune."""
    k, t = F.lit(last_key), F.lit(last_tie)
    if descending:
        return (key < k) | ((key == k) & (tie < t))
    return (key > k) | ((key == k) & (tie > t))
