"""Equi-joins against a one-row-per-key side, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is heavy, whatever the size of the table: more than one task should do for one key.
HEAVY_ROWS = 1_000_000
# Heavy keys are broadcast up to this many; there are under 1/HEAVY_ROWS as many of them as rows.
BROADCAST_KEYS = 200_000


def heavy_keys(df: DataFrame, keys: list[str], rows: int = HEAVY_ROWS) -> DataFrame:
    """The keys with more than ``rows`` rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > rows).select(*keys)


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], spread: str,
                how: str = "left", heavy: DataFrame | None = None) -> DataFrame:
    """``facts`` joined to ``lookup``, which has one row per key.

    Rows of heavy keys are matched by broadcasting the heavy lookup rows and are then
    spread over all partitions by ``spread``; only the light keys meet in the shuffle."""
    extra = [c for c in lookup.columns if c not in keys]
    if heavy is None:
        heavy = heavy_keys(facts, keys)
    if heavy.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return facts.join(lookup, keys, how)  # adaptive execution splits the heavy keys
    top = lookup.join(F.broadcast(heavy), keys, "left_semi")
    top = top.select(*keys, F.struct(*extra).alias("_top"))
    rest = lookup.select(*keys, F.lit(0).alias("_salt"), F.struct(*extra).alias("_rest"))
    # a NULL key matches nothing, so those rows are spread as well
    light = F.col("_top").isNull()
    for k in keys:
        light = light & F.col(k).isNotNull()
    salted = facts.join(F.broadcast(top), keys, "left").withColumn(
        "_salt", F.when(light, F.lit(0))
        .otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1))
    out = salted.join(rest, [*keys, "_salt"], "left")
    if how == "inner":
        out = out.where(F.col("_top").isNotNull() | F.col("_rest").isNotNull())
    return out.select(
        *facts.columns,
        *[F.coalesce(F.col(f"_top.{c}"), F.col(f"_rest.{c}")).alias(c) for c in extra])


# A registry up to this many rows is broadcast whole: some 40 MB of keys and labels.
REGISTRY_ROWS = 300_000


def registry_join(facts: DataFrame, registry: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """``facts`` joined to a stored registry with one row per key: broadcast when its size,
    which is counted, allows; otherwise the skew-safe lookup."""
    if registry.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS:
        return facts.join(F.broadcast(registry), keys, how)
    return lookup_join(facts, registry, keys, spread, how)
