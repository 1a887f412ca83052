"""Ownership intervals from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import PUBLIC_KINDS
from vitrine.operators.ordered import key_sizes, last_before, lead, max_before, scan

EVENT_ORDER = ["slot", "seq", "id"]
MAX_SLOT = (1 << 63) - 1


def ownership_events(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("kind").isin(*PUBLIC_KINDS))


def interval_rebuild(activity: DataFrame, sizes: DataFrame | None = None, signed: bool = False) -> DataFrame:
    """Half-open slot intervals: an event with a receiver opens one, the asset's next
    ownership event of any kind closes it.

    ``sizes``: as for ``scan``. ``signed``: with the signatures of both events, which lie side by side here, so that
    intervals need not be joined to the events again."""
    carried = ["slot", "block_time", "id", *(["signature"] if signed else [])]
    events = ownership_events(activity).select("asset_id", "seq", "to_owner", *carried)
    following = lead(F.struct(*carried))
    out = scan(events, ["asset_id"], EVENT_ORDER, {"next": following}, sizes=sizes).where(F.col("to_owner").isNotNull())
    signatures = [F.col("signature").alias("opened_by_signature"), F.col("next.signature").alias("closed_by_signature")]
    return out.select(
        "asset_id", F.col("to_owner").alias("owner"), F.col("slot").alias("from_slot"),
        F.col("block_time").alias("from_ts"), F.col("next.slot").alias("to_slot"),
        F.col("next.block_time").alias("to_ts"), F.col("id").alias("opened_by"),
        F.col("next.id").alias("closed_by"), *(signatures if signed else []))


def interval_overlap(history: DataFrame) -> DataFrame:
    """Intervals that start before an earlier interval of the same asset has ended."""
    end = F.coalesce("to_slot", F.lit(MAX_SLOT))
    real = history.where(F.col("from_slot") < end)
    out = scan(real, ["asset_id"], ["from_slot", "opened_by"], {"ended": max_before(end)})
    return out.where(F.col("ended") > F.col("from_slot")).drop("ended")


def owner_asof(history: DataFrame, points: DataFrame) -> DataFrame:
    """Who owned each asset at each asked slot. ``points``: (asset_id, slot), any number.

    Interval starts and asked slots are scanned together once per asset, so an asset with
    many of both costs their sum and not their product."""
    starts = history.where(
        F.col("from_slot") < F.coalesce("to_slot", F.lit(MAX_SLOT))).select(
        "asset_id", F.col("from_slot").alias("slot"), F.lit(0).alias("asked"), F.col("opened_by").alias("tie"),
        F.struct("owner", "from_slot", "to_slot").alias("span"))
    asked = points.select("asset_id", "slot").distinct().select(
        "asset_id", "slot", F.lit(1).alias("asked"), F.lit(0).cast("long").alias("tie"),
        F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    sizes = key_sizes(history.select("asset_id").unionByName(points.select("asset_id")), ["asset_id"])
    out = scan(starts.unionByName(asked), ["asset_id"], ["slot", "asked", "tie"],
               {"held": last_before(F.col("span"))}, sizes=sizes).where(F.col("asked") == 1)
    live = F.col("slot") < F.coalesce("held.to_slot", F.lit(MAX_SLOT))
    return out.select("asset_id", "slot", F.when(live, F.col("held.owner")).alias("owner"))
