"""Live ownership: events applied in arrival order, per asset.

The order of arrival decides here. An event that does not continue the asset's open
interval is stored, changes nothing and marks the asset dirty; dirty assets are rebuilt
from all stored events by ``interval_rebuild``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.scalar import PUBLIC_KINDS
from vitrine.operators.chains import BLOCK_ROWS, follow
from vitrine.operators.ordered import lead, scan
from vitrine.session import write_table

APPLIED = ("asset_id BIGINT, arrival BIGINT, id BIGINT, slot BIGINT, kind STRING, opened BOOLEAN, closed BOOLEAN, dirty BOOLEAN, "
           "owner STRING, owner_moved BOOLEAN")
FRONTIER = "asset_id BIGINT, open_owner STRING, open_from BIGINT, burned BOOLEAN, owner STRING, owner_slot BIGINT"


def _steps(rows: DataFrame, start: Column, slot: Column, sender: Column, receiver: Column, burn: Column, *keep: str) -> DataFrame:
    arrival = F.when(start, F.lit(-1).cast("long")).otherwise(F.col("arrival")) if "arrival" in rows.columns else F.lit(-1).cast("long")
    return rows.select("asset_id", arrival.alias("arrival"), start.alias("start"), slot.alias("slot"), sender.alias("sender"),
                       receiver.alias("receiver"), burn.alias("burn"), *keep)


def record_events(events: DataFrame, frontier: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What each event did (APPLIED), in arrival order. ``events``: activity rows with ``arrival`` (not negative, different within an
    asset), deduplicated; ``frontier`` (FRONTIER): the open interval and the asset row before them, of assets that have either.

    ``opened`` and ``closed``: the intervals; ``dirty``: stored and not applied; ``owner``: of the opened interval; ``owner_moved``: the
    asset row took the event's owner, or was burned by it."""
    none, no, yes, col = F.lit(None).cast("string"), F.lit(False), F.lit(True), F.col
    public, burn = col("kind").isin(*PUBLIC_KINDS), col("kind") == "burn"
    # landed once, narrow: what follows reads them more than once, and the range exchange reads its input twice
    events = write_table(events.select("asset_id", "arrival", "id", "slot", "kind", "from_owner", "to_owner"), "arrived", codec="zstd")
    starts = events.select("asset_id").distinct().join(frontier, "asset_id", "left").withColumn("burned", F.coalesce("burned", no))
    starts = write_table(starts, "starts", codec="zstd")
    first = _steps(starts, yes, F.when(col("open_owner").isNotNull(), col("open_from")), none, col("open_owner"), col("burned"))
    steps = _steps(events.where(public), no, col("slot"), col("from_owner"), col("to_owner"), burn, "id", "kind")
    # what an event is goes through the blocks with it, so that the events are not joined to what became of them; no id is NULL, as pandas would
    # then make them floats
    first = first.withColumn("id", F.lit(0).cast("long"))
    taken = follow(first.unionByName(steps, allowMissingColumns=True), "follow", block_rows, ("id", "slot", "kind", "receiver"))
    judged = taken.withColumnRenamed("receiver", "to_owner").unionByName(events.where(~public | col("kind").isNull()).drop("from_owner").withColumns(
        {"taken": no, "was_open": no}))
    judged = write_table(judged, "judged", codec="zstd")
    standing = starts.where(~col("burned"))
    movable = judged.where(col("taken") & ~burn & col("to_owner").isNotNull()).join(standing.select("asset_id"), "asset_id", "left_semi")
    moves = follow(_steps(standing, yes, col("owner_slot"), none, col("owner"), no).unionByName(
        _steps(movable, no, col("slot"), none, col("to_owner"), no)), "move", block_rows).where("taken").select("asset_id", "arrival")
    burns = judged.where(col("taken") & burn).groupBy("asset_id").agg(F.min("arrival").alias("arrival"))
    moves = moves.union(burns.join(standing.select("asset_id"), "asset_id", "left_semi")).withColumn("owner_moved", yes)
    opened = col("taken") & col("to_owner").isNotNull()
    return judged.join(moves, ["asset_id", "arrival"], "left").select(
        "asset_id", "arrival", "id", "slot", "kind", opened.alias("opened"), F.coalesce("was_open", no).alias("closed"),
        (public & ~col("taken")).alias("dirty"), F.when(opened, col("to_owner")).alias("owner"), F.coalesce("owner_moved", no).alias("owner_moved"))


def asset_rows_after(assets: DataFrame, applied: DataFrame) -> DataFrame:
    """``assets`` with owner, owner_slot and burned as the last event that moved each row left them."""
    last = applied.where("owner_moved").groupBy("asset_id").agg(F.max_by(F.struct("kind", "owner", "slot"), "arrival").alias("_m"))
    joined = assets.join(last.withColumnRenamed("asset_id", "id"), "id", "left")
    moved, burn = F.col("_m").isNotNull(), F.col("_m.kind") == "burn"
    return joined.withColumns({
        "owner": F.when(~moved, F.col("owner")).when(~burn, F.col("_m.owner")), "owner_slot": F.when(~moved, F.col("owner_slot")).when(~burn, F.col("_m.slot")),
        "burned": F.col("burned") | (moved & burn)}).select(*assets.columns)


def live_intervals(applied: DataFrame) -> DataFrame:
    """Intervals the applied events opened, each closed by the asset's next applied event."""
    kept = applied.where(F.col("opened") | F.col("closed"))
    spans = scan(kept, ["asset_id"], ["arrival"], {"next": lead(F.struct("slot", "id"))})
    return spans.where("opened").select(
        "asset_id", "owner", F.col("slot").alias("from_slot"), F.col("next.slot").alias("to_slot"),
        F.col("id").alias("opened_by"), F.col("next.id").alias("closed_by"))


def dirty_assets(applied: DataFrame) -> DataFrame:
    return applied.where("dirty").select("asset_id").distinct()
