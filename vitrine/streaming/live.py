"""Live ownership as two streams and a rebuild.

``start_admission`` lets in the events of enabled collections. The registry is read anew for each micro-batch and pinned under
the batch's id, so a collection that was enabled since the last batch counts from this one on, and a batch that is run again sees
what it saw before.

``start_ownership`` drops redelivered events and applies the others to a keyed state: what each asset holds, how its row stands.
Both lie in Spark's state store, so a batch costs what its own events cost, however long the history is, and a restart goes on
from the last committed state.

``rebuild_history`` replaces the touched buckets of the interval table from all their events and commits them as one version.
Assets that an event found out of order are right after that pass; rows that tell their new standing go back into the stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from vitrine.functions.scalar import PUBLIC_KINDS
from vitrine.operators.intervals import interval_rebuild
from vitrine.session import STATE_STORE, is_done, latest_done, write_once
from vitrine.streaming.ownership import FRONTIER

EVENTS = ("id BIGINT, asset_id BIGINT, collection_id INT, signature STRING, seq INT, slot BIGINT, block_time TIMESTAMP, kind STRING, "
          "from_owner STRING, to_owner STRING")
EVENT_KEY = ["asset_id", "signature", "seq"]
DONE = "arrival BIGINT, opened BOOLEAN, closed BOOLEAN, dirty BOOLEAN, owner STRING, owner_moved BOOLEAN"
APPLIED = f"{EVENTS}, {DONE}"
STANDING = "arrival BIGINT, held_by STRING, since BIGINT, burned BOOLEAN, row_owner STRING, row_slot BIGINT"
HISTORY = "asset_id BIGINT, owner STRING, from_slot BIGINT, from_ts TIMESTAMP, to_slot BIGINT, to_ts TIMESTAMP, opened_by BIGINT, closed_by BIGINT"
REBUILT, REBUILT_BURNED = "#rebuilt", "#rebuilt burned"  # kinds of the rows that a rebuild sends
BUCKETS = 64
SOURCE = "stream"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# -- admission ------------------------------------------------------------------------------
def start_admission(spark: SparkSession, incoming: str, registry: str, out: str, checkpoint: str) -> StreamingQuery:
    """Stream parquet files of EVENTS: those of collections that ``registry`` (parquet: id, enabled) has enabled at the time of
    their batch go to ``out/admitted``, the others to ``out/held``. ``out/registry`` keeps what each batch saw."""
    def admit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        pinned = f"{out}/registry/batch={batch_id}"
        write_once(session.read.parquet(registry).select("id", "enabled"), pinned)
        enabled = session.read.schema("id INT, enabled BOOLEAN").parquet(pinned).where("enabled").select(F.col("id").alias("collection_id"))
        for name, how in (("admitted", "left_semi"), ("held", "left_anti")):
            write_once(batch.join(enabled, "collection_id", how).select(*_names(EVENTS)), f"{out}/{name}/batch={batch_id}")

    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 64).parquet(incoming)
    return rows.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- the keyed state --------------------------------------------------------------------------
class Standing(StatefulProcessor):
    """What an asset holds: who since which slot, whether it is burned, owner and slot of its row, and how many events it has had."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("standing", STANDING)

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        row = initial.astype(object).where(initial.notna(), None).iloc[0]
        self.state.update((0, row["open_owner"], None if row["open_from"] is None else int(row["open_from"]), bool(row["burned"]), row["owner"],
                           None if row["owner_slot"] is None else int(row["owner_slot"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)  # of one asset and micro-batch
        # rebuilt standings come first, then the events by slot and id
        frame = frame.assign(_later=~frame["kind"].str.startswith("#")).sort_values(["_later", "slot", "id"], ignore_index=True).drop(columns="_later")
        frame = frame.astype(object).where(frame.notna(), None)
        state = self.state.get() if self.state.exists() else (0, None, None, False, None, None)
        out = []
        for event in frame.to_dict("records"):
            state, done = after(state, event)
            if done is not None:
                out.append([event[c] for c in _names(EVENTS)] + list(done))
        self.state.update(state)
        yield pd.DataFrame(out, columns=_names(APPLIED)).astype({"arrival": "int64", "slot": "int64"})

    def close(self) -> None:
        pass


def after(state: tuple, event: dict) -> tuple[tuple, tuple | None]:
    """The standing (STANDING) once ``event`` came, and what it did (DONE); a rebuilt standing replaces the interval and does nothing."""
    count, held_by, since, burned, row_owner, row_slot = state
    kind, slot, receiver = event["kind"], event["slot"], event["to_owner"]
    if kind in (REBUILT, REBUILT_BURNED):
        gone = burned or kind == REBUILT_BURNED
        row = (None, None) if gone else (receiver, slot) if receiver is not None and (row_slot is None or slot >= row_slot) else (row_owner, row_slot)
        return (count, receiver, slot if receiver is not None else None, gone, *row), None
    said = (count, False, False, False, None, False)
    count += 1
    if kind not in PUBLIC_KINDS:
        return (count, *state[1:]), said
    continues = held_by is None or (slot >= since and event["from_owner"] in (None, held_by))
    if not continues or (burned and kind != "burn"):
        return (count, *state[1:]), (said[0], False, False, True, None, False)
    if kind == "burn":
        moved, row_owner, row_slot = not burned, None, None
    else:
        moved = receiver is not None and receiver != row_owner and (row_slot is None or slot > row_slot)
        row_owner, row_slot = (receiver, slot) if moved else (row_owner, row_slot)
    done = (said[0], receiver is not None, held_by is not None, False, receiver, moved)
    return (count, receiver, slot if receiver is not None else None, burned or kind == "burn", row_owner, row_slot), done


def bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int")


def start_ownership(spark: SparkSession, out: str, checkpoint: str, frontier: DataFrame | None = None) -> StreamingQuery:
    """Apply what was admitted to ``out``; ``out/applied`` gets every new event with what it did, its ``arrival`` among the asset's
    events and its source. ``frontier`` (FRONTIER) is where assets stand before the first batch.

    Each batch's rows are written under its id in place of an earlier try's; the states of that try are not kept, so it gives the same rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    frontier = spark.createDataFrame([], FRONTIER) if frontier is None else frontier.select(*_names(FRONTIER))

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("source", F.lit(SOURCE)).withColumn("bucket", bucket())
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/applied/batch={batch_id}")

    rows = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 64).parquet(f"{out}/admitted")
    done = rows.dropDuplicates(EVENT_KEY).groupBy("asset_id").transformWithStateInPandas(
        Standing(), outputStructType=APPLIED, outputMode="append", timeMode="none", initialState=frontier.groupBy("asset_id"))
    return done.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- intervals ----------------------------------------------------------------------------------
MANIFEST = "bucket INT, at INT, version INT, covers BIGINT"


def _found(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_applied(spark: SparkSession, out: str) -> DataFrame:
    return _found(spark, f"{out}/applied", f"{APPLIED}, source STRING, batch BIGINT, bucket INT")


def manifest(spark: SparkSession, out: str) -> tuple[int, int, dict[int, int]]:
    """Latest committed version (0: none), the last batch it covers (-1: none), and the version that each bucket is stored in."""
    version = latest_done(spark, f"{out}/versions")
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/versions/n={version}").collect() if version else []  # a row a bucket
    return version, max((r["covers"] for r in rows), default=-1), {r["bucket"]: r["at"] for r in rows if r["bucket"] is not None}


def read_history(spark: SparkSession, out: str) -> DataFrame:
    """The interval table as of the latest committed version."""
    paths = [f"{out}/history/n={at}/bucket={b}" for b, at in manifest(spark, out)[2].items()]
    return spark.read.schema(HISTORY).parquet(*paths) if paths else spark.createDataFrame([], HISTORY)


def dirty_assets(spark: SparkSession, out: str) -> DataFrame:
    """Assets with an event out of order that no committed version covers."""
    covers = manifest(spark, out)[1]
    return read_applied(spark, out).where(F.col("dirty") & (F.col("batch") > covers)).select("asset_id").distinct()


def rebuild_history(spark: SparkSession, out: str, buckets: int = BUCKETS) -> int:
    """Bring the interval table up to all stored events and return its version. Buckets without new events keep their files; the
    version counts once its manifest is written, so a pass that broke off leaves the table as it was."""
    version, covers, stored = manifest(spark, out)
    _send_standings(spark, out, version)  # in case the last pass ended before it had
    applied = read_applied(spark, out)
    fresh = applied.where(F.col("batch") > covers)
    seen = fresh.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # a row a bucket
    if not seen:
        return version
    upto, new = max(r["batch"] for r in seen), version + 1
    events = applied.where(F.col("bucket").isin([r["bucket"] for r in seen]) & (F.col("batch") <= upto))
    path = f"{out}/history/n={new}"
    interval_rebuild(events).select(*_names(HISTORY)).withColumn("bucket", bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    dirty = fresh.where("dirty").select("asset_id").distinct()
    last = events.join(dirty, "asset_id", "left_semi").groupBy("asset_id").agg(F.bool_or(F.col("kind") == "burn").alias("burned"), F.max("slot").alias("slot"))
    last.write.mode("overwrite").parquet(f"{out}/cleaned/n={new}")
    written = {r["bucket"] for r in spark.read.schema(f"{HISTORY}, bucket INT").parquet(path).select("bucket").distinct().collect()}
    now = {b: at for b, at in stored.items() if b not in {r["bucket"] for r in seen}} | {b: new for b in written}
    rows = [(b, at, new, upto) for b, at in now.items()] or [(None, None, new, upto)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/n={new}")
    _send_standings(spark, out, new)
    return new


def _send_standings(spark: SparkSession, out: str, version: int) -> None:
    """Tell the stream where the assets stand that this version cleaned."""
    path = f"{out}/admitted/version={version}"
    if not version or is_done(spark, path):
        return
    cleaned = spark.read.schema("asset_id BIGINT, burned BOOLEAN, slot BIGINT").parquet(f"{out}/cleaned/n={version}")
    held = read_history(spark, out).where("to_slot is null").select("asset_id", "owner", "from_slot")
    rows = cleaned.join(held, "asset_id", "left").select(
        F.lit(0).cast("long").alias("id"), "asset_id", F.lit(None).cast("int").alias("collection_id"), F.lit(f"rebuild {version}").alias("signature"),
        F.lit(0).alias("seq"), F.coalesce("from_slot", "slot").alias("slot"), F.lit(None).cast("timestamp").alias("block_time"),
        F.when(F.col("burned"), REBUILT_BURNED).otherwise(REBUILT).alias("kind"), F.lit(None).cast("string").alias("from_owner"), F.col("owner").alias("to_owner"))
    write_once(rows, path)
