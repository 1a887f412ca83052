"""Webhook deliveries as a stream: land, dedupe exactly, keep.

Exactly-once by key comes from a state store of the keys that were seen. Spark's
watermarks are not used here: they drop late rows, and no delivery may be lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators.merge import first_of
from vitrine.session import STATE_STORE, is_done, write_once

ELEMENT = ("transaction STRUCT<signatures: ARRAY<STRING>>, slot BIGINT, blockTime BIGINT, "
           "meta STRUCT<err: STRING>")


def land_deliveries(bodies: DataFrame) -> DataFrame:
    """(body): one JSON array of deliveries, or a single one, per row. Every element becomes a
    row; ``usable`` is false where signature or slot is missing."""
    text = F.trim("body")
    elements = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))),
                           "array<string>")
    parsed = F.from_json("element", ELEMENT)
    rows = bodies.withColumn("element", F.explode(F.coalesce(elements, F.array(text)))).withColumn("e", parsed)
    signature = F.get("e.transaction.signatures", F.lit(0))
    return rows.select(
        *[c for c in bodies.columns if c != "body"], signature.alias("signature"), F.col("e.slot").alias("slot"),
        F.timestamp_seconds("e.blockTime").alias("block_time"), F.col("e.meta.err").isNotNull().alias("failed"),
        F.col("element").alias("body"),
        F.coalesce(signature.isNotNull() & F.col("e.slot").isNotNull(), F.lit(False)).alias("usable"))


def enqueue_dedup(stored: DataFrame, batch: DataFrame, arrival: list[str]) -> DataFrame:
    """New rows of a batch: the first per signature, none that is stored.

    The stored side is only filtered by the batch's signatures, so a small batch does not
    make Spark shuffle the whole inbox."""
    fresh = first_of(batch, ["signature"], arrival)
    known = stored.select("signature").join(fresh.select("signature"), "signature", "left_semi")
    return fresh.join(known, "signature", "left_anti")


LANDED = "signature STRING, slot BIGINT, block_time TIMESTAMP, failed BOOLEAN, body STRING"
INBOX = f"{LANDED}, batch BIGINT"
QUARANTINE = "body STRING, reason STRING, batch BIGINT"
COUNTS = "batch BIGINT, landed BIGINT, usable BIGINT, quarantined BIGINT"


def unusable_reason(body: str = "body") -> Column:
    """Why an element can't be used: it is no JSON, or has no signature, or no slot that is a number."""
    signature = F.get_json_object(body, "$.transaction.signatures[0]")
    return F.when(F.try_parse_json(body).isNull(), "not json").when(signature.isNull(), "no signature").otherwise("no slot")


def start_landing(spark: SparkSession, incoming: str, inbox: str, checkpoint: str) -> StreamingQuery:
    """Stream text files of delivery bodies into ``inbox/landed``; unusable elements go to ``inbox/quarantine`` with the reason.

    Elements are parsed once, into a table of the batch from which both sinks are written; what it counted while it was written goes to ``inbox/counts``, the
    last of the batch's tables. A table that was finished is not written again, so a batch that is run again after a crash
    between two of them adds what is missing: usable + quarantined = landed."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        session, names = batch.sparkSession, [c.split()[0] for c in LANDED.split(", ")]
        parsed, counts = f"{inbox}/parsed/batch={batch_id}", f"{inbox}/counts/batch={batch_id}"
        if is_done(session, counts):
            return
        counted = Observation()
        landed = land_deliveries(batch.select(F.col("value").alias("body")))
        landed.observe(counted, F.count(F.lit(1)).alias("landed"), F.count_if("usable").alias("usable"),
                       F.count_if(~F.col("usable")).alias("quarantined")).write.mode("overwrite").parquet(parsed)
        rows = session.read.schema(landed.schema).parquet(parsed)
        write_once(rows.where("usable").select(*names), f"{inbox}/landed/batch={batch_id}")
        write_once(rows.where(~F.col("usable")).select("body", unusable_reason().alias("reason")), f"{inbox}/quarantine/batch={batch_id}")
        n = counted.get
        session.createDataFrame([(n["landed"], n["usable"], n["quarantined"])], "landed BIGINT, usable BIGINT, quarantined BIGINT").coalesce(
            1).write.mode("overwrite").parquet(counts)

    lines = spark.readStream.format("text").load(incoming)
    return lines.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_inbox(spark: SparkSession, incoming: str, inbox: str, checkpoint: str) -> StreamingQuery:
    """Land what is ``incoming`` and keep one row per signature in ``inbox/rows``.

    The signatures that were seen lie in Spark's state store, so a batch costs what its own rows cost, however much is stored.
    A batch is written under its id in place of an earlier try."""
    start_landing(spark, incoming, inbox, f"{checkpoint}/landing").awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{inbox}/rows/batch={batch_id}")

    rows = spark.readStream.schema(LANDED).option("recursiveFileLookup", "true").parquet(f"{inbox}/landed").dropDuplicates(["signature"])
    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/inbox").trigger(availableNow=True).start()


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_inbox(spark: SparkSession, inbox: str) -> DataFrame:
    return _stored(spark, f"{inbox}/rows", INBOX)


def read_quarantine(spark: SparkSession, inbox: str) -> DataFrame:
    return _stored(spark, f"{inbox}/quarantine", QUARANTINE)


def read_counts(spark: SparkSession, inbox: str) -> DataFrame:
    return _stored(spark, f"{inbox}/counts", COUNTS)
