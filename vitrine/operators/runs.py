"""Run logs, stream positions, delivery health and the delivery watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordered import running_sum, scan

MAX_ATTEMPTS = 10


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def coverage(events: DataFrame, deliveries: DataFrame, as_of: str, window: str) -> DataFrame:
    """Live events no delivery carried, events the webhook wrote, and deliveries still pending.

    ``window``: an interval text such as ``7 DAYS``."""
    recent = events.where(F.col("block_time") > _at(as_of) - F.expr(f"INTERVAL {window}"))
    missed = delivered_anti(recent.where(F.col("source") == "live"), deliveries)
    rows = [
        missed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("missed_by_webhook").alias("metric"), "n"),
        recent.agg(F.count_if(F.col("source") == "webhook").alias("n")).select(
            F.lit("written_by_webhook").alias("metric"), "n"),
        deliveries.agg(F.count_if(F.col("processed_at").isNull()).alias("n")).select(
            F.lit("pending").alias("metric"), "n"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def delivered_anti(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Events whose signature was never delivered."""
    return events.join(deliveries.select("signature"), "signature", "left_anti")


def delivery_health(deliveries: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    waiting = F.col("processed_at").isNull()
    return deliveries.agg(
        F.count_if(waiting & (F.col("attempts") < max_attempts)).alias("pending"),
        F.count_if(waiting & (F.col("attempts") >= max_attempts)).alias("gave_up"))


def watermark(deliveries: DataFrame, as_of: str, grace_seconds: int) -> DataFrame:
    """Highest slot below which nothing is owed: one below the lowest pending slot, and no
    higher than the highest slot processed before the grace period. NULL says nothing."""
    settled = F.col("processed_at") < _at(as_of) - F.make_interval(secs=F.lit(grace_seconds))
    lowest = F.min(F.when(F.col("processed_at").isNull(), F.col("slot"))) - 1
    return deliveries.agg(F.least(lowest, F.max(F.when(settled, F.col("slot")))).alias("watermark"))


def stream_health(checkpoints: DataFrame, as_of: str, wedged_seconds: int) -> DataFrame:
    """Per stream its last slot and the age of its last checkpoint."""
    latest = checkpoints.groupBy("stream").agg(F.max("slot").alias("last_slot"), F.max("updated_at").alias("updated_at"))
    age = F.unix_timestamp(_at(as_of)) - F.unix_timestamp("updated_at")
    return latest.select("stream", "last_slot", age.alias("age_seconds"), (age > wedged_seconds).alias("wedged"))


def run_totals(runs: DataFrame, counters: list[str]) -> DataFrame:
    """Counters per collection and kind over all runs, and their sum: the corrections made."""
    value = {c: F.coalesce(F.get_json_object("progress", f"$.{c}").cast("long"), F.lit(0)) for c in counters}
    total = sum(value.values(), F.lit(0))
    return runs.groupBy("collection_id", "kind").agg(
        F.count(F.lit(1)).alias("runs"), *[F.sum(v).alias(c) for c, v in value.items()],
        F.sum(total).alias("corrections"))


def last_finished(collections: DataFrame, latest: DataFrame, kind: str) -> DataFrame:
    """Earliest last finish of ``kind`` among the enabled collections; those that never
    finished one are passed over."""
    ended = latest.where(F.col("kind") == kind).select(F.col("collection_id").alias("id"), "finished_at")
    return collections.where("enabled").join(ended, "id", "left").agg(F.min("finished_at").alias("last_finished"))


def backfilled_slot(runs: DataFrame) -> DataFrame:
    slot = F.get_json_object("progress", "$.slot").cast("long")
    return runs.where(F.col("kind") == "assets").agg(F.max(slot).alias("slot"))


def latency_percentiles(samples: DataFrame, by: str, ms: str) -> DataFrame:
    """Nearest-rank p50 and p95 per group, without interpolation.

    Only the histogram of distinct values is ordered, never the samples."""
    histogram = samples.groupBy(by, ms).agg(F.count(F.lit(1)).alias("n"))
    upto = scan(histogram, [by], [ms], {"upto": running_sum(F.col("n"))})
    sizes = histogram.groupBy(by).agg(F.sum("n").alias("total"))
    before = F.col("upto") - F.col("n")

    def at(share: int) -> Column:
        place = F.expr(f"total * {share} div 100")
        return F.max(F.when((before <= place) & (place < F.col("upto")), F.col(ms)))

    return upto.join(sizes, by).groupBy(by).agg(
        F.sum("n").alias("samples"), at(50).alias("p50"), at(95).alias("p95"))
