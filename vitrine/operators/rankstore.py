"""Stored ranks, brought up to date for dirty collections only.

``mark_dirty`` adds a mark for each collection whose ranks went stale; marks are numbered and never changed. ``recompute`` ranks
the collections marked since the last pass, and no others: assets, attributes and stored ranks that are partitioned by collection
are pruned to them at run time. A pass covers all marks up to its number, so one that comes in meanwhile is left for the next.

A pass is written whole before the ranks are touched: what changed is judged against the ranks before it. Then the partitions of
its collections are overwritten, others keep their files, and the commit record comes last. A pass that broke off after it was
written is finished first by the next call, with the same rows; one that broke off earlier is computed again. A reader that comes
while partitions are being overwritten may find some collections new and others old, or one of them missing.

An asset that fell out of its collection keeps a row without a rank there. One that moved needs both collections marked, and counts
as changed in both. NULL collections have no ranks and marks of NULL are passed over. Repeated marks count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.rarity import rarity_rank
from vitrine.session import latest_done, write_once

BY = "collection_id"
RANKS = f"asset_id BIGINT, rarity_score DOUBLE, rarity_rank INT, {BY} INT"
PASS = f"asset_id BIGINT, rarity_score DOUBLE, rarity_rank INT, ranked BOOLEAN, changed BOOLEAN, {BY} INT"
COMMIT = f"{BY} INT, ranked BIGINT, changed BIGINT, n INT"


def write_by_collection(df: DataFrame, path: str, order: str) -> None:
    """Write ``df`` partitioned by collection. Rows are dealt by range of (collection, ``order``), so a huge collection is written
    by many tasks and each task writes few collections."""
    rows = df.repartitionByRange(BY, order).sortWithinPartitions(BY, order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BY).parquet(path)


def mark_dirty(collections: DataFrame, store: str) -> int:
    """Mark the ``collection_id`` values of ``collections`` and return the number of the mark."""
    n = latest_done(collections.sparkSession, f"{store}/marks") + 1
    marks = collections.select(BY).where(F.col(BY).isNotNull()).distinct()
    marks.write.mode("overwrite").parquet(f"{store}/marks/n={n}")
    return n


def _marked(spark: SparkSession, store: str, after: int, upto: int | None = None) -> DataFrame:
    """Collections marked after ``after``."""
    if latest_done(spark, f"{store}/marks") == 0:
        return spark.createDataFrame([], f"{BY} INT")
    marks = spark.read.schema(f"{BY} INT, n INT").parquet(f"{store}/marks").where(F.col("n") > after)
    return (marks if upto is None else marks.where(F.col("n") <= upto)).select(BY).distinct()


def covered(spark: SparkSession, store: str) -> int:
    """The last mark that the stored ranks take in; 0 before the first pass."""
    return latest_done(spark, f"{store}/commits")


def dirty_collections(spark: SparkSession, store: str) -> DataFrame:
    return _marked(spark, store, covered(spark, store))


def stored_ranks(spark: SparkSession, store: str) -> DataFrame:
    """(asset_id, collection_id, rarity_score, rarity_rank) of the ranked assets."""
    if latest_done(spark, f"{store}/passes") == 0:
        return spark.createDataFrame([], RANKS)
    return spark.read.schema(RANKS).parquet(f"{store}/ranks").where(F.col("rarity_rank").isNotNull())


def preview(spark: SparkSession, store: str, assets: DataFrame, attributes: DataFrame, upto: int | None = None) -> DataFrame:
    """What the next pass would write: new score and rank of every asset of a dirty collection that has or had one, and whether it
    changed."""
    dirty = _marked(spark, store, covered(spark, store), upto)

    def of_dirty(df: DataFrame) -> DataFrame:
        return df.join(dirty, BY, "left_semi")

    shown = F.struct("rarity_score", "rarity_rank")
    new = rarity_rank(of_dirty(assets), of_dirty(attributes)).select("asset_id", BY, shown.alias("_new"))
    old = of_dirty(stored_ranks(spark, store)).select("asset_id", BY, shown.alias("_old"))
    return old.join(new, ["asset_id", BY], "full_outer").select(
        "asset_id", "_new.rarity_score", "_new.rarity_rank", F.col("_new").isNotNull().alias("ranked"),
        (~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"), BY)


def _finish(spark: SparkSession, store: str, after: int, n: int) -> None:
    """Put the rows of a written pass in the place of its collections' ranks and commit it."""
    rows = spark.read.schema(PASS).parquet(f"{store}/passes/n={n}")
    write_by_collection(rows.drop("ranked", "changed"), f"{store}/ranks", "asset_id")
    counts = rows.groupBy(BY).agg(F.count_if("ranked").alias("ranked"), F.count_if("changed").alias("changed"))
    marked = _marked(spark, store, after, n).join(counts, BY, "left").na.fill(0, ["ranked", "changed"])
    marked.write.mode("overwrite").parquet(f"{store}/commits/n={n}")


def recompute(spark: SparkSession, store: str, assets: DataFrame, attributes: DataFrame) -> int:
    """Rank the dirty collections and return the last mark covered."""
    last, begun = covered(spark, store), latest_done(spark, f"{store}/passes")
    if begun > last:
        _finish(spark, store, last, begun)
        last = begun
    upto = latest_done(spark, f"{store}/marks")
    if upto > last:
        write_once(preview(spark, store, assets, attributes, upto), f"{store}/passes/n={upto}")
        _finish(spark, store, last, upto)
    return upto


def rank_state(collections: DataFrame, store: str) -> DataFrame:
    """Per collection: whether it is dirty, its version (moved only by a pass that changed something), and how many assets the last
    pass over it ranked and changed."""
    spark = collections.sparkSession
    passes = (spark.read.schema(COMMIT).parquet(f"{store}/commits") if covered(spark, store)
              else spark.createDataFrame([], COMMIT))
    done = passes.groupBy(F.col(BY).alias("id")).agg(
        F.max_by("ranked", "n").alias("ranked"), F.max_by("changed", "n").alias("changed"),
        F.count_if(F.col("changed") > 0).cast("int").alias("_moves"))
    marks = dirty_collections(spark, store).select(F.col(BY).alias("id"), F.lit(True).alias("_marked"))
    return collections.join(done, "id", "left").join(marks, "id", "left").select(
        F.col("id").alias(BY), F.col("_marked").isNotNull().alias("rarity_dirty"),
        (F.col("rarity_version") + F.coalesce("_moves", F.lit(0))).alias("rarity_version"),
        F.coalesce("ranked", F.lit(0)).alias("ranked"), F.coalesce("changed", F.lit(0)).alias("changed"))
