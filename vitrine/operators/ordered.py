"""Ordered per-key computations that stay parallel when one key is huge.

A window partitioned by a key sends all rows of that key to one task. ``scan`` keeps
that plan while every key is small enough to be one task's work, and computes hot keys
over range-partitioned blocks instead: each block is scanned on its own, the blocks are
summarised, and the summaries (one row per block and key) carry the state across.
Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vitrine.session import durable

HOT_ROWS_CONF = "vitrine.scan.hotRows"
HOT_ROWS = 2_000_000
# Hot keys are broadcast up to this many; there are under 1/HOT_ROWS as many of them as rows.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Step:
    """One scan: inside a block, as the block's summary, across blocks, and combined."""

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    across: Callable[[Column, WindowSpec], Column]
    combine: Callable[[Column, Column], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def row_number() -> Step:
    return Step(
        lambda w: F.row_number().over(w).cast("long"),
        lambda o: F.count(F.lit(1)),
        lambda s, w: F.sum(s).over(_before(w)),
        lambda here, carried: here + F.coalesce(carried, F.lit(0)),
    )


def running_sum(value: Column) -> Step:
    return Step(
        lambda w: F.sum(value).over(_upto(w)),
        lambda o: F.sum(value),
        lambda s, w: F.sum(s).over(_before(w)),
        lambda here, carried: F.coalesce(here + carried, here, carried),
    )


def max_before(value: Column) -> Step:
    return Step(
        lambda w: F.max(value).over(_before(w)),
        lambda o: F.max(value),
        lambda s, w: F.max(s).over(_before(w)),
        lambda here, carried: F.greatest(here, carried),
    )


def last_before(value: Column) -> Step:
    """Last non-NULL value of the earlier rows."""
    return Step(
        lambda w: F.last(value, ignorenulls=True).over(_before(w)),
        lambda o: F.max_by(value, F.when(value.isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda here, carried: F.coalesce(here, carried),
    )


def lag(value: Column) -> Step:
    """Value of the previous row. Wrapped, so that a NULL value is told from no row."""
    cell = F.struct(value.alias("v"))
    return Step(
        lambda w: F.lag(cell).over(w),
        lambda o: F.max_by(cell, o),
        lambda s, w: F.lag(s).over(w),
        lambda here, carried: F.coalesce(here, carried)["v"],
    )


def lead(value: Column) -> Step:
    """Value of the next row."""
    cell = F.struct(value.alias("v"))
    return Step(
        lambda w: F.lead(cell).over(w),
        lambda o: F.min_by(cell, o),
        lambda s, w: F.lead(s).over(w),
        lambda here, carried: F.coalesce(here, carried)["v"],
    )


def key_sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def scan(df: DataFrame, by: list[str], order: list[str], steps: dict[str, Step],
         hot_rows: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Add one column per step, computed over the rows of each ``by`` key in ``order``.

    ``order`` names columns, ascending, without NULLs and without ties inside a key.
    ``sizes``: (by, _n), at least the rows of each key, where that is cheaper to learn than
    by counting ``df``."""
    limit = hot_rows or int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))
    if sizes is None:
        sizes = key_sizes(df, by)
    total, n_hot = sizes.agg(F.sum("_n"), F.count_if(F.col("_n") > limit)).first()
    if not n_hot:
        return _plain(df, by, order, steps)
    hot = sizes.where(F.col("_n") > limit).select(*by)
    if n_hot <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold_rows = df.join(hot, by, "left_anti")
    hot_rows_df = df.join(hot, by, "left_semi")
    parts = max(2, min(total // limit + 1, 100_000), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _plain(cold_rows, by, order, steps).unionByName(_blocked(hot_rows_df, by, order, steps, parts))


def _plain(df: DataFrame, by: list[str], order: list[str], steps: dict[str, Step]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    none = {name: F.lit(None) for name in steps}
    out = df.select("*", *[step.local(w).alias(name) for name, step in steps.items()])
    # lag and lead wrap their value; combining with nothing carried unwraps it
    return out.select(*df.columns, *[
        step.combine(F.col(name), none[name]).alias(name) for name, step in steps.items()])


def _blocked(df: DataFrame, by: list[str], order: list[str], steps: dict[str, Step], parts: int) -> DataFrame:
    keys = ["_block", *by]
    blocks = durable(df.repartitionByRange(parts, *by, *order).withColumn("_block", F.spark_partition_id()))
    position = F.struct(*order)
    carried = blocks.groupBy(*keys).agg(*[s.summary(position).alias(n) for n, s in steps.items()])
    across = Window.partitionBy(*by).orderBy("_block")
    carried = carried.select(*keys, *[s.across(F.col(n), across).alias("_c_" + n) for n, s in steps.items()])
    w = Window.partitionBy(*keys).orderBy(*order)
    here = blocks.select("*", *[s.local(w).alias(n) for n, s in steps.items()])
    joined = here.join(carried, keys)
    return joined.select(*df.columns, *[
        s.combine(F.col(n), F.col("_c_" + n)).alias(n) for n, s in steps.items()])


def number_rows(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """``df`` with ``name``: after + 1, after + 2 ... in ``order``, which has no ties, so the same rows get the same numbers.

    Rows are numbered within range-partitioned blocks; a row per block carries the counts across."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = durable(df.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id()))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("_block").count().select("_block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return blocks.join(F.broadcast(counts), "_block").withColumn(name, place + F.col("_before") + F.lit(after).cast("long")).drop("_block", "_before")
