"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins; hubs are combined before the shuffle and their
rows of a join can be split by adaptive execution, as each key has one partner row. Rounds end
when the edges no longer change: then every node points to the smallest node of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import write_table


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for each node of ``edges`` that isn't the smallest of its component.

    Loops, repeated and reversed edges do no harm; an edge with a NULL end is no edge. An empty
    table gives an empty table."""
    def oriented(df: DataFrame) -> DataFrame:
        return (df.where(F.col("a") != F.col("b"))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = write_table(df, "edges")
        mark = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, tuple(mark)

    edges, mark = stored(oriented(edges.select(F.col(u).alias("a"), F.col(v).alias("b"))))
    while mark[0]:
        near = (edges.select(F.col("a").alias("n"), F.col("b").alias("o"))
                .union(edges.select(F.col("b").alias("n"), F.col("a").alias("o")))
                .groupBy("n").agg(F.min("o").alias("m")).where(F.col("m") < F.col("n")))
        large = (edges.join(near, edges["a"] == near["n"], "left")
                 .select(F.coalesce("m", "a").alias("a"), "b"))
        lowest = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = (large.join(lowest, large["b"] == lowest["n"])
                 .select(F.explode(F.array(
                     F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                     F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
                 .select("e.a", "e.b"))
        before = mark
        edges, mark = stored(oriented(small))
        if mark == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
