"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: sources share ``share`` times all words by weight; none exceeds ``repeat`` times its own
words, and what one can't take is shared again among the others by weight. A source's documents are
dealt at random into shards of about SHARD_DOCS. Blocks of BLOCK words are then given to the shards
by highest quotients, weight / (2 k + 1) for a shard's k-th block from 0, which fixes an integer quota per shard.
A shard that is due less than one block, or all that repetition allows, gets a quota cut to the word instead.
Within a shard the documents stand in seeded order; its quota is met by whole passes and, for the rest,
blocks of that stream in a seeded order, the last of them cut to fit.

The quotient of the last block given is found by bracketing: each pass sums the blocks that 64
thresholds would give. Only such sums reach the driver, whatever the number of sources or shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.text import WORD
from vitrine.session import write_table

WEIGHTS = (5, 2, 1)
BLOCK = 256
SHARD_DOCS = 20_000
SEED = 29
_PRIMES = (2147483629, 2147483587, 2147483579, 2147483563)  # near 2 ** 31; one doesn't divide a shard's blocks
_THRESHOLDS = 64


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeat: float) -> DataFrame:
    """``sources`` (source, source_size) with weight and target. Sources by code point, NULL last, take the weights in turn."""
    # one row for each source: ranked over ranges of names, so that no task gets all of them
    ranked = write_table(sources.withColumn("null_last", F.col("source").isNull().cast("int"))
                         .repartitionByRange("null_last", "source").withColumn("range", F.spark_partition_id()), "sources")
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("null_last", "source")) - 1 + F.col("before")
    ranked = ranked.join(before, "range").withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("double"))
    ranked = write_table(ranked.select("source", "source_size", "n_docs", "weight"), "weights")
    cap = F.col("source_size") * F.lit(float(repeat))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        over = cap <= F.col("weight") * F.lit(level)
        spent, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_weight:
            break
        higher = (share * total - spent) / open_weight
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def apportion(cells: DataFrame, seats: int, keys: list[str]) -> DataFrame:
    """``cells`` (keys, weight, cap) with ``seats`` given by highest quotients weight / (2 k + 1), a cell at most ``cap``;
    equal quotients go to smaller keys. Given are all seats, or as many as the caps allow."""
    if seats <= 0:
        return cells.withColumn("seats", F.lit(0).cast("long"))

    def given(threshold: float) -> Column:
        wanted = F.floor(F.col("weight") / F.lit(2 * threshold) + F.lit(0.5)).cast("long")
        return F.least(F.col("cap"), wanted)

    room, most = cells.where("weight > 0").agg(F.sum("cap"), F.max("weight")).first()
    seats = min(seats, room or 0)
    if seats <= 0:
        return cells.withColumn("seats", F.lit(0).cast("long"))
    low, high, at_high = most / (4.0 * seats + 4.0), most * 1.001, 0
    while True:
        step = (high / low) ** (1 / _THRESHOLDS)
        grid = [low * step ** i for i in range(_THRESHOLDS)]
        sums = cells.agg(*[F.sum(given(t)) for t in grid]).first()
        enough = [i for i, n in enumerate(sums) if n >= seats]
        if not enough:
            high, at_high, low = low, sums[0], low / 4096
            continue
        best = enough[-1]
        low = grid[best]
        if best + 1 < _THRESHOLDS:
            high, at_high = grid[best + 1], sums[best + 1]
        if high / low < 1 + 1e-11 or sums[best] == seats:
            break
    if sums[best] == seats:
        return cells.withColumn("seats", given(low))
    # what is left lies within the bracket: one more seat at most for a cell
    first = cells.withColumn("seats", given(high))
    last = (first.where((F.col("seats") < F.col("cap")) & (F.col("seats") < given(low)))
            .orderBy(F.desc(F.col("weight") / (2 * F.col("seats") + 1)), *keys).limit(seats - at_high)
            .select(*keys, F.lit(1).cast("long").alias("more")))
    return first.join(last, keys, "left").withColumn("seats", F.col("seats") + F.coalesce("more", F.lit(0))).drop("more")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2, seed: int = SEED,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, version, source, size, source_size, target, passes, slices, taken) for each row: the mix takes the whole
    document ``passes`` times and its words in ``slices`` (start, length) once more, ``taken`` words in all.

    ``version`` is the XXH64 of the text. A NULL text has no words; NULL is a source of its own, the last. Repeated rows each
    count. A source whose documents are all empty has the target 0. Equal rows and seed give the same mix.
    An empty table gives an empty table; extra columns are left out."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = write_table(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = write_table(
        source_targets(sources, weights, share, repeat)
        .withColumn("shards", F.ceil(F.col("n_docs") / F.lit(SHARD_DOCS)).cast("long")), "targets")
    named = targets.withColumnRenamed("source", "of")
    dealt = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of", "n_docs", "weight")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))).withColumn(
        "cell", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard"))
    cells = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), F.max("source_size").alias("all"), F.max("target").alias("target"))
    most = F.col("words") * repeat
    cells = write_table(cells.select(
        "source", "shard", "words", F.when(F.col("all") > 0, F.col("target") * F.col("words") / F.col("all")).otherwise(0.0).alias("weight"),
        F.ceil(most / F.lit(BLOCK)).cast("long").alias("cap")), "cells")
    # a target under one block, or at the cap, is met to the word by a cut block; the others share whole blocks
    exact = (F.col("weight") < BLOCK) | (F.col("weight") > most - 0.5)
    whole = cells.where(~exact)
    total = whole.agg(F.sum("weight")).first()[0] or 0.0
    quotas = (apportion(whole, round(total / BLOCK), ["source", "shard"]).withColumn("quota", F.least(F.col("seats") * BLOCK, most))
              .drop("seats").unionByName(cells.where(exact).withColumn("quota", F.least(F.round("weight").cast("long"), most))))
    quotas = quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "words", "quota")
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    ordered = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    placed = ordered.join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))
    quota = F.col("quota")
    placed = (placed.withColumn("passes", F.when(F.col("words") > 0, F.floor(quota / F.col("words"))).otherwise(0).cast("long"))
              .withColumn("rest", quota - F.col("passes") * F.col("words"))
              .withColumn("blocks", F.ceil(F.col("words") / F.lit(BLOCK)).cast("long"))
              .withColumn("begin", F.col("end") - F.col("size")))
    factor = F.coalesce(*[F.when(F.col("blocks") % p != 0, F.lit(p)) for p in _PRIMES], F.lit(1))
    place = lambda b: F.pmod(b * factor + F.pmod(F.col("cell"), F.lit(1 << 31)), F.col("blocks"))
    short = F.col("words") - (F.col("blocks") - 1) * BLOCK  # words of the last block
    short_place = place(F.col("blocks") - 1)

    def taken_of(b: Column) -> Column:
        """The part of this document in block b that is taken: the block's first words, up to what is still wanted."""
        earlier = place(b) * BLOCK - F.when(short_place < place(b), F.lit(BLOCK) - short).otherwise(0)
        upto = b * BLOCK + F.least(F.lit(BLOCK), F.greatest(F.lit(0), F.col("rest") - earlier))
        start = F.greatest(F.col("begin"), b * BLOCK)
        return F.struct((start - F.col("begin")).cast("long").alias("start"),
                        F.greatest(F.lit(0), F.least(F.col("end"), upto) - start).cast("long").alias("length"))

    touched = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.sequence(
        F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).otherwise(F.array().cast("array<long>"))
    placed = placed.withColumn("slices", F.filter(F.transform(touched, taken_of), lambda s: s["length"] > 0))
    return placed.select(
        "doc_id", "version", "source", "size", "source_size", "target", "passes", "slices",
        (F.col("passes") * F.col("size") + F.aggregate("slices", F.lit(0).cast("long"), lambda n, s: n + s["length"])).alias("taken"))
