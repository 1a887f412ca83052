"""Chains of events that follow from one another, in order of arrival.

Whether an event is taken depends on the state that the last taken one left, and that state depends on this one event alone. So
every event has one successor, should it be taken itself: the first later event that fits what it leaves. A chain starts from
a key's start row, and what is taken are the rows met by following successors.

Rows are range-partitioned into blocks by (key, arrival). Within a block successors are looked up in tables of maxima over powers
of two, and chains are followed by doubling the pointers; nothing is done row by row. A key that fills several blocks is joined
together by its exits, the last rows that chains through a block end at: each exit points to the exit that it leads to in a later
block, and those pointers are doubled in turn. So a key that holds a third of all rows is the work of many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import durable, write_table

BLOCK_ROWS = 200_000
LOWEST = np.iinfo(np.int64).min
STEP = "asset_id long, arrival long, start boolean, slot long, sender string, receiver string, burn boolean"
STATE = "owner string, since long, burned boolean"
TAKEN = "taken boolean, was_open boolean"


class Runs:
    """Rows in groups, ordered by position; finds a group's first row after a position whose value is at least a given one."""

    def __init__(self, group: np.ndarray, position: np.ndarray, value: np.ndarray, rows: int) -> None:
        self.span = rows + 1
        at = group * self.span + position
        order = np.argsort(at)
        self.at, self.position = at[order], position[order]
        self.tables = [value[order]]
        while 2 << (len(self.tables) - 1) <= len(order):
            half, low = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.maximum(low[:-half], low[half:]))

    def fits(self, level: int, at: np.ndarray, least: np.ndarray, other: np.ndarray | None) -> np.ndarray:
        return self.tables[level][at] >= least

    def first(self, group: np.ndarray, after: np.ndarray, least: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """Positions, or ``rows`` where there is none."""
        at = np.searchsorted(self.at, group * self.span + after, "right")
        stop = np.searchsorted(self.at, (group + 1) * self.span)
        for level in range(len(self.tables) - 1, -1, -1):
            here = np.flatnonzero(at + (1 << level) <= stop)
            skip = here[~self.fits(level, at[here], least[here], None if other is None else other[here])]
            at[skip] += 1 << level
        out = np.full(len(at), self.span - 1)
        found = at < stop
        out[found] = self.position[at[found]]
        return out


class OwnedRuns(Runs):
    """Runs whose rows have owners; only rows of another owner than the asked one fit."""

    def __init__(self, group: np.ndarray, position: np.ndarray, value: np.ndarray, rows: int, owner: np.ndarray) -> None:
        super().__init__(group, position, value, rows)
        order = np.argsort(group * self.span + position)
        # of each stretch: the largest value, its owner, and the largest value of any other owner
        self.levels = [(self.tables[0], owner[order], np.full(len(order), LOWEST))]
        for level in range(1, len(self.tables)):
            half = 1 << (level - 1)
            (a, x, c), (b, y, d) = (tuple(t[:-half] for t in self.levels[-1]), tuple(t[half:] for t in self.levels[-1]))
            left = a >= b
            self.levels.append((np.where(left, a, b), np.where(left, x, y),
                                np.maximum(np.where(left, c, d), np.where(x == y, np.where(left, d, c), np.where(left, b, a)))))

    def fits(self, level: int, at: np.ndarray, least: np.ndarray, other: np.ndarray | None) -> np.ndarray:
        most, owner, second = (t[at] for t in self.levels[level])
        return np.where(owner != other, most, second) >= least


class Follow:
    """An event continues the open interval: not before it began, and from its owner where a sender is known. Nothing but a burn
    follows a burn; after an interval was closed and none opened, anything follows."""

    def __init__(self, asset, slot, sender, receiver, burn, start) -> None:
        n = self.n = len(asset)
        self.codes = int(max(sender.max(initial=-1), receiver.max(initial=-1))) + 2
        row = np.arange(n)
        self.runs = {}
        for only_burns in (False, True):
            use = ~start & (burn if only_burns else True)
            named = use & (sender >= 0)
            self.runs[only_burns] = (
                Runs((asset * self.codes + sender)[named], row[named], slot[named], n),
                Runs(asset[use & ~named], row[use & ~named], slot[use & ~named], n), Runs(asset[use], row[use], slot[use], n))

    def successor(self, after, asset, owner, since, opened, burned) -> np.ndarray:
        out = np.full(len(after), self.n)
        for only_burns, (named, unnamed, every) in self.runs.items():
            here = np.flatnonzero(opened & (burned == only_burns))
            ask = after[here], since[here]
            out[here] = np.minimum(unnamed.first(asset[here], *ask), named.first(asset[here] * self.codes + owner[here], *ask))
            here = np.flatnonzero(~opened & (burned == only_burns))
            out[here] = every.first(asset[here], after[here], np.full(len(here), LOWEST))
        return out


class Move:
    """An event moves the row: it names another owner, at a later slot than the row's."""

    def __init__(self, asset, slot, sender, receiver, burn, start) -> None:
        self.n, use, row = len(asset), ~start, np.arange(len(asset))
        self.runs = OwnedRuns(asset[use], row[use], slot[use], self.n, receiver[use])

    def successor(self, after, asset, owner, since, opened, burned) -> np.ndarray:
        return self.runs.first(asset, after, np.where(opened, since + 1, LOWEST + 1), owner)


RULES = {"follow": Follow, "move": Move}


class Block:
    """The rows of one block, sorted by asset and arrival, with each row's successor in the block (``n`` if none)."""

    def __init__(self, rows: pd.DataFrame, rule: str, entries: pd.DataFrame | None = None) -> None:
        rows = rows.sort_values(["asset_id", "arrival"], ignore_index=True)
        self.rows, self.n = rows, len(rows)
        self.asset = np.unique(rows["asset_id"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        names = [rows["sender"], rows["receiver"], *([] if entries is None else [entries["owner"]])]
        codes = pd.factorize(pd.concat(names, ignore_index=True))[0].astype(np.int64)
        self.sender, self.receiver = codes[: self.n], codes[self.n: 2 * self.n]
        self.entry_owner = codes[2 * self.n:]
        self.has_slot = rows["slot"].notna().to_numpy()
        self.slot = rows["slot"].fillna(0).to_numpy().astype(np.int64)
        self.burn, self.start = rows["burn"].to_numpy(bool), rows["start"].to_numpy(bool)
        self.rule = RULES[rule](self.asset, self.slot, self.sender, self.receiver, self.burn, self.start)
        # a move leaves its owner and slot; an event leaves an interval only if it has a receiver
        self.opened = self.has_slot & ((self.receiver >= 0) | (rule == "move"))
        self.next = self.rule.successor(np.arange(self.n), self.asset, self.receiver, self.slot, self.opened, self.burn)

    def entered(self, entries: pd.DataFrame) -> np.ndarray:
        """The first row that each of ``entries`` (asset_id and state) leads to."""
        known = np.unique(self.rows["asset_id"].to_numpy())
        asset = np.searchsorted(known, entries["asset_id"].to_numpy())
        opened = entries["since"].notna().to_numpy()
        since = entries["since"].fillna(0).to_numpy().astype(np.int64)
        return self.rule.successor(np.full(len(entries), -1), asset, self.entry_owner, since, opened, entries["burned"].to_numpy(bool))

    def jumps(self) -> list[np.ndarray]:
        """Successors after 1, 2, 4 ... steps; row n stands for the end."""
        out = [np.append(self.next, self.n)]
        while (out[-1] < self.n).any():
            out.append(out[-1][out[-1]])
        return out

    def taken(self, first: np.ndarray) -> np.ndarray:
        """Marks of all rows on the chains from the rows ``first``."""
        mark = np.zeros(self.n + 1, bool)
        mark[first] = True
        for jump in reversed(self.jumps()):
            mark[jump[np.flatnonzero(mark)]] = True
        return mark[: self.n]

    def last(self) -> np.ndarray:
        """The row that the chain from each row ends at."""
        end = np.where(self.next < self.n, self.next, np.arange(self.n))
        while True:
            further = end[end]
            if (further == end).all():
                return end
            end = further


def _whole(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [f for f in frames if len(f)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _state(block: Block, at: np.ndarray) -> pd.DataFrame:
    rows = block.rows.iloc[at]
    return pd.DataFrame({"owner": rows["receiver"].to_numpy(object), "since": pd.array(np.where(block.opened[at], block.slot[at], 0), "Int64"),
                         "burned": block.burn[at]}).assign(since=lambda f: f["since"].mask(~block.opened[at]))


EXIT = f"asset_id long, block int, arrival long, known boolean, {STATE}"


def _exits(rule: str):
    """Exits of each block's last asset, the only one that may go on in the next. ``known``: the asset starts here, so this is the true one.
    A row with a NULL arrival says that the block's first asset began earlier."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(frames)
        if rows is None:
            return
        block, number = Block(rows, rule), int(rows["block"].iloc[0])
        ids, last = block.rows["asset_id"].to_numpy(), block.last()
        out = []
        if not block.start[0]:
            out.append(pd.DataFrame({"asset_id": [ids[0]], "block": [number], "arrival": [None], "known": [False], "owner": [None], "since": [None], "burned": [False]}))
        own = np.flatnonzero(block.asset == block.asset[-1])
        known = bool(block.start[own[0]])
        ends = np.unique(last[own[:1] if known else own])
        arrival = pd.array(block.rows["arrival"].to_numpy()[ends], "Int64")
        out.append(pd.DataFrame({"asset_id": ids[-1], "block": number, "arrival": arrival, "known": known}, index=range(len(ends))).join(_state(block, ends)))
        yield pd.concat(out, ignore_index=True).astype({"arrival": "Int64", "since": "Int64"})
    return run


POINTER = "asset_id long, block int, arrival long, to_block int, to_arrival long"


def _lead(rule: str):
    """(asset_id, block, arrival) of exits to the exit that each leads to in the block it meets; no row where nothing there fits."""
    def run(key: tuple, exits: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in POINTER.split(", ")})
        if not len(exits) or not len(rows):
            return empty
        exits = exits.reset_index(drop=True)
        block = Block(rows, rule, exits)
        first = block.entered(exits)
        found = first < block.n
        if not found.any():
            return empty
        end = block.last()[first[found]]
        out = exits.loc[found, ["asset_id", "block", "arrival"]].reset_index(drop=True)
        return out.assign(to_block=int(key[0]), to_arrival=block.rows["arrival"].to_numpy()[end].astype(np.int64))
    return run


def _entries(blocks: DataFrame, rule: str) -> DataFrame:
    """(asset_id, block, state): where an asset goes on from an earlier block, the state it comes with."""
    exits = write_table(blocks.mapInPandas(_exits(rule), EXIT), "exits")
    goes_on = exits.where("arrival is null and not known").select("asset_id", "block")
    if goes_on.isEmpty():
        return goes_on.join(exits.limit(0).select("asset_id", *_names(STATE)), "asset_id")
    goes_on = write_table(goes_on, "goes_on")
    exits = exits.where("arrival is not null").join(goes_on.select("asset_id").distinct(), "asset_id", "left_semi")
    rows = write_table(blocks.join(goes_on, ["asset_id", "block"], "left_semi"), "spanning")
    met = exits.withColumn("met", F.col("block") + 1)
    pointers = write_table(_meet(met, rows, rule), "pointers")
    stale = exits.join(pointers.select("asset_id", "arrival"), ["asset_id", "arrival"], "left_anti")
    later = goes_on.select("asset_id", F.col("block").alias("met"))
    stale = stale.join(later, "asset_id").where("met > block + 1")
    if not stale.isEmpty():
        nearest = F.min(F.struct("to_block", "to_arrival")).alias("to")
        more = _meet(stale, rows, rule).groupBy("asset_id", "block", "arrival").agg(nearest).select("asset_id", "block", "arrival", "to.*")
        pointers = write_table(pointers.unionByName(more), "pointers")
    reached = write_table(exits.where("known").select("asset_id", "block", "arrival"), "reached")
    jumps, jump = [], pointers.select("asset_id", "arrival", "to_block", "to_arrival")
    while not jump.isEmpty():
        jumps.append(jump)
        on = jump.select("asset_id", F.col("arrival").alias("to_arrival"), F.col("to_block").alias("b"), F.col("to_arrival").alias("a"))
        jump = write_table(jump.join(on, ["asset_id", "to_arrival"]).select(
            "asset_id", "arrival", F.col("b").alias("to_block"), F.col("a").alias("to_arrival")), "jump")
    for jump in reversed(jumps):
        ahead = reached.join(jump, ["asset_id", "arrival"]).select("asset_id", F.col("to_block").alias("block"), F.col("to_arrival").alias("arrival"))
        reached = write_table(reached.union(ahead).distinct(), "reached")
    states = reached.join(exits, ["asset_id", "block", "arrival"]).select("asset_id", "block", F.struct(*_names(STATE)).alias("state"))
    seen = goes_on.withColumn("asks", F.lit(True)).unionByName(states.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("asset_id").orderBy("block", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    return seen.withColumn("s", F.last("state", ignorenulls=True).over(before)).where("asks").select("asset_id", "block", "s.*")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _meet(exits: DataFrame, rows: DataFrame, rule: str) -> DataFrame:
    return exits.groupBy("met").cogroup(rows.groupBy("block")).applyInPandas(_lead(rule), POINTER)


def _marks(rule: str, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(frames)
        if rows is None:
            return
        goes_on = rows[rows["entered"].notna()].iloc[:1]  # one asset of a block at most came from before
        entries = goes_on.assign(owner=goes_on["e_owner"], since=goes_on["e_since"], burned=goes_on["e_burned"].fillna(False).astype(bool))
        block = Block(rows, rule, entries)
        first = np.concatenate([np.flatnonzero(block.start), block.entered(entries)]).astype(np.int64)
        taken = block.taken(first)
        before = np.zeros(block.n + 1, bool)
        on = np.flatnonzero(taken)
        before[block.next[on]] = block.opened[on]
        if len(entries):
            before[block.entered(entries)] = entries["since"].notna().to_numpy()
        yield block.rows[columns].assign(taken=taken, was_open=before[: block.n] & taken)[~block.start]
    return run


def follow(steps: DataFrame, rule: str = "follow", block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(asset_id, arrival, taken, was_open) of the rows of ``steps`` (STEP) that are no start rows, with the columns ``keep`` of theirs, so
    that they need not be joined to again. ``was_open``: whether the state that a taken row met had an interval.

    Every asset needs one start row: its slot is NULL where nothing is open, its arrival is -1. Other arrivals are not negative and
    differ within an asset; slots of other rows are not NULL. Under ``move`` the rows taken are those that change an
    asset's row, of which the start row gives owner and slot; all other rows need a receiver."""
    parts = max(steps.count() // block_rows + 1, 1)
    blocks = durable(steps.repartitionByRange(parts, "asset_id", "arrival").withColumn("block", F.spark_partition_id()))
    entries = _entries(blocks, rule).select("asset_id", "block", F.lit(True).alias("entered"), *[F.col(c).alias("e_" + c) for c in _names(STATE)])
    entries = write_table(entries, "entries")  # a row for a block at most
    columns = ["asset_id", "arrival", *keep]
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in columns)
    return blocks.join(F.broadcast(entries), ["asset_id", "block"], "left").mapInPandas(_marks(rule, columns), f"{kinds}, {TAKEN}")
