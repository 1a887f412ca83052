"""Ranks recomputed for dirty collections only, against full passes; tables that are joined by asset without an exchange."""

import glob
import os
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.operators import facets, rankstore
from vitrine.session import write_bucketed

ASSETS = "id long, collection_id int, membership_status string"
TRAITS = "asset_id long, collection_id int, trait_type string, value string, is_facet boolean"


class Store:
    def __init__(self, spark, folder):
        self.spark, self.path, self.assets, self.traits = spark, f"{folder}/store", [], []

    def frames(self):
        return self.spark.createDataFrame(self.assets, ASSETS), self.spark.createDataFrame(self.traits, TRAITS)

    def fill(self, collections=4, size=12):
        for i in range(collections * size):
            c = i % collections
            self.assets.append((i, c, "member"))
            self.traits.append((i, c, "Kind", f"k{i * i % 5}", True))
            if i % 3:
                self.traits.append((i, c, "Hue", f"h{i % 4}", True))

    def mark(self, *collections):
        return rankstore.mark_dirty(self.spark.createDataFrame([(c,) for c in collections], "collection_id int"), self.path)

    def recompute(self):
        return rankstore.recompute(self.spark, self.path, *self.frames())

    def ranks(self):
        rows = rankstore.stored_ranks(self.spark, self.path).select("asset_id", "collection_id", "rarity_score", "rarity_rank")
        return sorted(map(tuple, rows.collect()))

    def full(self):
        """Ranks of all collections, by hand. A fixture asset has at most one value of a type."""
        out = []
        for c in {c for _, c, _ in self.assets}:
            members = [i for i, home, status in self.assets if home == c and status == "member"]
            values = {(i, t): v for i, home, t, v, _ in self.traits if i in members}
            types = {t for _, home, t, _, _ in self.traits if home == c}
            carriers = Counter((t, values.get((i, t))) for i in members for t in types)
            worth = {cell: (Decimal(len(members)) / n).quantize(Decimal("1e-12"), ROUND_HALF_UP) for cell, n in carriers.items()}
            scores = {i: sum(worth[t, values.get((i, t))] for t in types).quantize(Decimal("1e-6"), ROUND_HALF_UP) for i in members}
            ranked = sorted(members, key=lambda i: (-scores[i], i))
            out += [(i, c, float(scores[i]), rank) for rank, i in enumerate(ranked, 1)]
        return sorted(out)

    def state(self, ids=(0, 1, 2, 3)):
        registry = self.spark.createDataFrame([(c, 10) for c in ids], "id int, rarity_version int")
        rows = rankstore.rank_state(registry, self.path).collect()
        return {r["collection_id"]: (r["rarity_dirty"], r["rarity_version"], r["ranked"], r["changed"]) for r in rows}

    def files(self):
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{self.path}/ranks/collection_id=*/*.parquet")}

    def drop(self, asset):
        self.assets = [(i, c, "removed" if i == asset else s) for i, c, s in self.assets]

    def move(self, asset, to):
        self.assets = [(i, to if i == asset else c, s) for i, c, s in self.assets]
        self.traits = [(i, to if i == asset else c, *rest) for i, c, *rest in self.traits]


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, tmp_path)
    out.fill()
    return out


def test_before_any_pass(store):
    assert store.ranks() == [] and store.recompute() == 0 and store.state() == {c: (False, 10, 0, 0) for c in range(4)}


def test_only_dirty_collections_are_written(store):
    store.mark(0, 1, 2, 3, None, 3)
    assert store.state()[0][0] and store.recompute() == 1
    assert store.ranks() == store.full() and store.state() == {c: (False, 11, 12, 12) for c in range(4)}
    before = store.files()
    store.drop(5)  # of collection 1
    store.mark(1, 2)
    assert [store.state()[c][0] for c in range(4)] == [False, True, True, False]
    assert store.recompute() == 2 and store.ranks() == store.full()
    after = store.files()
    for c, kept in ((0, True), (1, False), (2, False), (3, True)):
        mine = [{f: t for f, t in files.items() if f"collection_id={c}/" in f} for files in (before, after)]
        assert (mine[0] == mine[1]) == kept
    state = store.state()
    assert state[1][1:3] == (12, 11) and state[1][3] > 0 and state[2] == (False, 11, 12, 0)  # nothing changed: no new version
    assert store.recompute() == 2 and store.files() == after  # nothing marked


def test_pruned_to_dirty_collections(spark, store):
    store.mark(0, 1, 2, 3)
    store.recompute()
    frames = [rankstore.write_by_collection(df, f"{store.path}/{n}", k) or spark.read.parquet(f"{store.path}/{n}")
              for df, n, k in zip(store.frames(), ("assets", "traits"), ("id", "asset_id"))]
    store.mark(2)
    shown = rankstore.preview(spark, store.path, *frames)
    assert {tuple(r) for r in shown.select("collection_id", "ranked", "changed").collect()} == {(2, True, False)}
    plan = rankstore.stored_ranks(spark, store.path).join(rankstore.dirty_collections(spark, store.path), "collection_id", "left_semi")
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString()


def test_moves_and_emptied_collections(store):
    store.mark(0, 1, 2, 3)
    store.recompute()
    for asset in [i for i, c, _ in store.assets if c == 3]:
        store.move(asset, 0)
    store.drop(4)
    store.mark(0, 3)
    store.mark(3)
    assert store.recompute() == 3 and store.ranks() == store.full()
    assert store.state()[3] == (False, 12, 0, 12) and store.state()[0][2] == 23
    store.mark(7)  # a collection without assets
    assert store.recompute() == 4 and store.ranks() == store.full() and store.state((7,)) == {7: (False, 10, 0, 0)}


@pytest.mark.parametrize("at", ["write_by_collection", "commit"])
def test_pass_that_broke_off(store, monkeypatch, at):
    store.mark(0, 1, 2, 3)
    store.recompute()
    store.drop(6)
    store.mark(2)
    whole = rankstore.write_by_collection

    def broken(df, path, order):
        if at == "commit":
            whole(df, path, order)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(rankstore, "write_by_collection", broken)
    with pytest.raises(RuntimeError):
        store.recompute()
    monkeypatch.setattr(rankstore, "write_by_collection", whole)
    store.drop(7)  # of collection 3, marked while the pass lay open
    store.mark(3)
    assert store.state()[2][0] and store.recompute() == 3 and store.ranks() == store.full()
    # what changed was judged once, before the partition was overwritten
    assert store.state()[2][:3] == (False, 12, 11) and store.state()[2][3] > 0 and store.state()[0] == (False, 11, 12, 12)


def test_facets_of_bucketed_tables_need_no_exchange_by_asset(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assets, traits = store.frames()
        shown = assets.withColumns({"address": F.lit(""), "name": F.lit(""), "number": F.lit(1)})
        tables = write_bucketed(shown, "facet_assets", "id", 8), write_bucketed(traits, "facet_traits", "asset_id", 8)
        for chosen in ({}, {"Kind": ["k1", "k4"]}, {"Kind": ["k1", "k4"], "Hue": ["h1"]}):
            out = facets.facet_disjunctive(*tables, chosen)
            assert sorted(out.collect()) == sorted(facets.facet_disjunctive(shown, traits, chosen).collect())
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"collection_id"} and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
