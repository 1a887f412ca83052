"""Worked cases with known answers."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions.base58 import decode
from vitrine.functions.scalar import token_number
from vitrine.operators import browse, classify, facets, intervals, merge, predicates, rarity, reconcile, runs, stats
from vitrine.plans.ledger import facts as ledger_facts  # noqa: F401  (import checks the plan module)

EVENT = "id BIGINT, asset_id BIGINT, collection_id INT, signature STRING, seq INT, slot BIGINT, block_time TIMESTAMP, kind STRING, from_owner STRING, to_owner STRING"


def key(i):
    return "1" * 31 + "ABCDEFGHJKLMNPQRSTUVWXYZ"[i]


def events(spark, rows):
    """(slot, kind, from, to) of asset 1, ids in the order given."""
    data = [(i + 1, 1, 1, f"s{i}", 0, slot, None, kind, a, b) for i, (slot, kind, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, EVENT)


def spans(df):
    return sorted((r.from_slot, r.to_slot, r.owner) for r in df.collect())


def test_token_number(spark):
    cases = {"#7687": 7687, "Red Fox #348": 348, "no number": None, "#12345678901": None, "": None}
    df = spark.createDataFrame([(c,) for c in cases], "n STRING").select("n", token_number(F.col("n")).alias("t"))
    assert {r.n: r.t for r in df.collect()} == cases


def test_base58():
    assert decode("1" * 32) == bytes(32)
    assert decode("24o") == bytes([14, 0]) and decode("uy") == bytes([12, 0])
    assert decode("0") is None


def test_intervals(spark):
    out = intervals.interval_rebuild(events(spark, [
        (300, "transfer", "b", "c"), (100, "mint", None, "a"), (200, "transfer", "a", "b")]))
    assert [s[:2] for s in spans(out)] == [(100, 200), (200, 300), (300, None)]


def test_burn_closes(spark):
    out = intervals.interval_rebuild(events(spark, [(100, "mint", None, "a"), (200, "burn", "a", None)]))
    assert spans(out) == [(100, 200, "a")]


def test_same_slot(spark):
    rows = [(1, 1, 1, "s", 0, 100, None, "mint", None, "a"), (2, 1, 1, "s", 1, 100, None, "transfer", "a", "b")]
    out = intervals.interval_rebuild(spark.createDataFrame(rows, EVENT))
    assert {(r.owner, r.from_slot, r.to_slot) for r in out.collect()} == {("a", 100, 100), ("b", 100, None)}
    assert intervals.interval_overlap(out).count() == 0


def test_overlaps(spark):
    h = spark.createDataFrame([(1, "a", 10, 20, 1), (1, "b", 12, 15, 2), (1, "c", 30, None, 3), (1, "d", 40, None, 4),
                               (2, "a", 5, 5, 5), (2, "b", 5, 9, 6)],
                              "asset_id BIGINT, owner STRING, from_slot BIGINT, to_slot BIGINT, opened_by BIGINT")
    assert {r.opened_by for r in intervals.interval_overlap(h).collect()} == {2, 4}


@pytest.mark.parametrize("rows, owner, burned, verdict", [
    ([(1, "mint", None, "a"), (2, "transfer", "a", "b")], "b", False, "complete"),
    ([(1, "mint", None, "a"), (2, "transfer", "x", "b")], "b", False, "gapped"),
    ([(1, "mint", None, "a"), (2, "transfer", None, "b")], "b", False, "complete"),
    ([(1, "mint", None, "a")], "z", False, "mismatch"),
    ([(1, "mint", None, "a"), (2, "burn", "a", None)], None, True, "complete"),
    ([(1, "mint", None, "a")], None, False, "unverifiable"),
    ([], "a", False, "unverifiable"),
])
def test_chain_verdict(spark, rows, owner, burned, verdict):
    assets = spark.createDataFrame([(1, owner, burned)], "id BIGINT, owner STRING, burned BOOLEAN")
    chains = classify.chain_derive(events(spark, rows))
    assert classify.chain_verdict(chains, assets).first().verdict == verdict


ASSET = "id BIGINT, address STRING, collection_id INT, membership_status STRING, name STRING, number INT, burned BOOLEAN, owner STRING"


def assets(spark, n, **over):
    rows = [(i, key(i), 1, "member", f"Fox #{i}", i, False, None) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, ASSET)


def traits(spark, rows):
    return spark.createDataFrame([(a, 1, t, v, i, t != "Name") for i, (a, t, v) in enumerate(rows)],
                                 "asset_id BIGINT, collection_id INT, trait_type STRING, value STRING, position INT, is_facet BOOLEAN")


def test_rarity(spark):
    # each value's carriers: Hat cap 2, crown 1, absent 1; Eye red 3, laser 1 of four
    t = traits(spark, [(1, "Hat", "crown"), (1, "Eye", "laser"), (2, "Eye", "red"), (3, "Hat", "cap"), (3, "Eye", "red"),
                       (4, "Hat", "cap"), (4, "Eye", "red")])
    ranked = rarity.rarity_rank(assets(spark, 4), t)
    got = {r.asset_id: (r.rarity_score, r.rarity_rank) for r in ranked.collect()}
    assert got == {1: (8.0, 1), 2: (5.333333, 2), 3: (3.333333, 3), 4: (3.333333, 4)}
    again = rarity.rarity_apply(ranked, ranked)
    assert again.where("changed").count() == 0
    counts = rarity.rarity_verify(assets(spark, 4), t, ranked).first()
    assert (counts.assets, counts.mismatches) == (4, 0)


def test_rarity_needs_a_facet(spark):
    t = traits(spark, [(1, "Name", "x"), (2, "Name", "y")])
    assert rarity.rarity_rank(assets(spark, 2), t).count() == 0


def test_two_values_of_a_type_are_two_terms(spark):
    t = traits(spark, [(1, "Hat", "a"), (1, "Hat", "b"), (2, "Hat", "a")])
    got = {r.asset_id: float(r.score) for r in rarity.rarity_score(assets(spark, 2), t).collect()}
    assert got == {1: 3.0, 2: 1.0}


def test_rarity_keeps_twelve_places(spark):
    # asset 1's terms add up to ...4999995 to ...4999999 behind the sixth place: down, unless a place was rounded away before
    n, carriers = 199, (23, 47, 53, 76)
    members = spark.createDataFrame([(i, 1, "member") for i in range(1, n + 1)], "id BIGINT, collection_id INT, membership_status STRING")
    t = traits(spark, [(i, f"T{c}", "x" if i <= c else "y") for c in carriers for i in range(1, n + 1)])
    got = {r.asset_id: r.score for r in rarity.rarity_score(members, t).where("asset_id = 1").collect()}
    twelfths = sum((2 * n * 10**12 + c) // (2 * c) for c in carriers)
    assert int(got[1] * 10**6) == (2 * twelfths + 10**6) // (2 * 10**6)


def test_unknown_type_and_value(spark):
    t = traits(spark, [(1, "Hat", "a"), (2, "Hat", "b"), (1, "Eye", "x"), (2, "Eye", "y")])
    a = assets(spark, 2)
    assert facets.facet_disjunctive(a, t, {"Nose": ["x"]}).count() == 0
    unknown_value = facets.facet_disjunctive(a, t, {"Hat": ["zzz"]})
    assert {(r.trait_type, r.value) for r in unknown_value.collect()} == {("Hat", "a"), ("Hat", "b")}
    assert predicates.trait_filter(a, t, {"Hat": ["zzz"]}).count() == 0


def test_holder_rank(spark):
    rows = [(i, key(i), 1, "member", "n", i, False, o) for i, o in enumerate("aaabbbc", 1)]
    a = spark.createDataFrame(rows, ASSET)
    c = spark.createDataFrame([(1, "one", True)], "id INT, slug STRING, enabled BOOLEAN")
    got = {r.address: (r["count"], r["rank"]) for r in stats.holder_rank(c, a).collect()}
    assert got == {"a": (3, 1), "b": (3, 1), "c": (1, 3)}
    assert stats.wallet_holder_ranks(c, a, "nobody").count() == 0


def test_literal_percent(spark):
    rows = [(1, key(1), 1, "member", "100% Foxy", 1, False, None), (2, key(2), 1, "member", "1000 Foxy", 2, False, None)]
    a = spark.createDataFrame(rows, ASSET)
    c = spark.createDataFrame([(1, "one", True)], "id INT, slug STRING, enabled BOOLEAN")
    assert [r.id for r in browse.search_grouped(c, a, text="100%").collect()] == [1]
    both = browse.search_grouped(c, a, text="100", per_group=1).collect()
    assert len(both) == 1 and both[0].total == 2


@pytest.mark.parametrize("size", [1, 3, 7, 40])
def test_pages_are_the_scan(spark, size):
    from vitrine.operators.timeline import newest
    rows = spark.createDataFrame([(i % 6, i) for i in range(40)], "slot BIGINT, id BIGINT")
    scan = [tuple(r) for r in rows.orderBy(F.desc("slot"), F.desc("id")).collect()]
    seen, after = [], None
    while True:
        page = [tuple(r) for r in newest(rows, "slot", "id", after, size).collect()]
        if not page:
            break
        seen += page
        after = page[-1]
    assert seen == scan


UPSERT = "address STRING, collection_id INT, name STRING, symbol STRING, metadata_uri STRING, metadata_source_uri STRING, image_uri STRING, burned BOOLEAN, owner STRING, owner_slot BIGINT"


@pytest.mark.parametrize("batch, action, owner", [
    ((key(2), 50, False), "unchanged", key(1)), ((key(2), 150, False), "updated", key(2)),
    ((None, 150, False), "unchanged", key(1)), (("bad!", 150, False), "unchanged", key(1)), ((key(1), 150, True), "updated", None)])
def test_upsert_owner(spark, batch, action, owner):
    stored = spark.createDataFrame([(key(5), 1, "n", "s", "u", "m", "i", False, key(1), 100)], UPSERT)
    new_owner, slot, burned = batch
    rows = spark.createDataFrame([(key(5), 1, "n", "s", "u", None, None, burned, new_owner, slot, 0)], UPSERT + ", ord INT")
    got = merge.upsert_assets(stored, rows)
    row = got.first()
    assert (row.action, row.owner, row.metadata_source_uri, row.image_uri) == (action, owner, "m", "i")
    again = merge.upsert_assets(got.drop("action"), rows).first()
    assert again.action == "unchanged"


def test_watermark(spark):
    schema = "slot BIGINT, processed_at TIMESTAMP"

    def mark(rows):
        df = spark.createDataFrame(rows, "slot BIGINT, p STRING").select("slot", F.col("p").cast("timestamp").alias("processed_at"))
        return runs.watermark(df, "2024-01-01 01:00:00", 60).first()[0]

    done, recent = "2024-01-01 00:00:00", "2024-01-01 00:59:59"
    assert mark([]) is None
    assert mark([(100, None), (200, None), (300, None)]) == 99
    assert mark([(100, None), (200, done), (300, None)]) == 99
    assert mark([(100, done), (200, done), (300, done)]) == 300
    assert mark([(100, recent)]) is None


def test_probe_stops_after_twenty(spark):
    stored = spark.createDataFrame([(i, key(i % 20) + str(i), 1, f"o{i}", False) for i in range(25)],
                                   "id BIGINT, address STRING, collection_id INT, owner STRING, burned BOOLEAN")
    seen = stored.withColumn("updated", F.col("id"))
    rows = reconcile.probe_stop_rule(seen, stored)
    assert rows.count() == 25 and rows.where("read").count() == 20
    assert reconcile.probe_stop_rule(seen, stored, page=7).where("read").count() == 7


def test_candidates_past_the_cap_are_flagged(spark):
    ids = spark.createDataFrame([(i,) for i in range(10)], "id BIGINT")
    none = ids.limit(0)
    got = reconcile.candidate_union(ids, ids, none, cap=4)
    assert got.count() == 10 and got.where("action = 'flag'").count() == 6


def price(spark, to, frm, deltas, payer, fee, accounts=()):
    row = [(to, frm, "transfer", [(a, d) for a, d in deltas], payer, fee, list(accounts))]
    df = spark.createDataFrame(row, "to_owner STRING, from_owner STRING, kind STRING, native_deltas ARRAY<STRUCT<account: STRING, delta: BIGINT>>, fee_payer STRING, fee BIGINT, token_accounts ARRAY<STRING>")
    r = classify.price_of(df).first()
    return r.candidate_lamports, r.candidate_source


def test_prices(spark):
    sale = [("b", -580_005_000), ("s", 545_200_000), ("r", 34_800_000)]
    assert price(spark, "b", "s", sale, "b", 5_000) == (580_000_000, "buyer")
    rent = [("b", -1_952_044_280), ("ata", 2_039_280), ("s", 1_950_000_000)]
    assert price(spark, "b", "s", rent, "b", 5_000, ["ata"]) == (1_950_000_000, "buyer")
    escrow = [("b", -5_000), ("e", -8_000_000_000), ("s", 7_600_000_000), ("r", 400_000_000)]
    assert price(spark, "b", "s", escrow, "x", 0) == (8_000_000_000, "credited")
    assert price(spark, "b", "s", [("b", -5_000)], "b", 5_000) == (None, None)
