"""Transactions written by hand, from JSON to intervals."""

import json

import pytest

from vitrine.operators import decode, jobs
from vitrine.session import write_table

TOKEN, MARKET, CORE = "tokenProgram", "marketProgram", "coreProgram"


def balance(index, mint, owner=None, amount="1", decimals=0):
    out = {"accountIndex": index, "mint": mint, "uiTokenAmount": {"amount": amount, "decimals": decimals}}
    return out | ({"owner": owner} if owner else {})


def call(name, **info):
    return {"programId": TOKEN, "parsed": {"type": name, "info": info}}


def tx(keys, instructions, pre=(), post=(), lamports=None, err=None, inner=(), time=None, nested=False):
    before, after = lamports or ([], [])
    meta = {"err": err, "fee": 5000, "preBalances": before, "postBalances": after, "preTokenBalances": list(pre),
            "postTokenBalances": list(post), "innerInstructions": list(inner)}
    message = {"accountKeys": [{"pubkey": k} for k in keys] if nested else keys, "instructions": instructions}
    body = {"transaction": {"transaction": {"message": message}, "meta": meta}} if nested else {
        "transaction": {"message": message}, "meta": meta}
    return json.dumps(body | ({"blockTime": time} if time else {}))


def raw(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", 100 * (i + 1), b) for i, b in enumerate(bodies)], "signature STRING, slot BIGINT, body STRING")


def events(spark, *bodies):
    got = decode.decode_token_events(decode.facts(raw(spark, *bodies))).collect()
    return sorted((r.signature, r.seq, r.address, r.kind, r.from_owner, r.to_owner) for r in got)


MOVE = call("transfer", source="A", destination="B")


def test_old_balances_need_the_owner_map(spark):
    old = tx(["p", "A", "B"], [MOVE], [balance(1, "nft")], [balance(2, "nft")])
    assert events(spark, old) == []
    told = tx(["p", "A", "B"], [call("create", account="B", wallet="bob"), call("initializeAccount3", account="A", owner="ann")])
    assert events(spark, old, told) == [("s0", 0, "nft", "transfer", "ann", "bob")]


def test_what_is_no_transfer(spark):
    fungible = tx(["p", "A", "B"], [MOVE], [balance(1, "coin", "a", "5", 6)], [balance(2, "coin", "b", "5", 6)])
    same_wallet = tx(["p", "A", "B"], [MOVE], [balance(1, "nft", "a")], [balance(2, "nft", "a")])
    failed = tx(["p", "A", "B"], [MOVE], [balance(1, "nft", "a")], [balance(2, "nft", "b")], err={"Custom": 1})
    assert events(spark, fungible, same_wallet, failed) == []


def test_sequence_follows_the_instructions(spark):
    body = tx(["p", "A", "B"], [call("burn", account="A"), {"programId": MARKET}], [balance(1, "nft", "a")], [balance(2, "nft", "b")],
              inner=[{"index": 0, "instructions": [MOVE]}], nested=True)
    assert events(spark, body) == [("s0", 0, "nft", "burn", "a", None), ("s0", 1, "nft", "transfer", "a", "b")]


def core(program, data, receiver="bob", n=8):
    return {"programId": program, "accounts": ["asset", "coll", "payer", "auth", receiver, "sys", "log", "x"][:n], "data": data}


CREATE = "3UF3LPQ3CfmoecgrEngY4o"


@pytest.mark.parametrize("instruction, program, kind, receiver", [
    (core(CORE, CREATE), CORE, "mint", "bob"), (core(CORE, "uy"), CORE, "burn", None), (core(CORE, "24o", n=7), CORE, "transfer", "bob"),
    (core(CORE, "24o", receiver=CORE), CORE, None, None), (core("other", "24o"), CORE, None, "bob"),
    (core(CORE, "24o"), None, None, "bob"), (core(CORE, "24o", n=6), CORE, None, "bob"), (core(CORE, "FmPkmaoqFBNX"), CORE, None, "bob")])
def test_core_calls(spark, instruction, program, kind, receiver):
    collections = spark.createDataFrame([(1, "coll", "core", program)], "id INT, address STRING, standard STRING, program STRING")
    calls = decode.core_calls(decode.facts(raw(spark, tx(["payer"], [instruction]))), collections)
    row = calls.first()
    assert (row.address, row.kind) == ("asset", kind)
    if kind:
        event = decode.decode_core_events(calls).first()
        assert (event.from_owner, event.to_owner) == (None, receiver)
    touch = decode.core_touches(calls).first()
    assert (touch.address, touch.collection, touch.decoded) == ("asset", "coll", kind is not None)


def test_whole_job_and_again(spark):
    mint = tx(["ann", "A"], [call("mintTo", account="A")], [], [balance(1, "nft", "ann")], time=1_600_000_000)
    sale = tx(["bob", "A", "B", "ann", "roy"], [{"programId": MARKET, "accounts": []}], [balance(1, "nft", "ann")], [balance(2, "nft", "bob")],
              lamports=([10**10, 0, 0, 0, 0], [10**10 - 580_005_000, 0, 0, 545_200_000, 34_800_000]),
              inner=[{"index": 0, "instructions": [MOVE]}])
    lost = tx(["x"], [])
    r = raw(spark, mint, sale, lost)
    assets = spark.createDataFrame([(1, "nft", 7, "bob", False)], "id BIGINT, address STRING, collection_id INT, owner STRING, burned BOOLEAN")
    collections = spark.createDataFrame([], "id INT, address STRING, standard STRING, program STRING")
    venues = spark.createDataFrame([(MARKET, "Market")], "program_id STRING, label STRING")
    times = spark.sql("SELECT 200L AS slot, TIMESTAMP '2020-09-14' AS block_time")
    nothing = spark.createDataFrame([], jobs.ACTIVITY)
    out = jobs.timeline_job(r, assets, collections, venues, times, nothing)
    got = sorted((e.slot, e.kind, e.price_lamports, e.marketplace) for e in out["new_activity"].collect())
    assert got == [(100, "mint", None, None), (200, "sale", 580_000_000, "Market")]
    assert sorted((h.from_slot, h.to_slot, h.owner) for h in out["history"].collect()) == [(100, 200, "ann"), (200, None, "bob")]
    assert out["verdicts"].first().verdict == "complete"
    assert [p.signature for p in out["parked"].collect()] == ["s2"]
    again = jobs.timeline_job(r, assets, collections, venues, times, out["activity"])
    assert again["new_activity"].count() == 0


def chain_of_accounts(n):
    """Transactions that hand one token on: only the first names its mint, each other shares an account with the one before."""
    first = tx(["p", "nft", "A0"], [call("mintTo", account="A0")], [], [balance(2, "nft", "o0")], time=1_600_000_000)
    return [first] + [tx(["p", f"A{i}", f"A{i + 1}"], [call("transfer", source=f"A{i}", destination=f"A{i + 1}")], [balance(1, "nft", f"o{i}")],
                         [balance(2, "nft", f"o{i + 1}")], time=1_600_000_000 + i) for i in range(n)]


def test_crawl_goes_on_until_nothing_is_new(spark):
    facts = write_table(decode.facts(raw(spark, *chain_of_accounts(4), tx(["p", "Z", "other"], []))), "facts")
    assets = spark.createDataFrame([("nft",), ("unknown",)], "address STRING")
    found = sorted((r.address, r.signature, r.round) for r in decode.crawl_frontier(facts, assets).collect())
    assert found == [("nft", f"s{i}", i + 1) for i in range(5)]
    assert decode.crawl_frontier(facts, assets.limit(0)).count() == 0
    stop = decode.crawl_frontier(facts, assets, lambda found: found.groupBy("address").count().where("count >= 3").select("address"))
    assert stop.count() == 3


def test_crawl_stops_where_the_chain_is_whole(spark):
    facts = write_table(decode.facts(raw(spark, *chain_of_accounts(3))), "facts")
    columns = "id BIGINT, address STRING, collection_id INT, owner STRING, burned BOOLEAN"
    collections = spark.createDataFrame([], "id INT, address STRING, standard STRING, program STRING")
    for owner, want in (("o1", 2),):
        assets = spark.createDataFrame([(1, "nft", 7, owner, False)], columns)
        settled = jobs.settled_by_verdict(facts, assets, collections, decode.harvest_owner_map(facts))
        assert decode.crawl_frontier(facts, assets, settled).count() == want


def test_crawl_asks_only_about_assets_that_a_round_found_something_of(spark):
    lone = tx(["p", "other", "Z"], [call("mintTo", account="Z")], [], [balance(2, "other", "x")])
    facts = write_table(decode.facts(raw(spark, *chain_of_accounts(2), lone)), "facts")
    assets, asked = spark.createDataFrame([("nft",), ("other",)], "address STRING"), []

    def settled(found):
        asked.append(sorted({r.address for r in found.collect()}))
        return found.where("false").select("address")
    assert decode.crawl_frontier(facts, assets, settled).count() == 4
    assert asked == [["nft", "other"], ["nft"], ["nft"], []]  # the last round finds nothing


def test_plain_keys_are_no_json(spark):
    keys = ["111111SYNx", '{"pubkey":"a"}', "p{", '{"other":1}']
    body = json.dumps({"transaction": {"message": {"accountKeys": keys + [{"pubkey": "b"}], "instructions": []}}, "meta": {}})
    rows = decode.tx_account_keys(decode.land_transactions(raw(spark, body)))
    assert rows.first()["keys"] == ["111111SYNx", "a", "p{", '{"other":1}', "b"]
    assert "contains" in rows._jdf.queryExecution().analyzed().toString().lower()


def test_repair_of_drifted_assets(spark):
    bodies = chain_of_accounts(2)
    facts = write_table(decode.facts(raw(spark, *bodies)), "facts")
    asset = "id BIGINT, address STRING, collection_id INT, owner STRING, burned BOOLEAN, membership_status STRING, owner_slot BIGINT, last_activity_slot BIGINT"
    collections = spark.createDataFrame([(7, None, "token_metadata", None, True)], "id INT, address STRING, standard STRING, program STRING, enabled BOOLEAN")
    venues = spark.createDataFrame([], "program_id STRING, label STRING")
    times = spark.createDataFrame([], "slot BIGINT, block_time TIMESTAMP")
    known = spark.createDataFrame([(1, "nft", 7, "o2", False)], "id BIGINT, address STRING, collection_id INT, owner STRING, burned BOOLEAN")
    stored = jobs.timeline_job(raw(spark, *bodies[:2]), known, collections, venues, times, spark.createDataFrame([], jobs.ACTIVITY))["activity"]
    stored = write_table(stored, "stored")
    for owner, residual in (("stranger", 1),):
        assets = spark.createDataFrame([(1, "nft", 7, owner, False, "member", None, None)], asset)
        out = jobs.repair_drifted(facts, decode.account_index(facts), assets, collections, venues, times, stored, decode.harvest_owner_map(facts))
        assert out["found"].count() == 3 and out["new_activity"].count() == 1
        assert sorted((r.from_slot, r.owner, r.to_slot) for r in out["history"].collect()) == [(100 * (i + 1), f"o{i}", 100 * (i + 2) if i < 2 else None) for i in range(3)]
        assert out["residual"].count() == residual
    agrees = spark.createDataFrame([(1, "nft", 7, "o1", False, "member", None, None)], asset)
    out = jobs.repair_drifted(facts, decode.account_index(facts), agrees, collections, venues, times, stored, decode.harvest_owner_map(facts))
    assert out["found"].count() == out["history"].count() == out["residual"].count() == 0
