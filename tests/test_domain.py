"""The domain tables: what they write, and what their exchanges carry."""

import re

from vitrine.operators.timeline import owners_signatures_join
from vitrine.plans import registry
from vitrine.sources import domain
from vitrine.sources.domain import Domain

SF = "/root/testdata/sf0.001"


def landed(spark, *names):
    """The tables that queries land, on their own."""
    kept = dict(domain._LANDED)
    domain._LANDED.clear()
    try:
        for name in names:
            registry.QUERIES[name](spark, SF).count()
        return {slot[2] for slot in domain._LANDED}
    finally:
        domain._LANDED.clear()
        domain._LANDED.update(kept)


def exchanged(df):
    """The columns that the exchanges of a plan carry: (name, partition keys aside) by exchange."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    return [set(re.sub(r"#\d+L?", "", n).split(", ")) for n in nodes]


def test_no_event_is_landed(spark):
    got = landed(spark, "owner_agrees", "rarity_score", "write_tables", "activity_summary", "browse_page_rarity")
    assert not got & {"hops", "activity", "ownership_history"}, got


def test_no_body_is_landed(spark):
    got = landed(spark, "price_of", "timeline_job_parked", "tx_programs")
    assert got and "transactions" not in got, got


def test_exchanges_of_events_carry_keys_and_not_texts(spark):
    carried = exchanged(Domain(spark, SF).activity())
    assert carried and not any(c & {"signature", "receiver", "from_owner", "to_owner", "details"} for c in carried), carried


def test_core_calls_land_no_transaction(spark):
    assert not landed(spark, "core_touches") & {"transactions", "tx_facts"}


def test_maps_of_the_ledger_land_no_transaction(spark):
    assert not landed(spark, "harvest_owner_map", "mint_token_accounts") & {"transactions", "tx_facts"}


def test_signed_intervals_exchange_no_text(spark):
    for name in ("owners_signatures_join", "serve_intervals"):
        carried = exchanged(registry.QUERIES[name](spark, SF))
        assert carried and not any(c & {"signature", "opened_by_signature", "closed_by_signature", "owner", "to_owner"} for c in carried), carried


def test_signed_intervals_are_those_joined_to_their_events(spark):
    d = Domain(spark, SF)
    joined = owners_signatures_join(d.ownership_history(), d.activity())
    assert sorted(map(str, d.signed_history().select(*joined.columns).collect())) == sorted(map(str, joined.collect()))


def written(spark, name):
    """The names of all tables that a query writes, on its own."""
    from pathlib import Path

    from vitrine.session import shared_dir
    root = Path(shared_dir(spark).removeprefix("file:"), "tables")
    before = set(root.glob("*/*"))
    landed(spark, name)
    return {p.name for p in set(root.glob("*/*")) - before}


def test_queries_of_one_pass_write_nothing(spark):
    for name in ("tx_balances", "nft_unit_gate", "tx_native_deltas", "tx_programs", "venue_first_match", "timeline_job_parked"):
        assert not written(spark, name), name


def test_calls_are_written_and_not_the_facts_they_come_from(spark):
    for name in ("owner_map_join", "decode_token_events", "price_of", "classify_events", "timeline_job"):
        got = written(spark, name)
        assert "calls" in got and not got & {"tx_facts", "facts", "token_facts"}, (name, got)


def test_small_orders_leave_the_ledger_parallel(spark):
    from vitrine.sources.ledger import ledger
    plan = ledger(Domain(spark, SF))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "hashpartitioning(l_orderkey" in plan, plan


def test_crawl_stores_no_account_of_all(spark):
    assert "account_index" not in landed(spark, "crawl_frontier")


def test_detail_does_not_join_signatures_by_event(spark):
    carried = exchanged(registry.QUERIES["nft_detail"](spark, SF))
    assert carried and not any({"id", "signature"} <= c or "_opened_by" in c for c in carried), carried
