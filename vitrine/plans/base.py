"""Domain tables themselves, checked against their SQL twins."""

from __future__ import annotations

from vitrine.operators import intervals
from vitrine.plans.common import Plans
from vitrine.plans.sqlbase import with_

plans = Plans()
query = plans.query

ACT = "id, asset_id, collection_id, signature, seq, slot, block_time, kind, from_owner, to_owner, price_lamports, marketplace"


@query("write_tables", with_("activity", f"select {ACT} from activity"))
def _activity(d):
    return d.activity().drop("details")


@query("assets_table", with_("assets", "select * from assets"))
def _assets(d):
    return d.assets()


@query("attributes_table", with_("asset_attributes", "select * from asset_attributes"))
def _attributes(d):
    return d.asset_attributes()


@query("deliveries_table", with_("deliveries", "select * from deliveries"))
def _deliveries(d):
    return d.deliveries()


@query("interval_rebuild", with_("history", "select * from history"))
def _intervals(d):
    return intervals.interval_rebuild(d.activity(), d.event_sizes())
