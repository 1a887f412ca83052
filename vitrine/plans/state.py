"""Upserts, reconciliation and run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import merge, reconcile, runs
from vitrine.plans.common import Plans
from vitrine.plans.sqlbase import key, with_
from vitrine.sources.domain import key as spark_key
from vitrine.sources.domain import signature, text

plans = Plans()
query = plans.query

PUBKEY = "[1-9A-HJ-NP-Za-km-z]{32,44}"
TEXT = "name, symbol, metadata_uri, metadata_source_uri, image_uri"

# -- a batch of snapshots with everything that can be wrong with one -----------------
BATCH = f"""
  select case when k % 41 = 0 then 'bad' || k else address end as address,
    case when k % 37 = 0 then collection_id + 1 else collection_id end as collection_id,
    case when k % 8 = 0 then name || ' v2' else name end || case when ord = 1 then ' again' else '' end as name, symbol, metadata_uri,
    case when k % 5 <> 0 then metadata_source_uri end as metadata_source_uri,
    case when k % 6 <> 0 then image_uri end as image_uri, k % 31 = 0 as burned,
    case when k % 13 = 0 then {key("'walletmoved' || k")} when k % 17 = 0 then 'bad!' when k % 7 = 0 then null
         else owner end as owner, cast(4250 as bigint) as owner_slot, ord
  from (select *, id - 1 as k from assets) cross join (select unnest([0, 1]) as ord)
  where k % 3 <> 1 and (ord = 0 or k % 10 = 0)"""


def batch(d):
    k, c = F.col("k"), F.col
    rows = d.assets().withColumn("k", F.col("id") - 1).where(k % 3 != 1).withColumn(
        "ord", F.explode(F.array(F.lit(0), F.lit(1)))).where((c("ord") == 0) | (k % 10 == 0))
    name = F.concat(F.when(k % 8 == 0, F.concat("name", F.lit(" v2"))).otherwise(c("name")),
                    F.when(c("ord") == 1, " again").otherwise(""))
    owner = (F.when(k % 13 == 0, spark_key(text("wallet", "moved", k))).when(k % 17 == 0, "bad!")
             .when(k % 7 == 0, F.lit(None)).otherwise(c("owner")))
    return rows.select(
        F.when(k % 41 == 0, text("bad", k)).otherwise(c("address")).alias("address"),
        F.when(k % 37 == 0, c("collection_id") + 1).otherwise(c("collection_id")).alias("collection_id"),
        name.alias("name"), "symbol", "metadata_uri", F.when(k % 5 != 0, c("metadata_source_uri")).alias("metadata_source_uri"),
        F.when(k % 6 != 0, c("image_uri")).alias("image_uri"), (k % 31 == 0).alias("burned"), owner.alias("owner"),
        F.lit(4250).cast("long").alias("owner_slot"), "ord")


# the row that a write would leave, column by column; it is written if that differs in one of them
WRITTEN = ["name", "symbol", "metadata_uri", "metadata_source_uri", "image_uri", "burned", "owner", "owner_slot"]
USABLE = f"regexp_full_match(owner, '{PUBKEY}')"
UPSERTED = f"""
  with incoming as (
    select * replace (case when not burned and {USABLE} then owner_slot end as owner_slot,
      case when not burned and {USABLE} then owner end as owner)
    from (select *, row_number() over (partition by address order by ord) as nth from batch where regexp_full_match(address, '{PUBKEY}'))
    where nth = 1),
  both_sides as (
    select coalesce(o.address, n.address) as address, coalesce(o.collection_id, n.collection_id) as collection_id, o, n,
      n.address is not null as offered, o.address is not null as known, o.collection_id <> n.collection_id as elsewhere,
      greatest(coalesce(o.burned, false), coalesce(n.burned, false)) as gone,
      case when o.owner_slot is null then true else coalesce(n.owner_slot, -1) > o.owner_slot end as newer
    from stored o full join incoming n using (address)),
  merged as (
    select *, n.name as name, n.symbol as symbol, n.metadata_uri as metadata_uri,
      coalesce(n.metadata_source_uri, o.metadata_source_uri) as metadata_source_uri, coalesce(n.image_uri, o.image_uri) as image_uri,
      gone as burned, case when not gone then case when newer then n.owner else o.owner end end as owner,
      case when not gone then case when newer then n.owner_slot else o.owner_slot end end as owner_slot
    from both_sides),
  judged as (
    select *, list_contains([name is distinct from o.name, symbol is distinct from o.symbol, metadata_uri is distinct from o.metadata_uri,
        metadata_source_uri is distinct from o.metadata_source_uri, image_uri is distinct from o.image_uri,
        burned is distinct from o.burned, not gone and owner is distinct from o.owner], true) as differs
    from merged),
  decided as (
    select *, case when not offered then 'kept' when not known then 'inserted' when elsewhere then 'skipped_foreign'
      when differs then 'updated' else 'unchanged' end as action from judged)
  select address, collection_id, {", ".join(f"case when action in ('inserted', 'updated') then {c} else o.{c} end as {c}" for c in WRITTEN)},
    action from decided
  union all
  select address, collection_id, {TEXT}, burned, case when {USABLE} then owner end, owner_slot,
    'invalid' from batch where not regexp_full_match(address, '{PUBKEY}')"""


@query("upsert_assets", with_("stored", UPSERTED, batch=BATCH))
def _(d):
    return merge.upsert_assets(d.stored_assets(), batch(d))


@query("upsert_counts", with_("stored", "select collection_id, action, count(*) as n from ups group by all",
                              batch=BATCH, ups=UPSERTED))
def _(d):
    return merge.action_counts(merge.upsert_assets(d.stored_assets(), batch(d)), "collection_id")


@query("merge_guarded", with_("tokens", """
  select coalesce(o.mint, n.mint) as mint, coalesce(n.symbol, o.symbol) as symbol, coalesce(n.name, o.name) as name,
    coalesce(n.decimals, o.decimals) as decimals, coalesce(n.enabled, o.enabled) as enabled,
    case when o.mint is null then 'inserted' when n.mint is null then 'kept'
      when (o.symbol, o.name, o.decimals, o.enabled) is not distinct from (n.symbol, n.name, n.decimals, n.enabled)
      then 'unchanged' else 'updated' end as action
  from (select * from tokens where created_order % 5 <> 1) o full join (
    select * replace (case when created_order % 3 = 0 then name || '!' else name end as name)
    from tokens where created_order % 7 <> 2) n on n.mint = o.mint"""))
def _(d):
    k = F.col("created_order")
    new = d.tokens().where(k % 7 != 2).withColumn(
        "name", F.when(k % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return merge.merge_guarded(d.tokens().where(k % 5 != 1), new, ["mint"], ["symbol", "name", "decimals", "enabled"])


# -- attributes ------------------------------------------------------------------------
SEEN = """
  select asset_id, collection_id, trait_type, case when asset_id % 5 = 0 and trait_type = 'Type' then value || '*' else value end
    as value, position + copy as position
  from asset_attributes cross join (select unnest([0, 3]) as copy)
  where asset_id % 3 <> 0 and asset_id % 10 <> 7 and (copy = 0 or asset_id % 4 = 0)"""


def seen_attributes(d):
    a = F.col("asset_id")
    value = F.when((a % 5 == 0) & (F.col("trait_type") == "Type"), F.concat("value", F.lit("*"))).otherwise(F.col("value"))
    return d.asset_attributes().where((a % 3 != 0) & (a % 10 != 7)).withColumn(
        "copy", F.explode(F.array(F.lit(3), F.lit(0)))).where((F.col("copy") == 0) | (a % 4 == 0)).select(
        "asset_id", "collection_id", "trait_type", value.alias("value"), (F.col("position") + F.col("copy")).alias("position"))


@query("attribute_dedupe", with_("asset_attributes", """
  select asset_id, collection_id, trait_type, value, min(position) as position from seen group by 1, 2, 3, 4""", seen=SEEN))
def _(d):
    return merge.attribute_dedupe(seen_attributes(d))


@query("replace_attributes", with_("asset_attributes asset_base", """
  select coalesce(o.asset_id, n.asset_id) as asset_id, coalesce(o.collection_id, n.collection_id) as collection_id,
    coalesce(o.trait_type, n.trait_type) as trait_type, coalesce(o.value, n.value) as value,
    coalesce(n.position, o.position) as position,
    case when o.asset_id is null then 'inserted'
      when n.asset_id is null then case when o.asset_id % 3 <> 0 then 'removed' else 'kept' end
      when o.position = n.position then 'unchanged' else 'updated' end as action
  from asset_attributes o full join (
    select asset_id, collection_id, trait_type, value, min(position) as position from seen group by 1, 2, 3, 4) n
  on n.asset_id = o.asset_id and n.trait_type = o.trait_type and n.value = o.value""", seen=SEEN))
def _(d):
    scope = d.asset_base().where(F.col("id") % 3 != 0).select(F.col("id").alias("asset_id"))
    return merge.replace_attributes(d.asset_attributes(), scope, seen_attributes(d))


@query("trait_dictionary", with_("asset_attributes", """
  select distinct collection_id, trait_type, value, trait_type <> 'Name' as is_facet from asset_attributes"""))
def _(d):
    return merge.trait_dictionary(d.asset_attributes(), d.collections())


@query("sync_trait_facets", with_("asset_attributes", """
  select distinct collection_id, trait_type, not (trait_type = 'Name' or (trait_type = 'Size' and collection_id % 2 = 0))
    as is_facet from asset_attributes"""))
def _(d):
    more = F.when(F.col("id") % 2 == 0, F.array(F.lit("Name"), F.lit("Size"))).otherwise(F.array(F.lit("Name")))
    types = d.asset_attributes().select("collection_id", "trait_type").distinct()
    return merge.sync_trait_facets(types, d.collections().withColumn("facet_exclude", more))


# -- state --------------------------------------------------------------------------------
APPLIED = """
  select s.id, case when h then s.burned or x.burned else s.burned end as burned,
    case when h then case when s.burned or x.burned then null else x.owner end else s.owner end as owner,
    case when h then case when s.burned or x.burned then null else x.slot end else s.owner_slot end as owner_slot,
    h as changed
  from (select s, x, coalesce((x.burned and not s.burned) or (not (s.burned or x.burned) and x.owner is not null
      and (s.owner_slot is null or x.slot > s.owner_slot) and s.owner is distinct from x.owner), false) as h
    from stored s left join (select * replace (nullif(owner, '') as owner) from observed) x
      on x.address = s.address and x.collection_id = s.collection_id)"""


def known_owner(d):
    return d.observed().withColumn("owner", F.nullif("owner", F.lit("")))


@query("apply_state", with_("stored observed", APPLIED))
def _(d):
    return merge.apply_state(d.stored_assets(), known_owner(d)).select(
        "id", "burned", "owner", "owner_slot", "changed")


@query("set_membership", with_("stored", """
  select id, case when id % 3 = 0 and id % 2 = 0 then 'removed' when id % 3 = 0 then 'member' else membership_status end
      as membership_status,
    case when id % 3 = 0 and id % 2 = 0 and membership_status = 'member' then timestamp '2024-02-02'
      when id % 3 = 0 and id % 2 = 1 then null else removed_at end as removed_at,
    id % 3 = 0 and membership_status <> case when id % 2 = 0 then 'removed' else 'member' end as changed
  from stored"""))
def _(d):
    k = F.col("id")
    moves = d.stored_assets().where(k % 3 == 0).select("address", "collection_id", (k % 2 == 0).alias("removed"))
    return merge.set_membership(d.stored_assets(), moves, "2024-02-02 00:00:00").select(
        "id", "membership_status", "removed_at", "changed")


@query("set_image_status", with_("stored", """
  select id, case when id % 4 = 1 then 'dead' when id % 4 = 2 then 'ok' else image_status end as image_status,
    case when id % 4 in (1, 2) then timestamp '2024-02-02' else image_checked_at end as image_checked_at from stored"""))
def _(d):
    k = F.col("id")
    checks = d.stored_assets().select("address", "collection_id", F.when(k % 4 == 1, "dead").when(k % 4 == 2, "ok").alias("status"))
    return merge.set_image_status(d.stored_assets(), checks, "2024-02-02 00:00:00").select(
        "id", "image_status", "image_checked_at")


@query("dirty_flags", with_("stored", """
  select id, ownership_dirty or id % 20 = 4 as ownership_dirty, id % 20 = 4 and not ownership_dirty as flagged from stored"""))
def _(d):
    return merge.dirty_flags(d.stored_assets(), d.asset_base().where(F.col("id") % 20 == 4)).select(
        "id", "ownership_dirty", "flagged")


@query("rarity_dirty", with_("stored collections asset_attributes", """
  select c.id, rarity_dirty or c.id in (select collection_id from ups where action = 'inserted') as rarity_dirty
  from collections c""", batch=BATCH, ups=UPSERTED))
def _(d):
    ups = merge.upsert_assets(d.stored_assets(), batch(d))
    same = merge.replace_attributes(d.asset_attributes(), d.asset_base().select(F.col("id").alias("asset_id")),
                                    d.asset_attributes())
    moves = d.stored_assets().withColumn("changed", F.lit(False))
    return merge.rarity_dirty(d.collections(), ups, same, moves)


# -- signatures -----------------------------------------------------------------------------
@query("signature_fill", with_("signatures", """
  select asset_id, signature, coalesce(any_value(slot) filter (old), any_value(slot)) as slot,
    coalesce(any_value(told) filter (old), any_value(told)) as block_time, coalesce(any_value(failed) filter (old), any_value(failed)) as failed,
    case when not bool_or(old) then 'inserted' when bool_and(old) then 'kept'
      when count(told) filter (old) = 0 and count(told) > 0 then 'updated' else 'unchanged' end as action
  from (
    select asset_id, signature, slot, failed, true as old, case when slot % 4 <> 0 then block_time end as told from signatures where asset_id % 5 <> 0
    union all select asset_id, signature, slot, failed, false, case when slot % 8 <> 4 then block_time end from signatures where asset_id % 7 <> 0)
  group by 1, 2"""))
def _(d):
    s, slot, a = d.signatures(), F.col("slot"), F.col("asset_id")
    stored = s.where(a % 5 != 0).withColumn("block_time", F.when(slot % 4 != 0, F.col("block_time")))
    new = s.where(a % 7 != 0).withColumn("block_time", F.when(slot % 8 != 4, F.col("block_time")))
    return merge.signature_fill(stored, new)


@query("mark_classified", with_("signatures", """
  select asset_id, signature, coalesce(classified_at, case when asset_id % 2 = 0 then timestamp '2024-02-02' end)
    as classified_at from signatures"""))
def _(d):
    return merge.mark_classified(d.signatures(), d.signatures().where(F.col("asset_id") % 2 == 0),
                                 "2024-02-02 00:00:00").select("asset_id", "signature", "classified_at")


@query("signature_dedupe", """
  select asset_id, signature, seq, amount from (
    select l_partkey + 1 as asset_id, l_orderkey as signature, l_linenumber as seq,
      cast(round(l_extendedprice * 100) as bigint) as amount,
      row_number() over (partition by l_partkey, l_orderkey, l_linenumber order by l_shipdate, l_suppkey, l_quantity,
        l_extendedprice) as rn from lineitem) where rn = 1""")
def _(d):
    rows = d.raw("lineitem").select(
        (F.col("l_partkey") + 1).alias("asset_id"), F.col("l_orderkey").alias("signature"),
        F.col("l_linenumber").alias("seq"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"),
        "l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice")
    return merge.signature_dedupe(rows, ["l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice"]).select(
        "asset_id", "signature", "seq", "amount")


@query("reclassify_reset", with_("assets activity history signatures", """
  select 'assets' as part, id as asset_id, count(*) as n, count(last_activity_slot) as kept from assets group by 1, 2
  union all select 'activity', asset_id, count(*), count(*) from activity where asset_id % 9 <> 1 group by 1, 2
  union all select 'history', asset_id, count(*), count(*) from history where asset_id % 9 <> 1 group by 1, 2
  union all select 'signatures', asset_id, count(*), count(case when asset_id % 9 <> 1 then classified_at end)
    from signatures group by 1, 2""".replace("count(last_activity_slot)", "count(case when id % 9 <> 1 then last_activity_slot end)")))
def _(d):
    parts = merge.reclassify_reset(d.assets(), d.activity(), d.ownership_history(), d.signatures(),
                                   d.asset_base().where(F.col("id") % 9 == 1))
    keys = {"assets": ("id", F.col("last_activity_slot")), "activity": ("asset_id", F.lit(1)),
            "history": ("asset_id", F.lit(1)), "signatures": ("asset_id", F.col("classified_at"))}
    out = None
    for name, df in parts.items():
        by, kept = keys[name]
        one = df.groupBy(F.col(by).alias("asset_id")).agg(F.count(F.lit(1)).alias("n"), F.count(kept).alias("kept")).select(
            F.lit(name).alias("part"), "asset_id", "n", "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query("promote_to_sale", with_("activity", """
  select id, case when hit then 'sale' else kind end as kind, case when hit then hop_price else price_lamports end as price_lamports,
    case when hit then v.s_name else marketplace end as marketplace, hit as promoted
  from (select *, kind = 'transfer' and l_returnflag = 'R' and hop_price > 0
      and (l_suppkey % 2 = 0 or l_suppkey + 1 in (select s_suppkey from supplier)) as hit from activity) a
  left join supplier v on v.s_suppkey = case when l_suppkey % 2 = 0 then l_suppkey else l_suppkey + 1 end"""))
def _(d):
    return merge.promote_to_sale(d.activity(), d.venues()).select(
        "id", "kind", "price_lamports", "marketplace", "promoted")


# -- registry ---------------------------------------------------------------------------------
SEED = f"""
  select slug, case when id % 4 = 0 then name || ' II' else name end as name, standard,
    case when id % 6 = 1 then {key("'newaddress' || id")} else address end as address, verified_creator, update_authority,
    symbol, metadata_uri_template, enabled, program from collections where id % 7 <> 3"""
REG = "name, standard, address, verified_creator, update_authority, symbol, metadata_uri_template, enabled, program"


@query("registry_upsert", with_("collections", f"""
  select id, slug, {", ".join(f"case when action in ('inserted', 'updated') then n_{c.strip()} else o_{c.strip()} end as {c.strip()}"
                              for c in REG.split(','))}, action
  from (select coalesce(o.slug, n.slug) as slug, o.id,
      {", ".join(f"n.{c.strip()} as n_{c.strip()}, o.{c.strip()} as o_{c.strip()}" for c in REG.split(','))},
      case when o.slug is null then 'inserted' when n.slug is null then 'extra'
        when (o.standard, o.address, o.verified_creator) is distinct from (n.standard, n.address, n.verified_creator) then 'refused'
        when ({", ".join(f"o.{c.strip()}" for c in REG.split(','))}) is not distinct from
             ({", ".join(f"n.{c.strip()}" for c in REG.split(','))}) then 'unchanged' else 'updated' end as action
    from (select * from collections where id % 11 <> 5) o full join seed n on n.slug = o.slug)""", seed=SEED))
def _(d):
    c, i = d.collections(), F.col("id")
    seed = c.where(i % 7 != 3).withColumn(
        "name", F.when(i % 4 == 0, F.concat("name", F.lit(" II"))).otherwise(F.col("name"))).withColumn(
        "address", F.when(i % 6 == 1, spark_key(text("newaddress", i))).otherwise(F.col("address")))
    return merge.registry_upsert(c.where(i % 11 != 5), seed, d.asset_base())


@query("foreign_owner_join", with_("collection_mints", """
  select m.mint, m.collection_id + 1 as collection_id, m.collection_id as owned_by from collection_mints m
  where ascii(right(m.mint, 1)) % 3 = 0"""))
def _(d):
    moved = F.ascii(F.right("mint", F.lit(1))) % 3 == 0
    listed = d.collection_mints().withColumn(
        "collection_id", F.when(moved, F.col("collection_id") + 1).otherwise(F.col("collection_id")))
    return merge.foreign_owner_join(listed, d.collection_mints())


@query("registry_lookup", with_("collections", """
  select cast(row_number() over (order by id) as bigint) as place, id, slug, membership_rule from collections where enabled"""))
def _(d):
    from vitrine.operators.registry import enabled_in_order
    return enabled_in_order(d.collections()).select("place", "id", "slug", "membership_rule")


@query("registry_by_slug", with_("collections", """
  select id, slug, name, standard, enabled, membership_rule from collections where slug = 'brand-13'"""))
def _(d):
    from vitrine.operators.registry import by_slug
    return by_slug(d.collections(), "brand-13").select("id", "slug", "name", "standard", "enabled", "membership_rule")


@query("registry_allowlist", with_("collection_mints", "select mint from collection_mints where collection_id = 14 order by mint"))
def _(d):
    from vitrine.operators.registry import allowlist
    return allowlist(d.collection_mints(), 14)


@query("registry_tokens", with_("tokens", """
  select mint, symbol, name, decimals from tokens where enabled"""))
def _(d):
    from vitrine.operators.registry import tokens_in_order
    return tokens_in_order(d.tokens())


# -- reconcile --------------------------------------------------------------------------------
TRACKED = """
  select mint as address from collection_mints where collection_id in (
    select id from collections where enabled and membership_rule = 'tm_allowlist')
  union select address from members where collection_id in (
    select id from collections where enabled and membership_rule = 'tm_collection')
  union select address from collections where enabled and membership_rule = 'core_collection'"""
R = "stored observed members collections collection_mints history"


@query("tracked_addresses", with_(R, TRACKED))
def _(d):
    return reconcile.tracked_addresses(d.collections(), d.collection_mints(), d.assets())


@query("address_diff", with_(R, """
  select coalesce(t.address, r.address) as address, case when r.address is null then 'added' when t.address is null
    then 'removed' else 'kept' end as status
  from tracked t full join (select address from assets where id % 3 <> 0) r on r.address = t.address""", tracked=TRACKED))
def _(d):
    tracked = reconcile.tracked_addresses(d.collections(), d.collection_mints(), d.assets())
    return reconcile.address_diff(tracked, d.assets().where(F.col("id") % 3 != 0))


@query("probe_targets", with_(R, """
  select distinct case when membership_rule = 'tm_allowlist' then 'creator' else 'collection' end as filter,
    case when membership_rule = 'tm_allowlist' then verified_creator else address end as address
  from collections where enabled and membership_rule is not null"""))
def _(d):
    return reconcile.probe_targets(d.collections())


@query("observed_population", with_(R, """
  select o.address, o.collection_id, o.owner, o.burned from observed o join collections c on c.id = o.collection_id
  where c.enabled and case c.membership_rule
    when 'tm_allowlist' then o.address in (select mint from collection_mints)
    when 'tm_collection' then o.address in (select address from stored) else true end"""))
def _(d):
    return reconcile.observed_population(d.collections(), d.collection_mints(), d.stored_assets(), d.observed()).select(
        "address", "collection_id", "owner", "burned")


@query("membership_diff", with_(R, """
  select s.collection_id, s.address, o.address is null as removed from stored s
  join collections c on c.id = s.collection_id and c.enabled and c.membership_rule = 'core_collection'
  left join observed o on o.address = s.address
  where (o.address is null and s.membership_status = 'member') or (o.address is not null and s.membership_status <> 'member')"""))
def _(d):
    return reconcile.membership_diff(d.collections(), d.stored_assets(), d.observed())


DIFF = """
  select s.id, s.address, s.collection_id, s.owner as old_owner, x.new_owner, x.burned and not s.burned as newly_burned,
    s.last_activity_slot
  from stored s join (select address, burned, case when not burned then nullif(owner, '') end as new_owner from observed) x
    on x.address = s.address
  where (x.new_owner is not null and s.owner is distinct from x.new_owner) or (x.burned and not s.burned)"""


@query("state_diff", with_(R, DIFF))
def _(d):
    return reconcile.state_diff(d.stored_assets(), d.observed())


@query("observed_owner", with_(R, """
  select address, case when not burned then nullif(owner, '') end as owner from observed"""))
def _(d):
    from vitrine.functions.scalar import observed_owner
    return d.observed().select("address", observed_owner(F.col("owner"), F.col("burned")).alias("owner"))


@query("candidate_union", with_(R, """
  select id, source, 'recover' as action
  from (select id, cast(min(source) as int) as source from (
    select id, 0 as source from diff union all select id, 1 from stored where ownership_dirty
    union all select s.id, 2 from stored s join history h on h.asset_id = s.id and h.to_slot is null
      where s.owner is distinct from h.owner and s.membership_status = 'member'
        and s.collection_id in (select id from collections where enabled)
    union all select s.id, 2 from stored s where s.owner is not null and s.membership_status = 'member'
        and s.collection_id in (select id from collections where enabled)
        and s.id in (select asset_id from history) and s.id not in (select asset_id from history where to_slot is null))
    group by 1)""", diff=DIFF))
def _(d):
    from vitrine.operators import integrity, timeline
    stored = d.stored_assets()
    return reconcile.candidate_union(
        reconcile.state_diff(stored, d.observed()), timeline.dirty_assets(stored),
        integrity.drifted_assets(stored, d.collections(), d.ownership_history()))


PROBE = """
  select o.collection_id, o.address, o.rn, o.tracked, o.stale, coalesce(rn <= fin, true) as read from (
    select *, min(case when run = 20 and tracked and not stale then rn end) over (partition by collection_id) as fin from (
      select *, sum(case when tracked and not stale then 1 else 0 end)
          over (partition by collection_id, island order by rn) as run from (
        select *, sum(cast(stale as int)) over (partition by collection_id order by rn) as island from (
          select x.collection_id, x.address, x.rn, s.id is not null as tracked,
            s.id is not null and ((x.who is not null and s.owner is distinct from x.who) or (x.burned and not s.burned)) as stale
          from (select *, case when not burned then nullif(owner, '') end as who,
              row_number() over (partition by collection_id order by updated desc nulls last, address) as rn from observed) x
          left join stored s on s.address = x.address)))) o"""


@query("probe_stop_rule", with_(R, PROBE))
def _(d):
    return reconcile.probe_stop_rule(d.observed(), d.stored_assets())


WINDOW = """
  select asset_id, signature, slot, case when failed then 'park' else 'replay' end as action from (
    select g.* from signatures g join assets a on a.id = g.asset_id
    where g.slot > case when a.id % 4 = 0 then 3900 else a.last_activity_slot - 400 end)"""


@query("recovery_window", with_("assets signatures", WINDOW))
def _(d):
    known = d.assets().withColumn("last_activity_slot", F.when(F.col("id") % 4 != 0, F.col("last_activity_slot") - 400))
    return reconcile.recovery_window(d.signatures(), known, cursor=3900)


STALE = """
  select g.collection_id as run, g.asset_id as arrival, g.asset_id, case when g.asset_id % 3 <> 0 then 3000 end as floor,
    cast(count(*) filter (where slot > case when g.asset_id % 3 <> 0 then 3000 else 0 end) as bigint) as signatures
  from (select s.*, b.collection_id from signatures s join asset_base b on b.id = s.asset_id) g group by 1, 2, 3, 4"""


@query("probe_repair_plan", with_("asset_base signatures", """
  select run, asset_id, case when allowed and upto - need < 200 then coalesce(floor, 0) end as walk_from,
    case when allowed and upto - need < 200 then least(need, 200 - (upto - need)) else 0 end as walked,
    case when allowed and upto - need < 200 then 'walk' else 'owner_only' end as action
  from (select *, cast(sum(need) over (partition by run order by arrival) as bigint) as upto from (
    select *, case when allowed then signatures else 0 end as need from (
      select *, floor is not null or sum(cast(floor is null as int)) over (partition by run order by arrival) <= 5 as allowed
      from stale)))""", stale=STALE))
def _(d):
    home = d.asset_base().select(F.col("id").alias("asset_id"), "collection_id")
    floor = F.when(F.col("asset_id") % 3 != 0, F.lit(3000))
    stale = d.signatures().join(home, "asset_id").groupBy("collection_id", "asset_id").agg(
        F.count_if(F.col("slot") > F.coalesce(floor, F.lit(0))).alias("signatures")).select(
        F.col("collection_id").alias("run"), F.col("asset_id").alias("arrival"), "asset_id", floor.alias("floor"), "signatures")
    return reconcile.probe_repair_plan(stale)


@query("documents_to_fetch", with_("stored observed collections asset_documents", """
  select o.address, o.collection_id, u.uri from observed o join collections c on c.id = o.collection_id,
    lateral (select coalesce(replace(c.metadata_uri_template, '{mint}', o.address), o.metadata_uri) as uri) u
  left join stored s on s.address = o.address
  where s.id is null or s.id not in (select asset_id from asset_documents) or s.metadata_source_uri is distinct from u.uri"""))
def _(d):
    return reconcile.documents_to_fetch(d.observed(), d.collections(), d.stored_assets(), d.asset_documents())


# -- runs and deliveries -------------------------------------------------------------------------
LATEST = """select * from run_log qualify row_number() over (partition by collection_id, kind order by run_id desc) = 1"""


@query("run_log_upsert", with_("run_log", "select collection_id, kind, run_id, status, started_at, finished_at from latest",
                               latest=LATEST))
def _(d):
    return merge.run_log_upsert(d.run_log()).drop("progress")


@query("run_totals", with_("run_log", """
  select collection_id, kind, count(*) as runs, cast(sum(owners) as bigint) as owners, cast(sum(burned) as bigint) as burned,
    cast(sum(removed) as bigint) as removed, cast(sum(owners + burned + removed) as bigint) as corrections
  from run_log group by 1, 2"""))
def _(d):
    return runs.run_totals(d.run_log(), ["owners", "burned", "removed"])


@query("corrections", with_("run_log", """
  select collection_id, cast(sum(owners + burned + removed) as bigint) as corrections from run_log
  where kind = 'reconcile' group by 1"""))
def _(d):
    totals = runs.run_totals(d.run_log(), ["owners", "burned", "removed"])
    return totals.where(F.col("kind") == "reconcile").select("collection_id", "corrections")


@query("last_finished", with_("run_log collections", """
  select min(l.finished_at) as last_finished from collections c left join latest l
    on l.collection_id = c.id and l.kind = 'reconcile' where c.enabled""", latest=LATEST))
def _(d):
    return runs.last_finished(d.collections(), merge.run_log_upsert(d.run_log()), "reconcile")


@query("backfilled_slot", with_("run_log", "select max(r_slot) as slot from run_log where kind = 'assets'"))
def _(d):
    return runs.backfilled_slot(d.run_log())


@query("checkpoint_max", """
  select o_orderpriority as stream, max(o_orderkey * 7 % 100003) as slot from orders group by 1""")
def _(d):
    rows = d.raw("orders").select(F.col("o_orderpriority").alias("stream"), (F.col("o_orderkey") * 7 % 100003).alias("slot"),
                                  "o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    return merge.checkpoint_max(rows.where(even).drop("o_orderkey"), rows.where(~even).drop("o_orderkey"))


@query("stream_health", """
  select o_orderpriority as stream, max(o_orderkey * 7 % 100003) as last_slot,
    cast(epoch(timestamp '2002-01-01') - floor(epoch(max(o_orderdate))) as bigint) as age_seconds,
    epoch(timestamp '2002-01-01') - floor(epoch(max(o_orderdate))) > 86400 as wedged from orders group by 1""")
def _(d):
    rows = d.raw("orders").select(F.col("o_orderpriority").alias("stream"), (F.col("o_orderkey") * 7 % 100003).alias("slot"),
                                  F.col("o_orderdate").alias("updated_at"))
    return runs.stream_health(rows, "2002-01-01 00:00:00", 86400)


@query("watermark", with_("deliveries", """
  select least((select min(slot) - 1 from deliveries where processed_at is null),
    (select max(slot) from deliveries where processed_at < timestamp '2024-01-20' - interval 120 second)) as watermark"""))
def _(d):
    return runs.watermark(d.deliveries(), "2024-01-20 00:00:00", 120)


@query("delivery_health", with_("deliveries", """
  select count(*) filter (where processed_at is null and attempts < 10) as pending,
    count(*) filter (where processed_at is null and attempts >= 10) as gave_up from deliveries"""))
def _(d):
    return runs.delivery_health(d.deliveries())


RECORDED = """select event_id, signature, ts as block_time, case when user_id % 3 = 0 then 'webhook' else 'live' end as source
  from (select *, left(translate(md5('ae' || event_id) || md5('be' || event_id) || md5('ce' || event_id), '0', 'Z'), 88)
    as signature from events)"""


def recorded(d):
    e = F.col("event_id")
    return d.raw("events").select(
        e, signature(text("e", e)).alias("signature"), F.col("ts").alias("block_time"),
        F.when(F.col("user_id") % 3 == 0, "webhook").otherwise("live").alias("source"))


@query("delivered_anti", with_("deliveries", """
  select event_id, source from recorded r where not exists (select 1 from deliveries w where w.signature = r.signature)""",
                               recorded=RECORDED))
def _(d):
    return runs.delivered_anti(recorded(d), d.deliveries()).select("event_id", "source")


@query("coverage", with_("deliveries", """
  select 'missed_by_webhook' as metric, (select count(*) from recorded r where source = 'live'
      and block_time > timestamp '2024-01-25' - interval 20 day
      and not exists (select 1 from deliveries w where w.signature = r.signature)) as n
  union all select 'written_by_webhook', (select count(*) from recorded where source = 'webhook'
      and block_time > timestamp '2024-01-25' - interval 20 day)
  union all select 'pending', (select count(*) from deliveries where processed_at is null)""", recorded=RECORDED))
def _(d):
    return runs.coverage(recorded(d), d.deliveries(), "2024-01-25 00:00:00", "20 DAYS")


@query("latency_percentiles", """
  select event_type, count(*) as samples, list_sort(list(ms))[count(*) // 2 + 1] as p50,
    list_sort(list(ms))[count(*) * 95 // 100 + 1] as p95
  from (select event_type, cast(floor(value * 100) as bigint) as ms from events) group by 1""")
def _(d):
    samples = d.raw("events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("ms"))
    return runs.latency_percentiles(samples, "event_type", "ms")
