"""Rarity, statistics, holders and wallets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators import rankstore, rarity, stats
from vitrine.plans.common import Plans
from vitrine.plans.sqlbase import key, with_
from vitrine.session import shared_dir
from vitrine.sources.domain import key as spark_key
from vitrine.sources.domain import text

plans = Plans()
query = plans.query

AS_OF = "2001-06-01 00:00:00"


FIXED_POINT = "((2 * members::hugeint * 1000000000000 + carriers) // (2 * carriers))"


def rarity_ctes(prefix: str, population: str) -> dict[str, str]:
    """Rarity over a population from the counts of present values and, for each type, of assets that lack it. Terms are
    in integer fixed point. Every asset starts from the sum of all its collection's lacking terms, less those of the
    types it has, plus the terms of its values."""
    p = prefix
    return {
        f"{p}pop": population,
        f"{p}own": f"""select id as asset_id, pop.collection_id, trait_type, value from {p}pop pop
            join asset_attributes on asset_id = id
            semi join (select distinct collection_id as cid, trait_type as kind from asset_attributes where is_facet)
              on cid = pop.collection_id and kind = trait_type""",
        f"{p}size": f"select collection_id, count(*) as members from {p}pop group by collection_id",
        f"{p}lack": f"""select collection_id, trait_type, members - count(distinct asset_id) as carriers, any_value(members) as members
            from (select distinct collection_id, trait_type from asset_attributes where is_facet)
            join {p}size using (collection_id) left join {p}own using (collection_id, trait_type)
            group by collection_id, trait_type, members having members > count(distinct asset_id)""",
        f"{p}freq": f"""select collection_id, trait_type, value, count(*) as carriers from {p}own group by all
            union all select collection_id, trait_type, null, carriers from {p}lack""",
        f"{p}worth": f"select *, {FIXED_POINT} as term from {p}freq join {p}size using (collection_id)",
        f"{p}scored": f"""select asset_id, collection_id, cast((2 * sum(part)::hugeint + 1000000) // 2000000 as bigint) as millionths
            from (select id as asset_id, pop.collection_id, term as part from {p}pop pop
                left join {p}worth w on w.collection_id = pop.collection_id and value is null
              union all select distinct on (asset_id, o.trait_type) asset_id, o.collection_id, -term
                from {p}own o join {p}worth w on w.collection_id = o.collection_id and w.trait_type = o.trait_type and w.value is null
              union all select asset_id, o.collection_id, term
                from {p}own o join {p}worth w on (w.collection_id, w.trait_type, w.value) = (o.collection_id, o.trait_type, o.value))
            group by asset_id, collection_id having count(part) > 0""",
        f"{p}ranked": f"""select asset_id, collection_id, millionths / 1e6 as rarity_score,
            cast(row_number() over (partition by collection_id order by millionths desc, asset_id) as int) as rarity_rank
            from {p}scored""",
        # every asset with every type of its collection, for the queries that show the cells
        f"{p}cell": f"""select asset_id, collection_id, trait_type, value from {p}own union all
            select asset_id, collection_id, trait_type, null from (
              select id as asset_id, collection_id, trait_type from {p}pop join {p}lack using (collection_id)
              except select asset_id, collection_id, trait_type from {p}own)""",
        f"{p}terms": f"""select asset_id, c.collection_id, c.trait_type, c.value, carriers, members as n, term from {p}cell c
            join {p}worth w on w.collection_id = c.collection_id and w.trait_type = c.trait_type and coalesce('=' || w.value, '') = coalesce('=' || c.value, '')""",
    }


NOW = rarity_ctes("", "select id, collection_id from members")
# Before the removals: everything was a member.
BEFORE = rarity_ctes("old", "select id, collection_id from asset_base")
R = "members asset_attributes collections"


def stored_ranks(d):
    everyone = d.asset_base().withColumn("membership_status", F.lit("member"))
    return rarity.rarity_rank(everyone, d.asset_attributes())


@query("cell_matrix", with_(R, "select * from cell", **NOW))
def _(d):
    return rarity.cell_matrix(d.assets(), d.asset_attributes())


@query("null_safe_freq_join", with_(R, "select asset_id, collection_id, trait_type, value, carriers from terms", **NOW))
def _(d):
    return rarity.null_safe_freq_join(d.assets(), d.asset_attributes())


@query("rarity_freq", with_(R, "select * from freq", **NOW))
def _(d):
    return rarity.rarity_freq(d.assets(), d.asset_attributes())


@query("rarity_score", with_(R, "select asset_id, collection_id, millionths / 1e6 as score from scored", **NOW))
def _(d):
    return rarity.rarity_score(d.assets(), d.asset_attributes()).withColumn("score", F.col("score").cast("double"))


@query("rarity_rank", with_(R, "select * from ranked", **NOW))
def _(d):
    return rarity.rarity_rank(d.assets(), d.asset_attributes())


@query("rarity_rankable", with_(R, """
  select id, slug from collections where id in (select collection_id from asset_attributes where is_facet)"""))
def _(d):
    return rarity.rarity_rankable(d.collections(), d.asset_attributes()).select("id", "slug")


@query("rarity_cells", with_(R, """
  select asset_id, collection_id, trait_type, value, carriers, cast(term as double) / 1e12 as term from terms""", **NOW))
def _(d):
    return rarity.rarity_terms(d.assets(), d.asset_attributes()).withColumn("term", F.col("term").cast("double"))


EXPLAINED = key("'asset100'")


@query("rarity_explain", with_(R, f"""
  select trait_type, value, carriers, cast(term as double) / 1e12 as term from terms
  where asset_id = (select id from assets where address = {EXPLAINED})""", **NOW))
def _(d):
    return rarity.rarity_explain(d.assets(), d.asset_attributes(), spark_key(text("asset", F.lit(100))))


APPLIED = """
  select coalesce(r.asset_id, o.asset_id) as asset_id, coalesce(r.collection_id, o.collection_id) as collection_id,
    r.rarity_score, r.rarity_rank, r.asset_id is not null as ranked,
    (r.rarity_score, r.rarity_rank) is distinct from (o.rarity_score, o.rarity_rank) as changed
  from ranked r full join oldranked o on o.asset_id = r.asset_id"""


@query("rarity_apply", with_(R, APPLIED, **NOW, **BEFORE))
def _(d):
    return rarity.rarity_apply(stored_ranks(d), rarity.rarity_rank(d.assets(), d.asset_attributes()))


@query("rarity_apply_counts", with_(R, f"""
  select c.id as collection_id, count(*) filter (where a.ranked) as ranked, count(*) filter (where a.changed) as changed,
    cast(any_value(c.rarity_version) + case when count(*) filter (where a.changed) > 0 then 1 else 0 end as int)
      as rarity_version
  from collections c left join ({APPLIED}) a on a.collection_id = c.id group by 1""", **NOW, **BEFORE))
def _(d):
    applied = rarity.rarity_apply(stored_ranks(d), rarity.rarity_rank(d.assets(), d.asset_attributes()))
    return rarity.rarity_apply_counts(applied, d.collections())


@query("rarity_verify", with_(R, """
  select r.collection_id, count(*) as assets,
    count(*) filter (where r.rarity_score is distinct from o.rarity_score) as mismatches
  from ranked r left join oldranked o on o.asset_id = r.asset_id group by 1""", **NOW, **BEFORE))
def _(d):
    return rarity.rarity_verify(d.assets(), d.asset_attributes(), stored_ranks(d))


def second_pass(d) -> str:
    """A store that ranked everyone before the removals, then the collections that are flagged dirty."""
    def build():
        store = f"{shared_dir(d.spark)}/stores/{uuid.uuid4().hex}"
        by = rankstore.BY
        rankstore.write_by_collection(d.asset_base().withColumn("membership_status", F.lit("member")), f"{store}/before", "id")
        rankstore.write_by_collection(d.assets(), f"{store}/assets", "id")
        rankstore.write_by_collection(d.asset_attributes(), f"{store}/attributes", "asset_id")
        before, assets, attributes = (d.spark.read.parquet(f"{store}/{t}") for t in ("before", "assets", "attributes"))
        rankstore.mark_dirty(d.collections().select(F.col("id").alias(by)), store)
        rankstore.recompute(d.spark, store, before, attributes)
        rankstore.mark_dirty(d.collections().where("rarity_dirty").select(F.col("id").alias(by)), store)
        rankstore.recompute(d.spark, store, assets, attributes)
        return store
    return d.once("rank_store", build)


DIRTY = "in (select id from collections where rarity_dirty)"


@query("rarity_recompute", with_(R, f"""
  select asset_id, collection_id, rarity_score, rarity_rank from ranked where collection_id {DIRTY} union all
  select asset_id, collection_id, rarity_score, rarity_rank from oldranked where collection_id not {DIRTY}""", **NOW, **BEFORE))
def _(d):
    return rankstore.stored_ranks(d.spark, second_pass(d)).select("asset_id", "collection_id", "rarity_score", "rarity_rank")


@query("rarity_passes", with_(R, f"""
  select c.id as collection_id, false as rarity_dirty,
    cast(c.rarity_version + cast(count(o.asset_id) > 0 as int)
      + cast(rarity_dirty and count(*) filter (where a.changed) > 0 as int) as int) as rarity_version,
    case when rarity_dirty then count(*) filter (where a.ranked) else count(o.asset_id) end as ranked,
    case when rarity_dirty then count(*) filter (where a.changed) else count(o.asset_id) end as changed
  from collections c left join ({APPLIED}) a on a.collection_id = c.id left join oldranked o on o.asset_id = a.asset_id
  group by c.id, c.rarity_version, c.rarity_dirty""", **NOW, **BEFORE))
def _(d):
    return rankstore.rank_state(d.collections(), second_pass(d))


@query("not_ranked_anti", with_(R, """
  select * from oldranked where asset_id not in (select asset_id from ranked)""", **NOW, **BEFORE))
def _(d):
    return rarity.not_ranked_anti(stored_ranks(d), rarity.rarity_score(d.assets(), d.asset_attributes()))


STATS = f"""
  with of_members as (
    select collection_id as id, sum(cast(not burned as int)) as alive, count(distinct owner) as holders,
      sum(cast(burned as int)) as burned, count(*) as indexed, max(last_activity_at) as last_activity_at
    from members group by collection_id),
  of_events as (
    select collection_id as id, sum(cast(age <= interval 24 hour as int)) as day, count(*) as week
    from (select collection_id, timestamp '{AS_OF}' - block_time as age from activity) where age <= interval 7 day group by collection_id)
  select id as collection_id, cast(coalesce(alive, 0) as bigint) as supply, coalesce(holders, 0) as holders,
    cast(coalesce(day, 0) as bigint) as activity_24h, coalesce(week, 0) as activity_7d,
    cast(coalesce(m.burned, 0) as bigint) as burned, coalesce(indexed, 0) as indexed, last_activity_at
  from collections left join of_members m using (id) left join of_events using (id)"""
HELD = """select collection_id, owner, count(*) as held from members where owner is not null group by 1, 2"""
BUCKETED = """
  select c.id as collection_id, b.label, b.min_count, b.max_count, count(h.owner) as holders,
    cast(coalesce(sum(h.held), 0) as bigint) as assets
  from collections c cross join (values ('1', 1, 1), ('2-5', 2, 5), ('6-20', 6, 20), ('21+', 21, null))
    b(label, min_count, max_count)
  left join held h on h.collection_id = c.id and h.held >= b.min_count and h.held <= coalesce(b.max_count, 1000000000)
  group by 1, 2, 3, 4"""
RANKED = """
  select collection_id, owner as address, held as "count",
    rank() over (partition by collection_id order by held desc) as rank from held
  where collection_id in (select id from collections where enabled)"""
S = "members activity collections"


@query("collection_stats", with_(S, STATS))
def _(d):
    return stats.collection_stats(d.collections(), d.assets(), d.activity(), AS_OF)


@query("holder_buckets", with_(S, BUCKETED, held=HELD))
def _(d):
    return stats.holder_buckets(d.collections(), d.assets())


@query("collections_overview", with_(S, """
  select s.*, c.slug, c.name, b.j as holder_buckets from stats s join collections c on c.id = s.collection_id
  join (select collection_id, '[' || string_agg('{"label":"' || label || '","holders":' || holders || ',"assets":'
     || assets || '}', ',' order by min_count) || ']' as j from cohorts group by 1) b
  on b.collection_id = s.collection_id where c.enabled""", stats=STATS, held=HELD, cohorts=BUCKETED))
def _(d):
    return stats.collections_overview(d.collections(), d.assets(), d.activity(), AS_OF)


@query("holder_rank", with_(S, RANKED, held=HELD))
def _(d):
    return stats.holder_rank(d.collections(), d.assets())


@query("top_holders", with_(S, "select * from ranks where collection_id = 13 order by rank, address limit 10",
                            held=HELD, ranks=RANKED))
def _(d):
    return stats.top_holders(d.collections(), d.assets(), 13, 10)


WALLET_SQL = key("'wallet55'")


def a_wallet(d):
    return spark_key(text("wallet", F.lit(55)))


@query("wallet_holder_ranks", with_(S, f"select * from ranks where address = {WALLET_SQL}", held=HELD, ranks=RANKED))
def _(d):
    return stats.wallet_holder_ranks(d.collections(), d.assets(), a_wallet(d))


@query("wallet_collections_join", with_(S, """
  select m.owner, m.id, m.collection_id, c.slug from members m join collections c on c.id = m.collection_id
  where c.enabled and m.owner is not null"""))
def _(d):
    return stats.wallet_collections_join(d.collections(), d.assets())


HOLDS = "owner is not null and collection_id in (select id from collections where enabled)"


@query("wallet_total", with_(S, f"select owner, count(*) as total from members where {HOLDS} group by 1"))
def _(d):
    return stats.wallet_total(d.collections(), d.assets())


@query("wallet_holdings", with_(S, f"""
  select owner, collection_id, count(*) as "count" from members where {HOLDS} group by 1, 2"""))
def _(d):
    return stats.wallet_holdings(d.collections(), d.assets())


@query("wallet_page", with_(S, f"""
  select collection_id, id, address, name from members
  where {HOLDS} and owner = {WALLET_SQL} and (collection_id, id) > (1, 50) order by 1, 2 limit 24"""))
def _(d):
    return stats.wallet_page(d.collections(), d.assets(), a_wallet(d), after=(1, 50))


@query("wallet_portfolio", with_(S, """
  select r.address, cast(sum("count") over (partition by r.address) as bigint) as total_count, c.slug, "count",
    rank as holder_rank from ranks r join collections c on c.id = r.collection_id""", held=HELD, ranks=RANKED))
def _(d):
    return stats.wallet_portfolio(d.collections(), d.assets())


@query("member_count", with_(S, "select collection_id, count(*) as members from members group by 1"))
def _(d):
    return stats.member_count(d.assets())
