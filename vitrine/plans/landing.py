"""Landing of snapshots, documents, deliveries and files; live ownership; whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import scalar
from vitrine.operators import inventory, keys, registry, snapshots
from vitrine.operators.ordered import row_number, scan
from vitrine.plans import sqlbase
from vitrine.plans.common import Plans
from vitrine.plans.sqlbase import COLL, CTES, key, sig, with_
from vitrine.plans.state import UPSERTED
from vitrine.sources import feeds
from vitrine.sources.domain import key as spark_key
from vitrine.sources.domain import text
from vitrine.streaming import deliveries, ownership

plans = Plans()
query = plans.query

sqlbase.CTES["snap"] = ([], f"""
  select k, {key("'asset' || k")} as address, k % 31 = 0 as burnt,
    case when k % 17 = 0 then '' else {key("'wallet' || k")} end as owner,
    case when k % 3 = 0 then 'https://l/' || k || '.png' when k % 5 = 0 then 'https://f/' || k || '.png'
         when k % 5 = 1 then 'https://f/' || k || '.jpg' end as image,
    case when k % 9 <> 0 then p_name || ' #' || k end as name, case when k % 6 = 0 then '' else 'S' || (k % 10) end as symbol,
    'https://chain.example.com/' || k || '.json' as uri, p_type, p_size, {COLL} as n
  from (select *, p_partkey as k from part) where k % 29 <> 0""")
sqlbase.CTES["snaptraits"] = (["snap"], """
  select k, address, t.* from snap, lateral (values ('Type', p_type, 0), ('Size', cast(p_size as varchar), 1),
    ('Lit', 'true', 2), (' Pad', ' v ', 7)) t(trait_type, value, position) where k % 8 > 1""")
sqlbase.CTES["docs"] = ([], f"""
  select k, {key("'asset' || k")} as address, 'https://meta.example.com/' || {key("'asset' || k")} || '.json' as source_uri,
    case when k % 10 <> 0 then 'Doc ' || k end as name, case when k % 7 = 0 then 'D' end as symbol,
    case when k % 3 = 0 then 'https://d/' || k || '.png' when k % 3 = 1 then 'https://dp/' || k || '.png' end as image, p_type
  from (select *, p_partkey as k from part) where k % 4 <> 3""")
sqlbase.CTES["doctraits"] = (["docs"], """
  select k, address, t.* from docs, lateral (values ('Doc', cast(k % 50 as varchar), 0), ('Type', p_type, 1))
    t(trait_type, value, position) where k % 4 = 2""")
sqlbase.CTES["merged"] = (["snap", "docs"], """
  select s.k, s.n, s.address, coalesce(d.name, s.name, '') as name, coalesce(d.symbol, s.symbol) as symbol, s.uri as metadata_uri,
    d.source_uri as metadata_source_uri, coalesce(d.image, s.image) as image_uri, s.burnt as burned,
    case when not s.burnt then nullif(s.owner, '') end as owner, s.k % 4 in (1, 2) or s.k % 8 > 1 as observed
  from snap s left join docs d on d.k = s.k""")
sqlbase.CTES["mergedtraits"] = (["snaptraits", "doctraits"], """
  select * from doctraits where k % 29 <> 0 union all select * from snaptraits where k % 4 not in (1, 2)""")


# -- snapshots -----------------------------------------------------------------------
@query("land_snapshots", with_("snap", """
  select address, burnt, owner, uri as json_uri, name, symbol from snap"""))
def _(d):
    return snapshots.land_snapshots(feeds.snapshots(d)).select(
        "address", "burnt", "owner", F.col("content.json_uri").alias("json_uri"), F.col("content.metadata.name").alias("name"),
        F.col("content.metadata.symbol").alias("symbol"))


@query("land_snapshots_missing", f"select {key(chr(39) + 'asset' + chr(39) + ' || p_partkey')} as address from part where p_partkey % 29 = 0")
def _(d):
    return snapshots.missing_snapshots(d.asset_base().select("address"), snapshots.land_snapshots(feeds.snapshots(d)))


@query("asset_image", with_("snap", "select address, image from snap"))
def _(d):
    return snapshots.land_snapshots(feeds.snapshots(d)).select("address", scalar.asset_image(F.col("content")).alias("image"))


@query("document_image", with_("docs", "select address, image from docs"))
def _(d):
    return snapshots.land_documents_json(feeds.documents(d)).select("address", scalar.document_image(F.col("doc")).alias("image"))


@query("normalize_attributes", with_("snaptraits", "select address, trait_type, value, position from snaptraits"))
def _(d):
    rows = snapshots.land_snapshots(feeds.snapshots(d))
    return snapshots.normalize_attributes(rows, F.col("content.metadata.attributes"))


@query("snapshot_merge", with_("merged mergedtraits", """
  select m.address, m.name, m.symbol, m.metadata_uri, m.metadata_source_uri, m.image_uri, m.burned, m.owner,
    case when observed then coalesce(t.traits, '') end as traits
  from merged m left join (select address, string_agg(trait_type || '=' || value || '@' || position, ',' order by position) as traits
    from mergedtraits group by 1) t on t.address = m.address"""))
def _(d):
    merged = snapshots.snapshot_merge(
        snapshots.land_snapshots(feeds.snapshots(d)), snapshots.land_documents_json(feeds.documents(d)))
    traits = F.array_join(F.transform("attributes", lambda a: F.concat(
        a["trait_type"], F.lit("="), a["value"], F.lit("@"), a["position"].cast("string"))), ",")
    return merged.withColumn("traits", traits).drop("attributes")


# a store without every nineteenth asset: documents of some that nobody fetches now, old or equal documents of some that are fetched
AS_OF = "2024-03-03 00:00:00"
JOB = dict(
    storeddocs=f"""
  select k + 1 as asset_id, k, case when k % 8 = 3 then 'https://old.example.com/' || k || '.json' else 'https://meta.example.com/' || {key("'asset' || k")} || '.json' end as source_uri
  from (select p_partkey as k from part) where k % 19 <> 0 and k % 8 in (2, 3)""",
    jobdocs=f"""
  select k, address, source_uri, name, symbol, image from docs
  union all select k, {key("'asset' || k")}, source_uri, 'Old ' || k, null, null from storeddocs where k % 8 = 3""",
    jobmerged="""
  select s.k, s.n + case when s.k % 37 = 0 then 1 else 0 end as home, s.address, coalesce(d.name, s.name, '') as name, coalesce(d.symbol, s.symbol) as symbol,
    s.uri as metadata_uri, d.source_uri as metadata_source_uri, coalesce(d.image, s.image) as image_uri, s.burnt as burned,
    case when not s.burnt then nullif(s.owner, '') end as owner, s.k % 4 in (1, 2) or s.k % 8 > 1 as observed
  from snap s left join jobdocs d on d.k = s.k""",
    jobtraits="""
  select * from doctraits where k % 29 <> 0
  union all select k, address, 'Doc', 'old', 0 from jobmerged where k % 8 = 3 and k % 19 <> 0
  union all select * from snaptraits where k % 4 not in (1, 2) and not (k % 8 = 3 and k % 19 <> 0)""",
    batch="select address, home as collection_id, name, symbol, metadata_uri, metadata_source_uri, image_uri, burned, owner, cast(4300 as bigint) as owner_slot, home as ord from jobmerged",
    ups=UPSERTED,
    jobassets="""
  select coalesce(s.id, (select max(id) from stored) + row_number() over (partition by u.action order by u.address)) as id, u.*
  from ups u left join stored s on s.address = u.address""",
    accepted="select j.k, a.id as asset_id, a.collection_id from jobassets a join jobmerged j on j.address = a.address where a.action in ('inserted', 'updated', 'unchanged')",
    jobattributes="""
  select coalesce(o.asset_id, n.asset_id) as asset_id, coalesce(o.collection_id, n.collection_id) as collection_id,
    coalesce(o.trait_type, n.trait_type) as trait_type, coalesce(o.value, n.value) as value, coalesce(n.position, o.position) as position,
    case when o.asset_id is null then 'inserted' when n.asset_id is not null then case o.position when n.position then 'unchanged' else 'updated' end
      when coalesce(o.asset_id, n.asset_id) in (select a.asset_id from accepted a join jobmerged m on m.k = a.k and m.observed) then 'removed' else 'kept' end as action
  from (select * from asset_attributes where (asset_id - 1) % 19 <> 0) o
  full join (select a.asset_id, a.collection_id, t.trait_type, t.value, t.position from jobtraits t join accepted a on a.k = t.k) n
    on n.asset_id = o.asset_id and n.collection_id = o.collection_id and n.trait_type = o.trait_type and n.value = o.value""",
    jobstored="""
  select coalesce(o.asset_id, n.asset_id) as asset_id, case when n.asset_id is null then o.source_uri else n.source_uri end as source_uri,
    case when o.asset_id is null then 'inserted' when n.asset_id is null then 'kept' when o.k % 16 = 2 then 'unchanged' else 'updated' end as action
  from storeddocs o full join (select a.asset_id, d.source_uri from docs d join accepted a on a.k = d.k) n on n.asset_id = o.asset_id""")
JOB_NAMES = "snap snaptraits docs doctraits stored asset_attributes"


def job(d, stored=None, limited=False):
    k, a, i = F.col("id") - 1, F.col("asset_id"), F.col("p_partkey")
    homes = d.asset_base().select("address", F.when(k % 37 == 0, F.col("collection_id") + 1).otherwise(F.col("collection_id")).alias("collection_id"))
    old = feeds.glue('{"name":"Old ', i.cast("string"), '","attributes":[{"trait_type":"Doc","value":"old"}]}')
    address = spark_key(text("asset", i))
    documents = d.raw("part").where((i % 19 != 0) & (i % 8 == 3)).select(
        (i + 1).alias("asset_id"), old.alias("body"), feeds.glue("https://old.example.com/", i.cast("string"), ".json").alias("source_uri"))
    fetched = feeds.documents(d)
    documents = documents.unionByName(fetched.where((F.col("k") % 19 != 0) & (F.col("k") % 8 == 2)).select(
        (F.col("k") + 1).alias("asset_id"), F.when(F.col("k") % 16 == 2, F.col("body")).otherwise('{"name":"older"}').alias("body"), "source_uri"))
    tables = {
        "assets": d.stored_assets(), "attributes": d.asset_attributes().where((a - 1) % 19 != 0),
        "documents": documents.withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp")),
        "runs": d.spark.createDataFrame([(1, "assets", "running", 1), (2, "other", "done", 1)], "collection_id INT, kind STRING, status STRING, slot BIGINT"),
    } if stored is None else stored
    tables = {t: rows.select(*[F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind).alias(c)
                               for c, kind in (f.split() for f in snapshots.STORE[t].split(", "))]) for t, rows in tables.items()}
    return snapshots.snapshot_job(tables, snapshots.land_snapshots(feeds.snapshots(d)), fetched.select("address", "source_uri", "body"), homes, 4300, AS_OF, limited)


@query("snapshot_job", with_(JOB_NAMES, "select * from jobattributes", **JOB))
def _(d):
    return job(d)["attributes"]


@query("snapshot_job_assets", with_(JOB_NAMES, "select * from jobassets", **JOB))
def _(d):
    return job(d)["assets"]


@query("snapshot_job_documents", with_(JOB_NAMES, """
  select *, case when action in ('inserted', 'updated') then timestamp '2024-03-03' else timestamp '2024-01-01' end as fetched_at from jobstored""", **JOB))
def _(d):
    return job(d)["documents"].drop("body")


def counted(table, **columns):
    cells = ", ".join(f"count(*) filter (action in ({', '.join(repr(a) for a in actions)})) as {c}" for c, actions in columns.items())
    return f"(select collection_id, {cells} from {table} group by 1)"


RUNS = f"""
  select h.collection_id, 'assets' as kind, 'done' as status, cast(4300 as bigint) as slot, members, missing,
    {", ".join(f"coalesce({c}, 0) as {c}" for c in ("inserted", "updated", "unchanged", "skipped", "attributes_written", "attributes_removed", "documents"))}
  from (select n + case when k % 37 = 0 then 1 else 0 end as collection_id, count(*) as members, count(*) filter (k % 29 = 0) as missing
    from (select p_partkey as k, {COLL} as n from part) group by 1) h
  left join {counted("jobassets", inserted=["inserted"], updated=["updated"], unchanged=["unchanged"], skipped=["skipped_foreign"])} using (collection_id)
  left join {counted("jobattributes", attributes_written=["inserted", "updated"], attributes_removed=["removed"])} using (collection_id)
  left join {counted("(select a.collection_id, s.action from jobstored s join jobassets a on a.id = s.asset_id)", documents=["inserted", "updated"])} using (collection_id)"""


@query("snapshot_job_runs", with_(JOB_NAMES, f"""
  select * from runs union all select 2, 'other', 'done', 1, {", ".join(["null"] * 9)}""", **JOB, runs=RUNS))
def _(d):
    return job(d)["runs"].drop("started_at", "finished_at")


@query("snapshot_job_empty", with_("snap docs", """
  select row_number() over (order by address) as id, address, n + case when k % 37 = 0 then 1 else 0 end as collection_id, name, burned, owner,
    case when owner is not null then 4300 end as owner_slot, 'inserted' as action from merged""", merged=CTES["merged"][1]))
def _(d):
    nothing = {t: d.spark.createDataFrame([], schema) for t, schema in snapshots.STORE.items()}
    return job(d, nothing)["assets"].drop("symbol", "metadata_uri", "metadata_source_uri", "image_uri")


@query("deep_reconcile", with_(JOB_NAMES, """
  select collection_id, cast(sum(n) as bigint) as corrections from (
    select collection_id, count(*) filter (action in ('inserted', 'updated')) as n from jobassets group by 1
    union all select collection_id, count(*) filter (action in ('inserted', 'updated', 'removed')) from jobattributes group by 1
    union all select a.collection_id, count(*) filter (s.action in ('inserted', 'updated')) from jobstored s join jobassets a on a.id = s.asset_id group by 1)
  group by 1""", **JOB))
def _(d):
    return snapshots.deep_reconcile(job(d))


@query("land_documents", f"""
  select asset_id, action, case when action in ('inserted', 'updated') then timestamp '2024-03-03' else timestamp '2024-01-01' end
    as fetched_at from (
  select doc_id as asset_id, case when doc_id % 7 = 0 then 'inserted' when doc_id % 5 = 0 then 'kept'
    when doc_id % 3 = 1 then 'updated' when doc_id % 11 = 0 then 'updated' else 'unchanged' end as action
  from documents where not (doc_id % 7 = 0 and doc_id % 5 = 0))""")
def _(d):
    k = F.col("doc_id")
    n, lang = k.cast("string"), F.col("lang")
    first = feeds.glue('{"n":', n, ', "lang":"', lang, '"}')
    again = feeds.glue('{"lang":"', lang, '","n":', F.when(k % 3 == 1, (k + 1).cast("string")).otherwise(n), "}")
    rows = d.raw("documents")
    stored = rows.where(k % 7 != 0).select(k.alias("asset_id"), first.alias("body"), F.col("source").alias("source_uri"),
                                           F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"))
    fetched = rows.where(k % 5 != 0).select(k.alias("asset_id"), again.alias("body"), F.when(
        k % 11 == 0, F.lit("moved")).otherwise(F.col("source")).alias("source_uri"))
    return snapshots.land_documents(stored, fetched, "2024-03-03 00:00:00").select("asset_id", "action", "fetched_at")


# -- deliveries -------------------------------------------------------------------------
SIG = sig("('e' || (case when event_id % 10 = 9 then event_id - 1 else event_id end))")
LANDED = f"""
  select event_id as received, {SIG} as signature, cast(floor(floor(epoch(ts)) / 60) as bigint) as slot,
    make_timestamp(cast(floor(floor(epoch(ts)) / 60) * 60 * 1000000 as bigint)) as block_time, event_type = 'error' as failed,
    true as usable from events
  union all select event_id, null, case when event_id % 5 = 0 then 5 end, null, false, false from events
    where event_id % 4 <> 0 and event_id % 5 in (0, 1)"""


@query("land_deliveries", with_("", "select * from landed", landed=LANDED))
def _(d):
    return deliveries.land_deliveries(feeds.delivery_bodies(d)).drop("body")


@query("enqueue_dedup", with_("", """
  select signature, min(received) as received from landed where usable and received % 3 <> 0
    and signature not in (select signature from landed where usable and received % 3 = 0) group by 1""", landed=LANDED))
def _(d):
    rows = deliveries.land_deliveries(feeds.delivery_bodies(d)).where("usable")
    third = F.col("received") % 3 == 0
    return deliveries.enqueue_dedup(rows.where(third), rows.where(~third), ["received"]).select("signature", "received")


# -- live ownership ---------------------------------------------------------------------
def arrivals(d):
    """Stored events in a live order: mostly by slot, but every ninth arrives a month late."""
    late = F.when(F.col("id") % 9 == 0, F.lit(40)).otherwise(F.lit(0))
    return d.activity().withColumn("arrival", (F.col("slot") + late) * 1_000_000 + F.col("id") % 1_000_000)


def frontier(d):
    """Open intervals and asset rows before the events: some held, some observed later than many events, some burned."""
    i, none = F.col("id"), F.lit(None)
    burned, held, seen = i % 50 == 9, (i % 50 != 9) & (i % 6 == 0), (i % 50 != 9) & (i % 6 == 1)
    old = spark_key(text("walletold", i))
    return d.asset_base().where(burned | held | seen).select(
        i.alias("asset_id"), F.when(held, old).alias("open_owner"), F.when(held, F.lit(100)).cast("long").alias("open_from"), burned.alias("burned"),
        F.when(~burned, old).alias("owner"), F.when(held, F.lit(100)).when(seen, F.lit(1500)).otherwise(none).cast("long").alias("owner_slot"))


FRONTIER_SQL = f"""
  select id as asset_id, case when b then null when h then o end as open_owner, case when not b and h then 100 end as open_from, b as burned,
    case when not b then o end as owner, case when not b then case when h then 100 else 1500 end end as owner_slot
  from (select id, id % 50 = 9 as b, id % 6 = 0 as h, {key("'walletold' || id")} as o from asset_base where id % 50 = 9 or id % 6 < 2)"""
RECORDED = """
  with recursive ev as (
    select *, row_number() over (partition by asset_id order by arrival) as n from (
      select id, asset_id, slot, kind, from_owner, to_owner, (slot + case when id % 9 = 0 then 40 else 0 end) * 1000000 + id % 1000000 as arrival from activity)),
  st as (
    select a.asset_id, cast(0 as bigint) as n, f.open_owner, cast(f.open_from as bigint) as open_from, coalesce(f.burned, false) as burned, f.owner,
      cast(f.owner_slot as bigint) as owner_slot, cast(null as bigint) as id, false as opened, false as closed, false as dirty, false as owner_moved
    from (select distinct asset_id from ev) a left join fr f on f.asset_id = a.asset_id
    union all
    select asset_id, n, case when taken then to_owner else open_owner end, case when not taken then open_from when to_owner is not null then slot end,
      burned or (taken and kind = 'burn'), case when not moved then owner when kind <> 'burn' then to_owner end,
      case when not moved then owner_slot when kind <> 'burn' then slot end, id, taken and to_owner is not null, taken and open_owner is not null,
      kind in ('mint', 'transfer', 'sale', 'burn') and not taken, moved
    from (
      select *, taken and case kind when 'burn' then not burned
          else to_owner is not null and coalesce(slot > owner_slot, true) and to_owner is distinct from owner end as moved
      from (
        select e.*, s.open_owner, s.open_from, s.burned, s.owner, s.owner_slot,
          e.kind in ('mint', 'transfer', 'sale', 'burn') and coalesce(s.open_from <= e.slot, true) and (e.kind = 'burn' or not s.burned)
            and coalesce(s.open_owner = e.from_owner, true) as taken
        from st s join ev e on e.asset_id = s.asset_id and e.n = s.n + 1)))"""


@query("record_event", with_("activity asset_base", RECORDED + """
  select e.asset_id, e.arrival, e.id, e.slot, e.kind, st.opened, st.closed, st.dirty, case when st.opened then e.to_owner end as owner, st.owner_moved
  from st join ev e on e.asset_id = st.asset_id and e.n = st.n""", fr=FRONTIER_SQL))
def _(d):
    return ownership.record_events(arrivals(d), frontier(d))


@query("record_event_assets", with_("activity asset_base", RECORDED + """
  select f.asset_id as id, coalesce(s.burned, f.burned) as burned, case when s.asset_id is null then f.owner else s.owner end as owner,
    case when s.asset_id is null then f.owner_slot else s.owner_slot end as owner_slot
  from fr f left join (select * from st qualify row_number() over (partition by asset_id order by n desc) = 1) s on s.asset_id = f.asset_id""",
                                    fr=FRONTIER_SQL))
def _(d):
    before = frontier(d)
    rows = before.select(F.col("asset_id").alias("id"), "burned", "owner", "owner_slot")
    return ownership.asset_rows_after(rows, ownership.record_events(arrivals(d), before))


@query("record_event_clean", with_("history", """
  select asset_id, owner, from_slot, to_slot, opened_by, closed_by from history where asset_id not in (select asset_id from (
      select *, lag(to_owner) over w as po, lag(kind) over w as pk from activity window w as (partition by asset_id order by slot, seq, id))
    where from_owner <> po or pk = 'burn')"""))
def _(d):
    rows = scan(d.activity(), ["asset_id"], ["slot", "seq", "id"], {"arrival": row_number()})
    applied = ownership.record_events(rows, d.spark.createDataFrame([], ownership.FRONTIER))
    spans = ownership.live_intervals(applied)
    dirty = applied.where("dirty").select("asset_id").distinct()
    return spans.join(dirty, "asset_id", "left_anti")


# -- keys and registry --------------------------------------------------------------------
@query("key_audit", with_("asset_base", """
  select case when k % 11 = 3 then 'not_32_bytes' when k % 11 = 5 then 'bad_shape' when k % 11 = 7 then 'empty' else 'ok' end
    as verdict, count(*) as n from (select id - 1 as k from asset_base) group by 1"""))
def _(d):
    k = F.col("id") - 1
    spoiled = (F.when(k % 11 == 3, F.expr("substr(address, 2)")).when(k % 11 == 5, F.concat(F.lit("0"), "address"))
               .when(k % 11 == 7, F.lit("")).otherwise(F.col("address")))
    return keys.key_audit_counts(d.asset_base().select(spoiled.alias("address")), "address")


REGISTRY = f"""
  select slug, name, standard, address, program, verified_creator, update_authority, symbol, metadata_uri_template, enabled from (
    select * replace (case when id = 4 then 'Bad Slug' else slug end as slug, case when id = 5 then '' else name end as name,
      case when id = 6 then '0' || address when id = 9 then null else address end as address,
      case when id = 7 then 'TOOLONGSYMBOL' when id = 12 then 'C' else symbol end as symbol,
      case when id = 8 then 'http://x' else metadata_uri_template end as metadata_uri_template,
      case when id = 10 then {key("'p'")} else program end as program,
      case when id = 11 then null else standard end as standard, case when id = 14 then null else verified_creator end as verified_creator)
    from collections)
  union all select slug, name, standard, address, program, verified_creator, update_authority, symbol, metadata_uri_template, enabled
    from collections where id = 13"""
LISTED = """
  select c.slug, case when ascii(right(m.mint, 1)) = 97 then 'no key' else m.mint end as mint from collection_mints m join collections c on c.id = m.collection_id
    where c.id <> 17
  union all select c.slug, m.mint from collection_mints m join collections c on c.id = m.collection_id + 3
    where ascii(right(m.mint, 1)) = 98 and m.collection_id <> 17
  union all select c.slug, m.mint from collection_mints m join collections c on c.id = m.collection_id
    where ascii(right(m.mint, 1)) = 99 and m.collection_id <> 17"""


@query("dq_registry", with_("collections collection_mints tokens", """
  select slug as subject, problem from (
    select s.*, coalesce(l.n, 0) as n_mints, count(*) over (partition by s.slug) as copies from seeds s
    left join (select slug, count(*) as n from listed group by 1) l on l.slug = s.slug) s, lateral (values
    ('bad_slug', not regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*')), ('duplicate_slug', copies > 1),
    ('bad_name', length(name) not between 1 and 128),
    ('bad_address', not regexp_full_match(address, '[1-9A-HJ-NP-Za-km-z]{32,44}')),
    ('bad_symbol', length(symbol) not between 1 and 10),
    ('bad_template', not (starts_with(metadata_uri_template, 'https://') and contains(metadata_uri_template, '{mint}'))),
    ('core_with_token_fields', standard = 'core' and (verified_creator is not null or symbol is not null or update_authority is not null or n_mints > 0)),
    ('core_without_address', standard = 'core' and enabled and address is null),
    ('token_with_program', standard = 'token_metadata' and program is not null),
    ('token_unresolvable', standard = 'token_metadata' and enabled and address is null and verified_creator is null),
    ('allowlist_empty', standard = 'token_metadata' and address is null and verified_creator is not null and n_mints = 0),
    ('enabled_without_standard', standard is null and enabled),
    ('placeholder_with_keys', standard is null and (verified_creator is not null or symbol is not null or update_authority is not null
      or n_mints > 0 or address is not null or program is not null))) r(problem, hit) where hit
  union select mint, problem from (select mint, count(*) as n, count(distinct slug) as slugs from listed group by 1), lateral (values
    ('bad_mint', not regexp_full_match(mint, '[1-9A-HJ-NP-Za-km-z]{32,44}')), ('listed_twice', n > slugs), ('listed_elsewhere', slugs > 1))
    r(problem, hit) where hit
  union select mint, problem from (select *, count(*) over (partition by mint) as copies from named), lateral (values
    ('duplicate_token', copies > 1), ('bad_token_symbol', length(symbol) not between 1 and 10),
    ('bad_token_name', length(name) not between 1 and 128)) r(problem, hit) where hit""",
                             seeds=REGISTRY, listed=LISTED, named="""
      select mint, case when created_order % 6 = 1 then 'WAYTOOLONGSYM' else symbol end as symbol,
        case when created_order % 6 = 2 then '' else name end as name from tokens
      union all select mint, symbol, name from tokens where created_order % 6 = 3"""))
def _(d):
    i, c = F.col("id"), F.col
    every = d.collections()
    spoiled = every.select(
        "id", F.when(i == 4, "Bad Slug").otherwise(c("slug")).alias("slug"), F.when(i == 5, "").otherwise(c("name")).alias("name"),
        F.when(i != 11, c("standard")).alias("standard"),
        F.when(i == 6, F.concat(F.lit("0"), "address")).when(i != 9, c("address")).alias("address"),
        F.when(i == 10, spark_key("p")).otherwise(c("program")).alias("program"),
        F.when(i != 14, c("verified_creator")).alias("verified_creator"), "update_authority",
        F.when(i == 7, "TOOLONGSYMBOL").when(i == 12, "C").otherwise(c("symbol")).alias("symbol"),
        F.when(i == 8, "http://x").otherwise(c("metadata_uri_template")).alias("metadata_uri_template"),
        "enabled", "facet_exclude").drop("id")
    seeds = spoiled.unionByName(every.where(i == 13).select(*spoiled.columns))
    names = every.select(i.alias("collection_id"), "slug")
    mints = d.collection_mints().where(c("collection_id") != 17)
    end = F.ascii(F.right("mint", F.lit(1)))
    listed = mints.join(names, "collection_id").select("slug", F.when(end == 97, "no key").otherwise(c("mint")).alias("mint"))
    strangers = mints.where(end == 98).withColumn("collection_id", c("collection_id") + 3).join(names, "collection_id").select("slug", "mint")
    twice = mints.where(end == 99).join(names, "collection_id").select("slug", "mint")
    o, t = F.col("created_order"), d.tokens()
    tokens = t.select("mint", F.when(o % 6 == 1, "WAYTOOLONGSYM").otherwise(c("symbol")).alias("symbol"),
                      F.when(o % 6 == 2, "").otherwise(c("name")).alias("name")).unionByName(
        t.where(o % 6 == 3).select("mint", "symbol", "name"))
    return registry.dq_registry(seeds, listed.unionByName(strangers).unionByName(twice), tokens)


# -- files ------------------------------------------------------------------------------------
TRAITS_SQL = """case when k % 4 = 0 then '' when k % 4 = 1 then ',"attributes":[]' else
  ',"attributes":[{"trait_type":"Doc","value":' || (k % 50) || '},{"trait_type":"Type","value":"' || p_type || '"}]' end"""
FILES = f"""
  select k, 'meta/' || k || '.json' as path, case when k % 10 = 6 then left(body, length(body) - 1)
    when k % 10 = 2 then '[' || body || ']' else body end as content
  from (select k, '{{"name":"' || case when k % 10 = 0 then '' else 'Doc ' || k end || '",' || case when k % 7 = 0 then '"symbol":"D",' else '' end
      || '"image":"' || case when k % 3 = 0 then 'https://d/' || k || '.png' else '' end || '"' ||
      case when k % 3 = 1 then ',"properties":{{"files":[{{"uri":""}},{{"uri":"https://dp/' || k || '.png"}},{{"uri":"ar://' || k || '"}}]}}' else '' end
      || {TRAITS_SQL} || '}}' as body
    from (select *, p_partkey as k from part) where k % 4 <> 3)"""
INVENTORY = """
  select k, path, cast(octet_length(encode(content)) as bigint) as size, sha256(content) as sha256,
    case when k % 10 = 6 then 'not valid JSON' when k % 10 = 2 then 'not a JSON object' end as problem from files"""


def inventoried(d):
    return inventory.file_inventory(feeds.files(d))


@query("file_inventory", with_("", "select path, size, sha256, problem from inv", files=FILES, inv=INVENTORY))
def _(d):
    return inventoried(d)


@query("manifest_diff", with_("", """
  select coalesce(m.path, i.path) as path, case when m.n > 1 then 'DUPLICATE' when i.path is null then 'MISSING'
    when m.path is null then 'EXTRA' when m.sha <> i.sha256 then 'CHANGED' when i.problem is not null then 'UNREADABLE' else 'OK' end as status
  from (select path, count(*) as n, min(sha256) as sha from (
      select path, case when k % 13 = 0 then sha256('other') else sha256 end as sha256 from inv where k % 9 <> 1
      union all select path, sha256 from inv where k % 30 = 8
      union all select 'meta/gone' || k || '.json', sha256 from inv where k % 25 = 0) group by 1) m
  full join inv i on i.path = m.path""", files=FILES, inv=INVENTORY))
def _(d):
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    inv = inventoried(d).withColumn("k", k)
    other = F.sha2(F.lit("other").cast("binary"), 256)
    listed = inv.where(F.col("k") % 9 != 1).select("path", F.when(F.col("k") % 13 == 0, other).otherwise(F.col("sha256")).alias("sha256"))
    twice = inv.where(F.col("k") % 30 == 8).select("path", "sha256")
    gone = inv.where(F.col("k") % 25 == 0).select(text("meta/gone", F.col("k"), ".json").alias("path"), "sha256")
    return inventory.manifest_diff(listed.unionByName(twice).unionByName(gone), inv.drop("k"))


JOURNAL_SQL = """
  select 'set' || (user_id % 3) as "set", user_id as key, event_id as line_no, case when event_type = 'error' then 'missing' else 'ok' end as status,
    ts as fetched_at from events"""
LATEST = """
  select e."set", e.key, coalesce(j.status, 'never fetched') as status, j.line_no, j.fetched_at
  from (select 'set' || (c_custkey % 3) as "set", c_custkey as key from customer) e
  left join (select * from journal qualify row_number() over (partition by "set", key order by line_no desc) = 1) j
    on j."set" = e."set" and j.key = e.key"""


def latest_records(d):
    u, c = F.col("user_id"), F.col("c_custkey")
    journal = d.raw("events").select(
        text("set", u % 3).alias("set"), u.alias("key"), F.col("event_id").alias("line_no"),
        F.when(F.col("event_type") == "error", "missing").otherwise("ok").alias("status"), F.col("ts").alias("fetched_at"))
    expected = d.raw("customer").select(text("set", c % 3).alias("set"), c.alias("key"))
    return inventory.journal_latest(journal, expected)


@query("journal_latest", with_("", LATEST, journal=JOURNAL_SQL))
def _(d):
    return latest_records(d)


@query("manifest_summary", with_("", """
  select "set", count(*) as keys, count(*) filter (where good) as files, count(*) filter (where status <> 'ok') as absent,
    cast(coalesce(sum(i_size) filter (where good), 0) as bigint) as bytes, min(i_size) filter (where good) as smallest,
    max(i_size) filter (where good) as largest, min(fetched_at) filter (where good) as first_fetched,
    max(fetched_at) filter (where good) as last_fetched,
    count(*) filter (where status = 'ok' and not same) as differ, count(*) filter (where same and not good) as unproven,
    count(*) filter (where good and problem is not null) as content_problems
  from (select *, same and proven as good from (
    select l.*, i.size as i_size, i.problem, l.line_no % 6 <> 0 as proven,
      l.status = 'ok' and coalesce(i.path is not null and l.key % 8 <> 5, false) as same
    from latest l left join inv i on i.k = l.key)) group by 1""", journal=JOURNAL_SQL, latest=LATEST, files=FILES, inv=INVENTORY))
def _(d):
    inv = inventoried(d)
    size = inv.select("path", F.col("size").alias("s"), F.col("sha256").alias("h"))
    latest = latest_records(d).withColumn("path", text("meta/", F.col("key"), ".json")).join(size, "path", "left").select(
        "set", "key", "path", "status", F.when(F.col("key") % 8 == 5, F.col("s") + 1).otherwise(F.col("s")).alias("size"),
        F.col("h").alias("sha256"), (F.col("line_no") % 6 != 0).alias("proven"), "fetched_at")
    return inventory.manifest_summary(latest, inv)


RULES = [inventory.Rule("https://d/", ".png", "images", "png"), inventory.Rule("https://dp/", ".png", "old", "png")]


def kept_images(d):
    k = F.col("p_partkey")
    return d.raw("part").where(k % 5 != 0).select(text("images/", k, ".png").alias("path"))


def keyed_documents(d):
    return feeds.documents(d).select(text("meta/", F.col("k"), ".json").alias("path"), F.col("k").cast("string").alias("key"), "body")


@query("reference_closure", with_("docs", """
  select host, count(*) as n from (
    select case when k % 3 = 0 then 'd' else '(not a URL)' end as host from docs where k % 3 <> 0 or k % 5 = 0
    union all select unnest(['(not a URL)', 'dp', case when k >= 0 then cast(k as varchar) end]) from docs where k % 3 = 1) group by 1"""))
def _(d):
    return inventory.reference_closure(keyed_documents(d), RULES, kept_images(d))


@query("own_image_mismatch", with_("docs", """
  select 'meta/' || k || '.json' as path, case when k % 3 = 0 then image else '' end as image from docs where k % 3 <> 0"""))
def _(d):
    return inventory.own_image_mismatch(keyed_documents(d), F.concat(F.lit("https://d/"), "key", F.lit(".png")))


@query("pairing", with_("docs", """
  select k % 4 <> 0 as agrees, count(*) as n from docs where k % 3 = 1 group by 1"""))
def _(d):
    k = F.col("p_partkey")
    pairs = d.raw("part").select(k.cast("string").alias("key"), F.when(k % 4 == 0, k + 1).otherwise(k).cast("string").alias("other"))
    return inventory.pairing(keyed_documents(d), RULES, "old", pairs)
