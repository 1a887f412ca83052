"""Predicates, joins, facets, pages and search over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import scalar
from vitrine.operators import browse, facets, predicates
from vitrine.plans.common import Plans
from vitrine.plans.ranking import NOW
from vitrine.plans.sqlbase import COLL, key, with_
from vitrine.sources.domain import key as spark_key
from vitrine.sources.domain import text

plans = Plans()
query = plans.query

# The request of the facet and page queries.
SELECTIONS = {"Size": ["1", "2", "3"], "Finish": ["red", "small", "green"], "Type": ["ECONOMY", "STANDARD"]}
ONE_RARE = {"Size": ["1", "2", "3"], "Finish": ["no such finish"]}
SQL_SELECTED = {t: f"trait_type = '{t}' and value in (" + ", ".join(f"'{v}'" for v in vs) + ")"
                for t, vs in SELECTIONS.items()}


def sql_match(asset: str, selections: dict, skip: str = "") -> str:
    """Brute force: an EXISTS per chosen type, leaving out the type of the row in hand."""
    out = []
    for t, vs in selections.items():
        values = ", ".join(f"'{v}'" for v in vs)
        exists = (f"exists (select 1 from asset_attributes s where s.asset_id = {asset} "
                  f"and s.trait_type = '{t}' and s.value in ({values}))")
        out.append(f"({skip} = '{t}' or {exists})" if skip else exists)
    return " and ".join(out)


CARD = ("collection_id, id, address, name, number, image_uri, image_status, burned, owner, last_activity_at")


@query("population", with_("members", "select id, collection_id, address, burned from members"))
def _(d):
    return predicates.population(d.assets()).select("id", "collection_id", "address", "burned")


@query("enabled_gate", with_("activity collections", """
  select a.id, a.collection_id, a.kind from activity a
  where exists (select 1 from collections c where c.id = a.collection_id and c.enabled)"""))
def _(d):
    return predicates.enabled_gate(d.activity(), d.collections()).select("id", "collection_id", "kind")


BASE58 = "[1-9A-HJ-NP-Za-km-z]"


@query("is_pubkey", with_("asset_base", f"""
  select id, candidate, regexp_full_match(candidate, '{BASE58}{{32,44}}') as valid from (
    select id, case when id % 7 = 0 then '0' || address else left(address || address, cast(id % 60 + 5 as int)) end
      as candidate from asset_base)"""))
def _(d):
    a = d.asset_base()
    cut = F.left(F.concat("address", "address"), (F.col("id") % 60 + 5).cast("int"))
    candidate = F.when(F.col("id") % 7 == 0, F.concat(F.lit("0"), "address")).otherwise(cut)
    return a.select("id", candidate.alias("candidate"), scalar.is_pubkey(candidate).alias("valid"))


@query("is_signature", with_("deliveries", f"""
  select id, candidate, regexp_full_match(candidate, '{BASE58}{{86,88}}') as valid from (
    select id, left(signature, cast(80 + id % 9 as int)) as candidate from deliveries)"""))
def _(d):
    candidate = F.left("signature", (80 + F.col("id") % 9).cast("int"))
    return d.deliveries().select("id", candidate.alias("candidate"), scalar.is_signature(candidate).alias("valid"))


@query("token_number", """
  select p_partkey, name,
    try_cast(nullif(regexp_extract(name, '#\\s*(\\d{1,9})(?:\\D|$)', 1), '') as int) as number
  from (select p_partkey, case p_partkey % 5 when 0 then p_name || ' #' || p_partkey
      when 1 then p_name || ' # ' || p_partkey || ' of 9' when 2 then '#12345678901'
      when 3 then p_name when 4 then p_name || '#' || p_partkey || '#7' end as name from part)""")
def _(d):
    k = F.col("p_partkey")
    name = (F.when(k % 5 == 0, text(F.col("p_name"), " #", k)).when(k % 5 == 1, text(F.col("p_name"), " # ", k, " of 9"))
            .when(k % 5 == 2, "#12345678901").when(k % 5 == 3, F.col("p_name"))
            .otherwise(text(F.col("p_name"), "#", k, "#7")))
    return d.raw("part").select("p_partkey", name.alias("name"), scalar.token_number(name).alias("number"))


@query("membership_rule", with_("collections", "select id, standard, membership_rule from collections"))
def _(d):
    rule = scalar.membership_rule(F.col("standard"), F.col("address"), F.col("verified_creator"))
    return d.collections().select("id", "standard", rule.alias("membership_rule"))


@query("metadata_source_uri", with_("asset_base collections", """
  select a.id, coalesce(replace(c.metadata_uri_template, '{mint}', a.address), a.metadata_uri) as uri
  from asset_base a join collections c on c.id = a.collection_id"""))
def _(d):
    c = d.collections().select(F.col("id").alias("collection_id"), "metadata_uri_template")
    uri = scalar.metadata_source_uri(F.col("metadata_uri_template"), F.col("address"), F.col("metadata_uri"))
    return d.asset_base().join(c, "collection_id").select("id", uri.alias("uri"))


TEXTS = ["  RING ", "#12", "12", "111111SYNa"]


@query("q_filter", with_("members", """
  select 'ring' as q, id from members where starts_with(address, 'RING') or contains(lower(name), 'ring')
  union all select '#12', id from members where number = 12 or contains(name, '#12')
  union all select '12', id from members where number = 12 or contains(name, '12') or starts_with(address, '12')
  union all select '111111synA', id from members where starts_with(address, '111111SYNa')
    or contains(lower(name), '111111syna')"""))
def _(d):
    members = predicates.population(d.assets())
    names = ["ring", "#12", "12", "111111synA"]
    hits = [F.when(predicates.matches_text(q), F.lit(n)) for q, n in zip(TEXTS, names)]
    # one pass over the members for all texts
    return members.select("id", F.explode(F.array_compact(F.array(*hits))).alias("q"))


NEEDLES = ["%%%", "_A", "***", "<P>", "100%"]


@query("like_escape", r"""
  select page_id, '%%%' as needle from pages where html ilike '%\%\%\%%' escape '\'
  union all select page_id, '_A' from pages where html ilike '%\_A%' escape '\'
  union all select page_id, '***' from pages where html ilike '%***%' escape '\'
  union all select page_id, '<P>' from pages where html ilike '%<P>%' escape '\'
  union all select page_id, '100%' from pages where html ilike '%100\%%' escape '\'""")
def _(d):
    hits = [F.when(predicates.contains_literal("html", n), F.lit(n)) for n in NEEDLES]
    return d.raw("pages").select("page_id", F.explode(F.array_compact(F.array(*hits))).alias("needle"))


@query("trait_filter", with_("assets asset_attributes members",
                             f"select id, collection_id from members m where {sql_match('m.id', SELECTIONS)}"))
def _(d):
    return predicates.trait_filter(
        predicates.population(d.assets_by_id()), d.attributes_by_asset(), SELECTIONS).select("id", "collection_id")


# The per-asset names are no facet, but may be chosen.
NAMED = {"Name": ["old anvil #14", "old plate #14", "cold gizmo #10", "large anvil #10", "large widget #10", "new plate #11", "small anvil #11",
                  "old gear #11", "old ring #12", "red bolt #12", "red rod #12", "hot rod #25", "blue rod #25"], "Size": ["0", "1", "2", "3"]}


@query("trait_filter_named", with_("asset_attributes members", f"select id, collection_id from members m where {sql_match('m.id', NAMED)}"))
def _(d):
    return predicates.trait_filter(predicates.population(d.assets_by_id()), d.attributes_by_asset(), NAMED).select("id", "collection_id")


@query("kind_filter", with_("activity", "select id, kind from activity where kind in ('sale', 'burn')"))
def _(d):
    return predicates.kind_filter(d.activity(), ["sale", "burn"]).select("id", "kind")


SEARCH_INPUTS = f"""
  select case k % 6 when 0 then address when 1 then '#' || lpad(cast(k as varchar), 6, '0') when 2 then p_name
      when 3 then cast(k as varchar) when 4 then 'brand-' || (k % 30) else {key("'wallet' || k")} end as q
  from (select p_partkey as k, p_name, {key("'asset' || p_partkey")} as address from part)"""


def search_inputs(d):
    k = F.col("p_partkey")
    q = (F.when(k % 6 == 0, spark_key(text("asset", k)))
         .when(k % 6 == 1, F.concat(F.lit("#"), F.lpad(k.cast("string"), 6, "0"))).when(k % 6 == 2, F.col("p_name"))
         .when(k % 6 == 3, k.cast("string")).when(k % 6 == 4, text("brand-", k % 30))
         .otherwise(spark_key(text("wallet", k))))
    return d.raw("part").select(q.alias("q"))


INTERPRET = f"""
  select q, case when regexp_full_match(q, '{BASE58}{{32,44}}') then 'address'
                 when regexp_full_match(q, '#?[0-9]{{1,9}}') then 'number' else 'text' end as interpreted_as,
    case when regexp_full_match(q, '#?[0-9]{{1,9}}') then cast(ltrim(q, '#') as int) end as number from inputs"""


@query("search_interpret", with_("", INTERPRET, inputs=SEARCH_INPUTS))
def _(d):
    return browse.search_interpret(search_inputs(d))


# -- joins ------------------------------------------------------------------
@query("attr_value_join", with_("members asset_attributes", """
  select m.id, m.collection_id, a.trait_type, a.value, a.position, a.is_facet
  from members m join asset_attributes a on a.asset_id = m.id"""))
def _(d):
    members = predicates.population(d.assets_by_id()).select("id")
    a = d.attributes_by_asset()
    return members.join(a, F.col("id") == F.col("asset_id")).select(
        "id", "collection_id", "trait_type", "value", "position", "is_facet")


@query("selection_unnest_join", with_("asset_attributes", """
  select a.asset_id, a.trait_type, a.value from asset_attributes a
  join (values ('Size', '1'), ('Size', '2'), ('Size', '3'), ('Finish', 'red'), ('Finish', 'small'),
               ('Finish', 'green'), ('Type', 'ECONOMY'), ('Type', 'STANDARD')) s(t, v)
  on s.t = a.trait_type and s.v = a.value"""))
def _(d):
    return d.asset_attributes().where(predicates.selected(SELECTIONS)).select("asset_id", "trait_type", "value")


# -- facets -----------------------------------------------------------------
@query("facet_counts", with_("facets", """
  select collection_id, trait_type, value, count(*) as n from facets group by all"""))
def _(d):
    return facets.facet_counts(d.assets_by_id(), d.attributes_by_asset())


def disjunctive_sql(selections, extra="true"):
    return (f"select f.collection_id, f.trait_type, f.value, count(*) as n from facets f join members m "
            f"on m.id = f.asset_id where {sql_match('f.asset_id', selections, 'f.trait_type')} and {extra} "
            "group by all")


@query("facet_disjunctive", with_("facets", disjunctive_sql(SELECTIONS)))
def _(d):
    return facets.facet_disjunctive(d.assets_by_id(), d.attributes_by_asset(), SELECTIONS)


@query("facet_disjunctive_rare", with_("facets", disjunctive_sql(ONE_RARE)))
def _(d):
    return facets.facet_disjunctive(d.assets_by_id(), d.attributes_by_asset(), ONE_RARE)


@query("facet_disjunctive_named", with_("facets", disjunctive_sql(NAMED)))
def _(d):
    return facets.facet_disjunctive(d.assets_by_id(), d.attributes_by_asset(), NAMED)


@query("facet_disjunctive_text", with_("facets", disjunctive_sql(
    {"Size": ["1", "2", "3"]}, "(contains(lower(m.name), 'ring') or starts_with(m.address, 'ring'))")))
def _(d):
    return facets.facet_disjunctive(d.assets_by_id(), d.attributes_by_asset(), {"Size": ["1", "2", "3"]}, q="ring")


@query("filtered_total", with_("members asset_attributes", f"""
  select collection_id, count(*) as total from members m where {sql_match('m.id', SELECTIONS)} group by 1"""))
def _(d):
    return facets.filtered_total(d.assets_by_id(), d.attributes_by_asset(), SELECTIONS)


@query("facets_response", with_("facets", f"""
  select c.slug, coalesce(t.total, 0) as total, g.trait_type, g."values"
  from collections c
  left join (select collection_id, count(*) as total from members m where {sql_match('m.id', SELECTIONS)} group by 1) t
    on t.collection_id = c.id
  left join (select collection_id, trait_type,
       '[' || string_agg('{{"value":"' || value || '","count":' || n || '}}', ',' order by n desc, value) || ']' as "values"
     from ({disjunctive_sql(SELECTIONS)}) group by 1, 2) g on g.collection_id = c.id
  where c.enabled"""))
def _(d):
    return facets.facets_response(d.collections(), d.assets_by_id(), d.attributes_by_asset(), SELECTIONS)


@query("trait_cardinality", with_("asset_attributes", """
  select collection_id, trait_type, is_facet, count(distinct value) as "values", count(distinct asset_id) as assets
  from asset_attributes group by all"""))
def _(d):
    return facets.trait_cardinality(d.attributes_by_asset())


def with_unexcluded_names(d):
    """The attributes before anyone excluded the per-asset Name trait."""
    return d.asset_attributes().withColumn("is_facet", F.lit(True))


@query("facet_cardinality_warn", with_("asset_attributes", """
  select collection_id, trait_type, true as is_facet, count(distinct value) as "values",
    count(distinct asset_id) as assets
  from asset_attributes group by 1, 2 having count(distinct asset_id) >= 20
    and count(distinct value) > 0.5 * count(distinct asset_id)"""))
def _(d):
    return facets.facet_cardinality_warn(with_unexcluded_names(d), min_assets=20)


@query("bench_scenarios", with_("facets", """
  select collection_id, trait_type, value, n, case place when 0 then 'commonest' when 1 then 'second'
    when k * 30 // 100 then 'p30' when k - 1 then 'rarest' end as role
  from (select *, row_number() over (partition by collection_id, trait_type order by n desc, value) - 1 as place,
          count(*) over (partition by collection_id, trait_type) as k
        from (select collection_id, trait_type, value, count(*) as n from facets group by all))
  where place in (0, 1, k * 30 // 100, k - 1)"""))
def _(d):
    return facets.bench_scenarios(d.assets_by_id(), d.attributes_by_asset())


# -- pages ------------------------------------------------------------------
PAGE_OF = 13


def page(name, order, sort, where="true", **args):
    ranked = sort.endswith("rarity")
    rows = "(select members.*, rarity_score, rarity_rank from members left join ranked on asset_id = id)" if ranked else "members"
    sql = with_("members asset_attributes" + " collections" * ranked, f"""
      select {CARD}{", rarity_score, rarity_rank" if ranked else ""}, {order[0]} as sort_key from {rows} m
      where collection_id = {PAGE_OF} and {where} order by {order[0]} {order[1]}, id {order[1]} limit 24""", **(NOW if ranked else {}))

    @query(name, sql)
    def _(d):
        return browse.browse_page(d.ranked_assets() if ranked else d.assets(), d.asset_attributes(), PAGE_OF, sort, **args)


TWO = {"Size": ["1", "2", "3"], "Type": ["ECONOMY", "STANDARD"]}
page("browse_page", ("coalesce(number, 2147483647)", "asc"), "number", sql_match("m.id", TWO), selections=TWO)
page("browse_page_name", ("name", "desc"), "-name")
page("browse_page_activity", ("coalesce(last_activity_slot, -1)", "desc"), "-activity")
page("keyset_after", ("coalesce(last_activity_slot, -1)", "desc"), "-activity",
     "(coalesce(last_activity_slot, -1), id) < (4000, 100)", after=(4000, 100))
page("browse_page_rarity", ("coalesce(rarity_rank, 2147483647)", "asc"), "rarity", sql_match("m.id", {"Size": ["1", "2", "3"]}),
     selections={"Size": ["1", "2", "3"]})
page("browse_page_common", ("coalesce(rarity_rank, 2147483647)", "desc"), "-rarity",
     "(coalesce(rarity_rank, 2147483647), id) < (60, 100000000)", after=(60, 100000000))
page("browse_page_text", ("coalesce(number, 2147483647)", "asc"), "number",
     "(contains(lower(m.name), 're') or starts_with(m.address, 're'))", q=" RE ")
page("keyset_after_text", ("name", "asc"), "name", "(name, id) > ('red', 0)", after=("red", 0))


# -- search -----------------------------------------------------------------
@query("search_grouped", with_("members collections", """
  select * from (select collection_id, id, address, name,
    count(*) over (partition by collection_id) as total,
    cast(row_number() over (partition by collection_id order by coalesce(number, 2147483647), id) as int) as rn
  from members where name ilike '%red%' and collection_id in (select id from collections where enabled))
  where rn <= 10"""))
def _(d):
    return browse.search_grouped(d.collections(), d.assets(), text="red").select(
        "collection_id", "id", "address", "name", "total", "rn")


@query("search_grouped_number", with_("members collections", """
  select collection_id, id, address, name, cast(1 as bigint) as total, 1 as rn from members
  where number = 77 and collection_id in (select id from collections where enabled)"""))
def _(d):
    return browse.search_grouped(d.collections(), d.assets(), number=77).select(
        "collection_id", "id", "address", "name", "total", "rn")


@query("search_groups", with_("members collections", """
  select slug, total, '[' || string_agg('{"address":"' || address || '","name":"' || name || '"}', ',' order by rn) || ']'
    as nfts
  from (select c.slug, m.address, m.name, count(*) over (partition by c.slug) as total,
      row_number() over (partition by c.slug order by coalesce(number, 2147483647), m.id) as rn
    from members m join collections c on c.id = m.collection_id and c.enabled where m.name ilike '%red%')
  where rn <= 5 group by slug, total"""))
def _(d):
    return browse.search_groups(d.collections(), d.assets(), text="red", per_group=5)


@query("search_route", with_("members collections", """
  select q, interpreted_as, route, case when route = 'wallet' then held end as wallet_total from (
    select i.q, i.interpreted_as, h.held,
      case when i.interpreted_as = 'address' and i.q in (select address from assets) then 'nft'
           when i.interpreted_as = 'address' and h.held > 0 then 'wallet'
           when i.interpreted_as = 'text' and i.q in (select slug from collections where enabled) then 'collection'
      end as route
    from (select distinct * from asked) i left join (
      select owner, count(*) as held from members
      where collection_id in (select id from collections where enabled) group by 1) h on h.owner = i.q)""",
                             inputs=SEARCH_INPUTS, asked=INTERPRET))
def _(d):
    return browse.search_route(search_inputs(d), d.collections(), d.assets())
