"""The domain projections of ``sources.domain`` written as SQL, for the oracle queries."""

from __future__ import annotations


def key(x: str) -> str:
    return f"('111111SYN' || translate(md5({x}), '0', 'Z'))"


def sig(x: str) -> str:
    return f"left(translate(md5('a' || {x}) || md5('b' || {x}) || md5('c' || {x}), '0', 'Z'), 88)"


def hash_id(x: str) -> str:
    return f"cast('0x' || substr(md5({x}), 1, 15) as bigint)"


COLL = "cast(regexp_extract(p_brand, '(\\d+)', 1) as int)"

# name -> (names it reads, body)
CTES: dict[str, tuple[list[str], str]] = {
    "collections": ([], f"""
      select *, case when standard = 'core' and address is not null then 'core_collection'
                     when standard = 'token_metadata' and address is not null then 'tm_collection'
                     when standard = 'token_metadata' and verified_creator is not null then 'tm_allowlist' end
                as membership_rule
      from (select n as id, 'brand-' || n as slug, p_brand as name,
        case when n % 3 = 0 then 'core' else 'token_metadata' end as standard,
        case when n % 3 <> 2 then {key("'collection' || n")} end as address,
        case when n % 3 = 0 and n % 9 <> 0 then {key("'coreprogram'")} end as program,
        case when n % 3 = 2 then {key("'creator' || (n % 6)")} end as verified_creator,
        case when n % 3 <> 0 then {key("'authority' || n")} end as update_authority,
        case when n % 3 <> 0 then 'B' || n end as symbol,
        case when n % 4 = 0 then 'https://meta.example.com/{{mint}}.json' end as metadata_uri_template,
        n % 10 <> 0 as enabled, n % 2 = 1 as rarity_dirty, n as rarity_version
      from (select distinct p_brand, {COLL} as n from part))"""),
    "collection_mints": ([], f"""
      select {key("'asset' || p_partkey")} as mint, {COLL} as collection_id from part
      where {COLL} % 3 = 2 and p_partkey % 12 <> 5"""),
    "tokens": ([], f"""
      select {key("'token' || s_suppkey")} as mint, 'T' || s_suppkey as symbol, s_name as name,
             cast(s_suppkey % 10 as int) as decimals, s_suppkey % 4 <> 0 as enabled, s_suppkey as created_order
      from supplier"""),
    "venues": ([], f"""
      select {key("'program' || s_suppkey")} as program_id, s_name as label from supplier where s_suppkey % 2 = 0"""),
    "asset_base": ([], f"""
      select k + 1 as id, {key("'asset' || k")} as address, n as collection_id,
        case when p_size = 50 then 'removed' else 'member' end as membership_status,
        case when p_size = 50 then timestamp '2024-01-01 00:00:00' end as removed_at,
        p_name || ' #' || k as name, cast(k as int) as number,
        case when k % 15 = 1 then null when k % 10 = 0 then 'X' else 'B' || n end as symbol,
        'https://chain.example.com/' || k || '.json' as metadata_uri,
        case when k % 7 = 0 then null when k % 11 = 0 then 'https://old.example.com/' || k || '.json'
             when n % 4 = 0 then 'https://meta.example.com/' || {key("'asset' || k")} || '.json'
             else 'https://chain.example.com/' || k || '.json' end as metadata_source_uri,
        'https://img.example.com/' || k || '.png' as image_uri,
        case when k % 4 = 1 then 'ok' when k % 4 = 2 then 'dead' else 'unknown' end as image_status,
        case when k % 4 <> 0 then timestamp '2024-01-01 00:00:00' + to_days(cast(k % 30 as int)) end as image_checked_at,
        k % 50 = 7 as burned, k % 40 = 3 as ownership_dirty
      from (select *, p_partkey as k, {COLL} as n from part)"""),
    "asset_attributes": ([], f"""
      select asset_id, collection_id, trait_type, value, position, trait_type <> 'Name' as is_facet from (
        select p_partkey + 1 as asset_id, {COLL} as collection_id, 'Type' as trait_type, p_type as value, 0 as position from part
        union all select p_partkey + 1, {COLL}, 'Size', cast(p_size // 10 as varchar), 1 from part
        union all select p_partkey + 1, {COLL}, 'Finish', split_part(p_name, ' ', 1), 2 from part
        union all select p_partkey + 1, {COLL}, 'Shape', split_part(p_name, ' ', 2), 3 from part where p_partkey % 3 <> 0
        union all select p_partkey + 1, {COLL}, 'Name', p_name || ' #' || p_partkey, 4 from part)"""),
    "hops": ([], f"""
      select *, {sig("(l_orderkey || '-' || slot)")} as signature, {key("'wallet' || o_custkey")} as receiver
      from (select *, l_partkey + 1 as asset_id, l_shipdate as block_time,
                   datediff('day', timestamp '1990-01-01', l_shipdate) as slot
            from lineitem join orders on l_orderkey = o_orderkey)"""),
    "numbered": (["hops"], f"""
      select *, {hash_id("signature || ':' || asset_id || ':' || seq")} as id from (
        select *, cast(row_number() over (partition by asset_id, signature
          order by l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 as int) as seq from hops)"""),
    "activity": (["numbered"], f"""
      select id, asset_id, collection_id, signature, seq, slot, block_time, kind,
        case when kind = 'mint' then null when l_linenumber = 7 then {key("'wallets' || l_suppkey")}
             else prev_owner end as from_owner,
        case when kind <> 'burn' then receiver end as to_owner,
        case when kind = 'sale' then cast(round(l_extendedprice * 100) as bigint) end as price_lamports,
        case when kind = 'sale' then 'Venue ' || (l_suppkey % 10) end as marketplace,
        l_suppkey, l_returnflag, cast(round(l_extendedprice * 100) as bigint) as hop_price
      from (select n.*, c.collection_id,
          case when lag(id) over w is null then 'mint'
               when l_partkey % 50 = 7 and lead(id) over w is null then 'burn'
               when l_returnflag = 'A' then 'sale' else 'transfer' end as kind,
          lag(receiver) over w as prev_owner
        from numbered n join (select p_partkey + 1 as pid, {COLL} as collection_id from part) c on n.asset_id = c.pid
        window w as (partition by asset_id order by slot, seq, id))"""),
    "assets": (["asset_base", "activity"], f"""
      select *, case when owner is not null then last_activity_slot end as owner_slot from (
      select b.*, case when b.burned then null when b.id % 23 = 6 then {key("'walletdrift' || b.id")}
                  else l.to_owner end as owner, l.slot as last_activity_slot, l.block_time as last_activity_at
      from asset_base b left join (
        select asset_id, to_owner, slot, block_time from activity
        qualify row_number() over (partition by asset_id order by slot desc, seq desc, id desc) = 1) l
      on b.id = l.asset_id)"""),
    "history": (["activity"], """
      select asset_id, owner, from_slot, from_ts, to_slot, to_ts, opened_by, closed_by from (
        select asset_id, to_owner as owner, slot as from_slot, block_time as from_ts, id as opened_by,
          lead(slot) over w as to_slot, lead(block_time) over w as to_ts, lead(id) over w as closed_by
        from activity window w as (partition by asset_id order by slot, seq, id))
      where owner is not null"""),
    "deliveries": ([], f"""
      select event_id as id, {sig("('e' || (case when event_id % 10 = 9 then event_id - 1 else event_id end))")} as signature,
        cast(floor(floor(epoch(ts)) / 60) as bigint) as slot, ts as block_time, event_type = 'error' as failed,
        ts as received_at, case when event_type <> 'view' then ts + interval 30 second end as processed_at,
        case when event_type = 'view' then cast(event_id % 12 as int) else 1 end as attempts,
        user_id, props as body
      from events"""),
    "signatures": (["hops"], """
      select asset_id, signature, slot, block_time, max(l_discount >= 0.095) as failed,
        case when slot % 3 <> 0 then block_time end as classified_at
      from hops group by 1, 2, 3, 4"""),
    "asset_documents": ([], "select doc_id * 2 + 1 as asset_id, 'src:' || source as source_uri, text as body from documents"),
    "observed": (["assets"], f"""
      select address, collection_id,
        case when k % 13 = 0 then {key("'walletmoved' || k")} when k % 17 = 0 then '' else owner end as owner,
        burned or k % 31 = 0 as burned, metadata_uri, last_activity_slot as updated, cast(4200 as bigint) as slot
      from (select *, id - 1 as k from assets) where k % 29 <> 0"""),
    "stored": (["assets"], "select * from assets where (id - 1) % 19 <> 0"),
    "run_log": ([], """
      select k as run_id, cast(o_custkey % 26 + 1 as int) as collection_id,
        case k % 3 when 0 then 'assets' when 1 then 'reconcile' else 'deep' end as kind,
        case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'running' end as status,
        k * 7 % 100003 as r_slot, k % 5 as owners, k % 3 as burned, k % 2 as removed,
        o_orderdate as started_at, case when o_orderstatus = 'F' then o_orderdate + interval 1 hour end as finished_at
      from (select *, o_orderkey as k from orders)"""),
    "members": (["assets"], "select * from assets where membership_status = 'member'"),
    "facets": (["members", "asset_attributes", "collections"], """
      select a.* from asset_attributes a join members m on a.asset_id = m.id
      where a.trait_type <> 'Name'"""),
}


def with_(names: str, body: str, **extra: str) -> str:
    """``body`` behind the CTEs it names (space separated) and, in order, the ``extra`` ones."""
    if body.lstrip().startswith("with "):
        body = f"select * from ({body})"
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} as materialized ({b})" for n, b in [*((n, CTES[n][1]) for n in needed), *extra.items()]]
    return "with " + ",\n".join(parts) + "\n" + body if parts else body
