"""From transaction JSON to ownership events.

Everything a transaction says about itself is computed inside its row with array
functions; a row is bounded by the ledger's transaction size. Only the owners that old
balances omit need other rows, and those come by one join on the token account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.base58 import is_create_data
from vitrine.operators.skew import HEAVY_ROWS, REGISTRY_ROWS, heavy_keys, lookup_join, registry_join
from vitrine.schemas import TRANSACTION
from vitrine.session import durable, write_table

# Parsed instruction names.
TRANSFERS = ("transfer", "transferChecked")
BURNS = ("burn", "burnChecked")
MINTS = ("mintTo", "mintToChecked")
CREATES = ("create", "createIdempotent")
INITIALIZES = ("initializeAccount", "initializeAccount2", "initializeAccount3")
# base58 of the instruction data [14, 0] and [12, 0].
CORE_TRANSFER = "24o"
CORE_BURN = "uy"



def land_transactions(raw: DataFrame) -> DataFrame:
    """(signature, slot, body) to parsed rows; either nesting of message and meta."""
    # as a row of its own: conditions on what was parsed would otherwise parse the body once more
    t = raw.select("signature", F.col("slot").alias("_slot"), F.inline(F.array(F.from_json("body", TRANSACTION))))
    return t.select(
        "signature", F.col("_slot").alias("slot"), F.coalesce("transaction.meta", "meta").alias("meta"),
        F.coalesce("transaction.transaction.message", "transaction.message").alias("message"),
        F.coalesce("blockTime", "transaction.blockTime").alias("block_seconds"))


def own_row(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of ``df`` as a row of its own: what filters or explodes them then does not compute them once more."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def tx_account_keys(tx: DataFrame) -> DataFrame:
    """Static keys (plain or as {"pubkey"}), then loaded writable, then loaded readonly ones."""
    # a plain key is no JSON: parsing each to find that out costs more than all else here
    static = F.transform(F.col("message.accountKeys"), lambda k: F.when(
        k.contains("{"), F.coalesce(F.get_json_object(k, "$.pubkey"), k)).otherwise(k))
    keys = F.concat(_or_empty(static, "string"), _or_empty(F.col("meta.loadedAddresses.writable"), "string"),
                    _or_empty(F.col("meta.loadedAddresses.readonly"), "string"))
    return tx.withColumn("keys", keys)


def _balances(c: Column) -> Column:
    named = F.transform(c, lambda b: F.struct(
        F.get(F.col("keys"), b["accountIndex"]).alias("account"), b["mint"].alias("mint"), b["owner"].alias("owner"),
        F.coalesce((b["uiTokenAmount"]["decimals"] == 0) & (b["uiTokenAmount"]["amount"] == "1"), F.lit(False)).alias("unit")))
    kept = F.filter(named, lambda b: b["account"].isNotNull() & b["mint"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<account:string,mint:string,owner:string,unit:boolean>>"))


def tx_balances(tx: DataFrame) -> DataFrame:
    """Token balances before and after, by account. ``unit`` marks one indivisible token."""
    return tx.withColumn("pre", _balances(F.col("meta.preTokenBalances"))).withColumn(
        "post", _balances(F.col("meta.postTokenBalances"))).withColumn(
        "token_accounts", F.array_distinct(F.concat(
            F.transform("pre", lambda b: b["account"]), F.transform("post", lambda b: b["account"]))))


def tx_native_deltas(tx: DataFrame) -> DataFrame:
    """Non-zero lamport movements per account; nothing when the two lists differ in length."""
    before, after = F.col("meta.preBalances"), F.col("meta.postBalances")
    zipped = F.arrays_zip(F.col("keys").alias("k"), before.alias("b"), after.alias("a"))
    moves = F.transform(F.slice(zipped, 1, F.least(F.size("keys"), F.size(before))), lambda z: F.struct(
        z["k"].alias("account"), (F.coalesce(z["a"], F.lit(0)) - F.coalesce(z["b"], F.lit(0))).cast("long").alias("delta")))
    moves = F.filter(moves, lambda m: m["delta"] != 0)
    same = F.size(before) == F.size(after)
    return tx.withColumn("native_deltas", F.when(F.coalesce(same, F.lit(False)) & (F.size(before) > 0), moves).otherwise(
        F.array().cast("array<struct<account:string,delta:bigint>>")))


def tx_flatten_instructions(tx: DataFrame) -> DataFrame:
    """Outer instruction, then its inner ones, then the next outer one."""
    kind = tx.select("message.instructions").schema[0].dataType.elementType.simpleString()
    groups = F.col("meta.innerInstructions")
    flat = F.flatten(F.transform(F.col("message.instructions"), lambda ins, i: F.concat(
        F.array(ins), _or_empty(F.flatten(F.transform(
            F.filter(groups, lambda g: g["index"] == i), lambda g: _or_empty(g["instructions"], kind))), kind))))
    return tx.withColumn("instructions", _or_empty(flat, kind))


def tx_programs(tx: DataFrame) -> DataFrame:
    """Distinct program ids in first-seen order, and the fee payer."""
    named = F.filter(F.transform("instructions", lambda i: i["programId"]), lambda p: p.isNotNull())
    return tx.withColumn("programs", F.array_distinct(named)).withColumn("fee_payer", F.get("keys", F.lit(0)))


def facts(raw: DataFrame) -> DataFrame:
    """All per-transaction facts of landed JSON, failed transactions included."""
    tx = tx_balances(tx_account_keys(land_transactions(raw)))
    tx = tx_programs(tx_flatten_instructions(tx_native_deltas(tx)))
    return tx.select(
        "signature", "slot", "block_seconds", F.col("meta.err").isNotNull().alias("failed"),
        F.coalesce("meta.fee", F.lit(0)).alias("fee"), "keys", "pre", "post", "token_accounts", "native_deltas",
        "instructions", "programs", "fee_payer")


def token_facts(tx: DataFrame) -> DataFrame:
    """What of the facts token calls and the owner map are read from: of instructions only what was parsed, and no programs."""
    parsed = F.transform("instructions", lambda ins: F.struct(ins["parsed"].alias("parsed")))
    return tx.drop("keys").withColumn("instructions", parsed).withColumn("programs", F.array().cast("array<string>"))


def nft_unit_gate(tx: DataFrame) -> DataFrame:
    """Token legs that are one indivisible unit."""
    legs = F.concat(F.transform("pre", lambda b: F.struct(F.lit("pre").alias("side"), b.alias("b"))),
                    F.transform("post", lambda b: F.struct(F.lit("post").alias("side"), b.alias("b"))))
    return own_row(tx, "signature", "pre", "post").select("signature", F.inline(legs)).where("b.unit").select(
        "signature", "side", F.col("b.account").alias("account"), F.col("b.mint").alias("mint"), F.col("b.owner").alias("owner"))


def harvest_owner_map(tx: DataFrame) -> DataFrame:
    """Token account to wallet, from balances that name the owner and from the instructions
    that create or initialise accounts. The first statement wins, by signature and place.
    ``seen`` counts how often the account occurs, with or without an owner."""
    from_balances = F.transform(F.concat("pre", "post"), lambda b, i: F.struct(
        b["account"].alias("account"), b["owner"].alias("owner"), i.alias("place")))
    from_calls = F.transform("instructions", lambda ins, i: F.struct(
        ins["parsed"]["info"]["account"].alias("account"),
        F.when(ins["parsed"]["type"].isin(*CREATES), ins["parsed"]["info"]["wallet"])
        .when(ins["parsed"]["type"].isin(*INITIALIZES), ins["parsed"]["info"]["owner"]).alias("owner"),
        (i + F.lit(1_000_000)).alias("place")))
    from_calls = F.filter(from_calls, lambda s: s["owner"].isNotNull())
    said = tx.select("signature", F.inline(F.concat(from_balances, from_calls))).where(F.col("account").isNotNull())
    told = F.when(F.col("owner").isNotNull(), F.struct("signature", "place"))
    return said.groupBy("account").agg(
        F.min_by("owner", told).alias("owner"), F.count(F.lit(1)).alias("seen")).where(F.col("owner").isNotNull())


def landed_owner_map(tx: DataFrame) -> DataFrame:
    """The owner map, written: it is read by two joins and for its heavy keys."""
    return write_table(harvest_owner_map(tx), "owner_map", codec="zstd")


def mint_token_accounts(tx: DataFrame) -> DataFrame:
    """Token accounts that ever held each mint."""
    return tx.select(F.inline(F.concat("pre", "post"))).select("mint", "account").distinct()


def _last(balances: str, account: Column) -> Column:
    return F.try_element_at(F.filter(F.col(balances), lambda b: b["account"] == account), F.lit(-1))


CARRIED = ["fee", "fee_payer", "programs", "native_deltas", "token_accounts"]


def _token_calls(tx: DataFrame, carried: list[str]) -> DataFrame:
    """Token instructions that move, burn or mint one unit, before owners are filled in."""
    unit = F.exists("pre", lambda b: b["unit"]) | F.exists("post", lambda b: b["unit"])
    named = F.transform("instructions", lambda ins, i: F.struct(i.alias("pos"), ins["parsed"].alias("parsed")))
    # kept inside the array until here, so that the carried columns are copied only for these
    named = F.filter(named, lambda x: x["parsed"]["type"].isin(*TRANSFERS, *BURNS, *MINTS))
    rows = own_row(tx, "signature", "slot", "block_seconds", "failed", *carried, "pre", "post", "instructions")
    calls = rows.where(~F.col("failed") & unit).select(
        "signature", "slot", "block_seconds", *carried, "pre", "post", F.inline(named))
    name = F.col("parsed.type")
    arg = lambda key: F.col(f"parsed.info.{key}")
    kind = F.when(name.isin(*TRANSFERS), "transfer").when(name.isin(*BURNS), "burn").otherwise("mint")
    calls = calls.withColumn("kind", kind)
    given = F.when(F.col("kind") == "transfer", _last("pre", arg("source"))).when(
        F.col("kind") == "burn", _last("pre", arg("account")))
    taken = F.when(F.col("kind") == "transfer", _last("post", arg("destination"))).when(
        F.col("kind") == "mint", _last("post", arg("account")))
    calls = calls.withColumn("given", given).withColumn("taken", taken)
    ruling = F.when(F.col("kind") == "mint", F.col("taken")).otherwise(F.col("given"))
    return calls.withColumn("ruling", ruling).where("ruling.unit").select(
        "signature", "slot", "block_seconds", *carried, "pos", "kind", name.alias("instruction"),
        F.col("ruling.mint").alias("address"), F.col("given.owner").alias("from_owner"),
        F.col("given.account").alias("_given"), F.col("taken.owner").alias("to_owner"),
        F.col("taken.account").alias("_taken"))


def owner_map_join(calls: DataFrame, owner_map: DataFrame, account: str, owner: str) -> DataFrame:
    """Fill a missing owner from the harvested map. The accounts that occur most are the
    heavy keys, so the calls need not be counted first."""
    known = owner_map.select(F.col("account").alias("_account"), F.col("owner").alias("_owner"))
    heavy = owner_map.where(F.col("seen") > HEAVY_ROWS).select(F.col("account").alias("_account"))
    asked = calls.withColumn("_account", F.when(F.col(owner).isNull(), F.col(account)))
    joined = lookup_join(asked, known, ["_account"], spread="signature", heavy=heavy)
    return joined.withColumn(owner, F.coalesce(owner, "_owner")).drop("_account", "_owner")


def landed_calls(tx: DataFrame, collections: DataFrame | None = None, carried: list[str] = CARRIED) -> DataFrame:
    """Token calls before owners are filled in and, with ``collections``, the decoded core calls. ``carried``: further facts to keep
    of each transaction.

    They are landed, as they are read several times: they are small beside the facts, which then need not be."""
    calls = _token_calls(tx, carried)
    if collections is not None:
        calls = calls.unionByName(decode_core_events(core_calls(tx, collections, carried), carried), allowMissingColumns=True)
    return write_table(calls, "calls", codec="zstd")


def token_calls_with_owners(tx: DataFrame, owner_map: DataFrame, carried: list[str] = CARRIED) -> DataFrame:
    return fill_owners(landed_calls(tx, None, carried), owner_map)


def fill_owners(calls: DataFrame, owner_map: DataFrame) -> DataFrame:
    """Only calls that lack an owner (old ones) meet the map."""
    asks = (F.col("from_owner").isNull() & F.col("_given").isNotNull()) | (F.col("to_owner").isNull() & F.col("_taken").isNotNull())
    filled = owner_map_join(calls.where(asks), owner_map, "_given", "from_owner")
    filled = owner_map_join(filled, owner_map, "_taken", "to_owner")
    calls = calls.where(~asks).unionByName(filled).drop("_given", "_taken")
    burn = F.col("kind") == "burn"
    # a receiver is required, and a move inside one wallet is none
    real = burn | (F.col("to_owner").isNotNull() & ~F.coalesce(
        (F.col("kind") == "transfer") & (F.col("from_owner") == F.col("to_owner")), F.lit(False)))
    return calls.where(real)


def core_calls(tx: DataFrame, collections: DataFrame, carried: list[str] = CARRIED) -> DataFrame:
    """Instructions that open with (asset, registered core collection), decoded or not."""
    placed = F.transform("instructions", lambda ins, i: F.struct(
        i.alias("pos"), ins["programId"].alias("program_id"), ins["data"].alias("data"),
        F.filter(ins["accounts"], lambda a: a.isNotNull()).alias("accounts")))
    placed = F.filter(placed, lambda x: F.coalesce(F.size(x["accounts"]), F.lit(-1)) >= 2)
    rows = own_row(tx, "signature", "slot", "block_seconds", "failed", *carried, "instructions")
    calls = rows.where(~F.col("failed")).select(
        "signature", "slot", "block_seconds", *carried, F.inline(placed)).withColumn(
        "address", F.get("accounts", F.lit(0))).withColumn("collection", F.get("accounts", F.lit(1)))
    core = collections.where(F.col("standard") == "core").select(
        F.col("address").alias("collection"), F.col("id").alias("collection_id"), "program").where(
        F.col("collection").isNotNull())
    named = registry_join(calls, core, ["collection"], spread="signature", how="inner").where(
        F.col("address") != F.col("collection"))
    n, data = F.size("accounts"), F.col("data")
    ours = F.col("program_id") == F.col("program")
    receiver = F.get("accounts", F.lit(4))
    receiver = F.when(receiver != F.col("program"), receiver)
    create = F.when(ours & (n >= 8) & ~data.isin(CORE_TRANSFER, CORE_BURN), data)
    named = named.withColumn("_create", F.when(create.isNotNull(), is_create_data(create)).otherwise(F.lit(False)))
    kind = (F.when(ours & (data == CORE_TRANSFER) & (n >= 7) & receiver.isNotNull(), "transfer")
            .when(ours & (data == CORE_BURN) & (n >= 6), "burn")
            .when(ours & F.col("_create") & receiver.isNotNull(), "mint"))
    return named.withColumn("kind", kind).withColumn("to_owner", F.when(F.col("kind") != "burn", receiver))


def core_touches(calls: DataFrame) -> DataFrame:
    """Distinct (asset, collection) a transaction names, with whether any call was decoded."""
    return calls.groupBy("signature", "address").agg(
        F.min_by("collection", "pos").alias("collection"), F.min_by("collection_id", "pos").alias("collection_id"),
        F.bool_or(F.col("kind").isNotNull()).alias("decoded"), F.max("slot").alias("slot"))


def decode_core_events(calls: DataFrame, carried: list[str] = CARRIED) -> DataFrame:
    names = F.when(F.col("kind") == "transfer", "TransferV1").when(F.col("kind") == "burn", "BurnV1").otherwise("CreateV2")
    return calls.where(F.col("kind").isNotNull()).select(
        "signature", "slot", "block_seconds", *carried, "pos", "kind", names.alias("instruction"), "address",
        F.lit(None).cast("string").alias("from_owner"), "to_owner")


def event_seq(events: DataFrame) -> DataFrame:
    """Number the events of each asset inside its transaction, in instruction order, from 0."""
    inside = Window.partitionBy("signature", "address").orderBy("pos")
    return events.withColumn("seq", F.row_number().over(inside) - 1)


def decode_token_events(tx: DataFrame, owner_map: DataFrame | None = None) -> DataFrame:
    return event_seq(token_calls_with_owners(tx, owner_map or landed_owner_map(tx), []))


def ownership_calls(tx: DataFrame, collections: DataFrame, owner_map: DataFrame | None = None,
                    carried: list[str] = CARRIED) -> DataFrame:
    """Token and core calls that change an owner, with the facts needed to price them."""
    return fill_owners(landed_calls(tx, collections, carried), owner_map or landed_owner_map(tx))


def decode_events(tx: DataFrame, collections: DataFrame, owner_map: DataFrame | None = None) -> DataFrame:
    """Token and core events of all transactions, numbered together."""
    return event_seq(ownership_calls(tx, collections, owner_map, []))


def tx_block_time(tx: DataFrame, slot_times: DataFrame) -> DataFrame:
    """Time of each transaction: its own, else its slot's; without either it is parked."""
    known = slot_times.select("slot", F.col("block_time").alias("_slot_time"))
    joined = registry_join(tx, known, ["slot"], spread="signature")
    when = F.coalesce(F.timestamp_seconds("block_seconds"), F.col("_slot_time"))
    return joined.withColumn("block_time", when).withColumn("parked", F.col("block_time").isNull()).drop("_slot_time")


def infer_core_event(touches: DataFrame, stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events of touched core assets whose call was not decoded, from what the latest snapshot
    says against what is stored. An unknown asset is inserted, and minted unless decoded.

    An asset's first touch applies the snapshot; what touches it later finds nothing changed. Within a slot a decoded
    call comes first."""
    order = F.struct("slot", (~F.col("decoded")).alias("late"), "signature")
    touches = touches.groupBy("address").agg(F.min_by(F.struct("signature", "collection_id", "slot", "decoded"), order).alias("t")).select("address", "t.*")
    seen = snapshots.select("address", F.nullif("owner", F.lit("")).alias("_new_owner"), F.col("burned").alias("_new_burned"))
    have = stored.select("address", F.col("owner").alias("_old_owner"), F.col("burned").alias("_old_burned"))
    rows = touches.join(seen, "address").join(have, "address", "left")
    known = F.col("_old_burned").isNotNull()
    moved = F.col("_new_owner").isNotNull() & ~F.col("_new_owner").eqNullSafe(F.col("_old_owner"))
    kind = F.when(~F.col("decoded"), F.when(~known, "mint").when(F.col("_new_burned") & ~F.col("_old_burned"), "burn").when(
        moved, "transfer"))
    rows = rows.withColumn("kind", kind).withColumn("insert", ~known)
    return rows.where(F.col("kind").isNotNull() | F.col("insert")).select(
        "signature", "address", "collection_id", "slot", "insert", "kind",
        F.when(F.col("kind") != "mint", F.col("_old_owner")).alias("from_owner"),
        F.when(F.col("kind") != "burn", F.col("_new_owner")).alias("to_owner"))


def account_index(tx: DataFrame) -> DataFrame:
    """(account, signature) of every account that a transaction names, stored by account: reads of few accounts skip the rest."""
    return write_table(tx.select("signature", F.explode("keys").alias("account")).distinct(), "account_index", ["account"])


def _is_small(rows: DataFrame) -> bool:
    return rows.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS


def crawl_frontier(tx: DataFrame, assets: DataFrame, settled: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(address, signature, round): transactions that concern each of ``assets`` (address), found in rounds until none is new: first those that
    name the asset, then those that name a token account that it was seen in. An asset that ``settled(found)`` (address) returns is
    not followed further.

    Only accounts that are new in a round are looked up in it, and ``settled`` is asked only about assets that the round found
    something of. Few accounts, or accounts with very many transactions, are matched by broadcast. Without an ``index`` the accounts
    are read from the transactions in each round: storing them all takes longer than reading them a few times."""
    names = tx.select("signature", F.explode("keys").alias("account")) if index is None else index
    heavy = None
    holders = tx.select("signature", F.inline(F.concat("pre", "post"))).select("signature", F.col("mint").alias("address"), "account")
    met = durable(assets.select("address", F.col("address").alias("account")).distinct())
    new, found, number = met, None, 0
    while True:
        number += 1
        of_account = new.groupBy("account").agg(F.collect_set("address").alias("_of"))  # a token account has one asset
        few = _is_small(of_account)
        if not few and heavy is None:
            heavy = durable(heavy_keys(names, ["account"]))
        hits = names.join(F.broadcast(of_account), "account") if few else lookup_join(
            names, of_account, ["account"], spread="signature", how="inner", heavy=heavy)
        hits = hits.select(F.explode("_of").alias("address"), "signature").distinct()
        if found is not None:
            hits = hits.join(found, ["address", "signature"], "left_anti")
        hits = durable(hits.withColumn("round", F.lit(number)))
        found = hits if found is None else found.unionByName(hits)
        open_hits = hits
        if settled is not None:
            hit = hits.select("address").distinct()
            asked = found if number == 1 else found.join(F.broadcast(hit) if _is_small(hit) else hit, "address", "left_semi")
            open_hits = durable(hits.join(settled(asked).select("address"), "address", "left_anti"))
        pairs = open_hits.select("address", "signature")
        seen = holders.join(F.broadcast(pairs) if _is_small(pairs) else pairs, ["address", "signature"]).select("address", "account").distinct()
        new = durable(seen.join(met, ["address", "account"], "left_anti"))
        if new.isEmpty():
            return found
        met = met.unionByName(new)
