"""Raw ledger transactions as JSON, one per line item of the given tables.

Every shape the decoder meets occurs: both nestings, plain and object account keys, old
balances without owners, failed transactions, mints, burns, same-wallet moves, fungible
legs riding along, trades paid by the buyer or out of an escrow, and core calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.sources.domain import Domain, key, signature, text, wallet

# base58 of a well-formed creation, a truncated one, and some other call.
CREATE_DATA = "3UF3LPQ3CfmoecgrEngY4o"
BAD_CREATE_DATA = "FmPkmaoqFBNX"
OTHER_DATA = "63JR"
FEE = 5_000
RENT = 2_039_280


def _json(*parts: Column | str) -> Column:
    """Glue: text parts are literal JSON, columns are quoted strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.concat(F.lit('"'), p, F.lit('"')) for p in parts])


def ledger(d: Domain) -> DataFrame:
    """The trades behind the transactions, one row each, with all names worked out."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    k, q = F.col("l_partkey"), F.col("l_linenumber")
    slot = F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long")
    li, orders = d.raw("lineitem"), d.raw("orders").select("o_orderkey", "o_custkey")
    part = d.raw("part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("n"))
    # joined by a shuffle also where the orders could be broadcast: a small file is one task, and what comes after is slow
    rows = li.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p_partkey") == k)
    uid = text(F.col("l_orderkey"), "-", q, "-", F.col("l_suppkey"), "-", k, "-", cents, "-", slot)
    buyer = wallet(F.col("o_custkey"))
    seller = F.when(q == 6, buyer).otherwise(wallet(text("s", F.col("l_suppkey"))))
    rows = rows.select(
        signature(F.concat(F.lit("tx"), uid)).alias("signature"), slot.alias("slot"), "l_orderkey", "l_suppkey",
        k.alias("k"), q.alias("q"), "n", cents.alias("cents"), (F.col("l_discount") >= 0.095).alias("failed"),
        (F.col("l_linestatus") == "F").alias("old"), (F.col("l_quantity") < 10).alias("escrow"),
        buyer.alias("buyer"), seller.alias("seller"), key(text("asset", k)).alias("mint"),
        key(text("program", F.col("l_suppkey"))).alias("venue"))
    return rows.withColumn("src", key(text("ta", F.col("k"), "-", F.col("seller")))).withColumn(
        "dst", key(text("tb", F.col("k"), "-", F.col("buyer"))))


def transactions(d: Domain) -> DataFrame:
    """(signature, slot, body) as received."""
    return d._landed("transactions", lambda: received(d))


def received(d: Domain) -> DataFrame:
    """The same for one pass, without landing the bodies."""
    return _bodies(ledger(d))


def _bodies(rows: DataFrame) -> DataFrame:
    c = F.col
    q, core = c("q"), c("n") % 3 == 0
    token, system, ata = key("tokenprogram"), key("systemprogram"), key("ataprogram")
    fungible, fungible_owner, royalty = key("fungibleaccount"), key("fungibleowner"), key("royalty")
    payer = F.when(c("escrow"), key("payer")).otherwise(c("buyer"))
    # account keys: 0 payer 1 source 2 destination 3 seller 4 royalty 5 venue 6 token program
    # loaded writable: 7 mint 8 escrow 9 fungible account; readonly: 10 buyer
    static = [payer, c("src"), c("dst"), c("seller"), royalty, c("venue"), token]
    plain = _json("[", *_joined([[s] for s in static]), "]")
    objects = _json("[", *_joined([['{"pubkey":', s, "}"] for s in static]), "]")
    keys = F.when(c("l_orderkey") % 4 < 2, plain).otherwise(objects)
    # a plain transfer does not name the mint
    named_mint = F.when(q == 3, key("sysvar")).otherwise(c("mint"))
    loaded = _json('{"writable":[', named_mint, ",", key("escrow"), ",", fungible, '],"readonly":[', c("buyer"), "]}")
    share = F.floor(c("cents") * 95 / 100).cast("long")
    price = c("cents")
    trade = q.between(2, 6)
    paid, out = trade & ~c("escrow"), trade & c("escrow")
    zero = F.lit(0).cast("long")
    deltas = [
        F.when(paid, -(price + FEE + RENT)).otherwise(F.lit(-FEE).cast("long")), zero,
        F.when(paid, F.lit(RENT).cast("long")).otherwise(zero),
        F.when(trade, share).otherwise(zero), F.when(trade, price - share).otherwise(zero), zero, zero, zero,
        F.when(out, -price).otherwise(zero), zero, zero]
    base = [10**11, RENT, 0, 10**10, 10**6, 1, 1, 1461600, 10**11, RENT, 10**9]
    before = F.lit("[" + ",".join(map(str, base)) + "]")
    after_all = [(F.lit(b).cast("long") + m).cast("string") for b, m in zip(base, deltas)]
    after = F.concat(F.lit("["), F.array_join(F.array(*after_all[:-1]), ","),
                     F.when(c("l_orderkey") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit(","), after_all[-1])), F.lit("]"))

    def balance(index: int, mint: Column, owner: Column, amount: str, decimals: int, known: Column) -> Column:
        said = F.when(known, _json(',"owner":', owner)).otherwise(F.lit(""))
        return F.concat(F.lit(f'{{"accountIndex":{index},"mint":'), _json(mint), said,
                        F.lit(f',"uiTokenAmount":{{"amount":"{amount}","decimals":{decimals}}}}}'))

    named, always = ~c("old"), F.lit(True)
    rides = c("l_suppkey") % 5 == 0
    money = balance(9, key("token0"), fungible_owner, "5000", 6, always)
    pre = _list([(q >= 2, balance(1, c("mint"), c("seller"), "1", 0, named)), (rides, money)])
    post = _list([(q <= 6, balance(2, c("mint"), c("buyer"), "1", 0, named)),
                  (trade, balance(1, c("mint"), c("seller"), "0", 0, named)), (rides, money)])

    def call(program: Column, name: str, **info: Column) -> Column:
        args = _json("{", *_joined([[f'"{a}":', v] for a, v in info.items()]), "}")
        return F.concat(F.lit('{"program":"x","programId":'), _json(program),
                        F.lit(f',"parsed":{{"type":"{name}","info":'), args, F.lit("}}"))

    pay = call(system, "transfer", source=c("buyer"), destination=c("seller"))
    market = _json('{"programId":', c("venue"), ',"accounts":[', c("buyer"), ",", c("seller"), '],"data":"3Bxs4h"}')
    side = call(token, "transfer", source=fungible, destination=fungible)
    inner = _list([
        (q % 2 == 0, call(ata, "create", account=c("dst"), wallet=c("buyer"))),
        (q == 5, call(token, "initializeAccount3", account=c("dst"), owner=key("stale"))),
        (q == 3, call(token, "transfer", source=c("src"), destination=c("dst"))),
        (q != 3, call(token, "transferChecked", source=c("src"), destination=c("dst"), mint=c("mint"))),
        (q == 5, call(token, "burnChecked", account=c("src"), mint=c("mint")))])
    outer = _list([
        (q == 1, call(token, "mintTo", account=c("dst"), mint=c("mint"))), (q == 7, call(token, "burn", account=c("src"))),
        (trade, pay), (trade, market), (rides, side)])
    groups = F.when(trade, F.concat(F.lit('[{"index":1,"instructions":'), inner, F.lit("}]"))).otherwise(F.lit("[]"))

    # core calls
    coreprogram = key("coreprogram")
    collection = key(text("collection", c("n")))
    caller = F.when(q == 4, key("otherprogram")).otherwise(coreprogram)
    receiver = F.when(q == 2, coreprogram).otherwise(c("buyer"))
    data = (F.when(q == 1, F.when(c("l_orderkey") % 4 == 0, F.lit(BAD_CREATE_DATA)).otherwise(F.lit(CREATE_DATA)))
            .when(q == 7, F.lit("uy")).when(q == 3, F.lit(OTHER_DATA)).otherwise(F.lit("24o")))
    accounts = _json("[", *_joined([[a] for a in (
        c("mint"), collection, c("buyer"), c("seller"), receiver, system, key("log"), key("extra"))]), "]")
    core_call = F.concat(F.lit('[{"programId":'), _json(caller), F.lit(',"accounts":'), accounts,
                         F.lit(',"data":'), _json(data), F.lit("}]"))

    instructions = F.when(core, core_call).otherwise(outer)
    err = F.when(c("failed"), F.lit('{"InstructionError":[0,"Custom"]}')).otherwise(F.lit("null"))
    empty = F.lit("[]")
    meta = F.concat(
        F.lit('{"err":'), err, F.lit(f',"fee":{FEE},"preBalances":'), before, F.lit(',"postBalances":'), after,
        F.lit(',"preTokenBalances":'), F.when(core, empty).otherwise(pre), F.lit(',"postTokenBalances":'),
        F.when(core, empty).otherwise(post), F.lit(',"innerInstructions":'), F.when(core, empty).otherwise(groups),
        F.lit(',"loadedAddresses":'), loaded, F.lit("}"))
    message = F.concat(F.lit('{"accountKeys":'), keys, F.lit(',"instructions":'), instructions, F.lit("}"))
    seconds = (c("slot") * 86400).cast("string")
    stamp = F.when(c("l_orderkey") % 3 != 0, F.concat(F.lit(',"blockTime":'), seconds)).otherwise(F.lit(""))
    nested = F.concat(F.lit('{"slot":1'), stamp, F.lit(',"transaction":{"transaction":{"message":'), message,
                      F.lit('},"meta":'), meta, F.lit("}}"))
    flat = F.concat(F.lit('{"slot":1'), stamp, F.lit(',"meta":'), meta, F.lit(',"transaction":{"message":'), message, F.lit("}}"))
    return rows.select("signature", "slot", F.when(c("l_orderkey") % 2 == 1, nested).otherwise(flat).alias("body"))


def _joined(items: list[list]) -> list:
    out: list = []
    for i, item in enumerate(items):
        out += ([","] if i else []) + item
    return out


def _list(items: list[tuple[Column, Column]]) -> Column:
    chosen = F.array_compact(F.array(*[F.when(cond, value) for cond, value in items]))
    return F.concat(F.lit("["), F.array_join(chosen, ","), F.lit("]"))
