"""Observed state against stored state: what to correct, and how far to look.

``observed`` rows are landed snapshots: (address, collection_id, owner, burned), with an
empty owner already read as unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordered import last_before, row_number, running_sum, scan
from vitrine.operators.predicates import population

# How far a probe and a repair run go.
AGREE_STREAK = 20
MAX_DEEP_CRAWLS = 5
RECOVER_BUDGET = 200


# -- who should be watched -----------------------------------------------------------
def tracked_addresses(collections: DataFrame, mints: DataFrame, assets: DataFrame) -> DataFrame:
    """Every address worth watching, by the membership rule of each enabled collection."""
    enabled = collections.where("enabled")

    def ruled(rule: str) -> DataFrame:
        return enabled.where(F.col("membership_rule") == rule).select(F.col("id").alias("collection_id"))

    listed = mints.join(ruled("tm_allowlist"), "collection_id", "left_semi").select(F.col("mint").alias("address"))
    members = population(assets).join(ruled("tm_collection"), "collection_id", "left_semi").select("address")
    cores = enabled.where(F.col("membership_rule") == "core_collection").select("address")
    return listed.union(members).union(cores).distinct()


def address_diff(tracked: DataFrame, registered: DataFrame) -> DataFrame:
    """Addresses to add, to remove and to keep at the transport."""
    t = tracked.select("address").distinct().withColumn("_t", F.lit(True))
    r = registered.select("address").distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_r").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("kept")
    return t.join(r, "address", "full_outer").select("address", status.alias("status"))


def probe_targets(collections: DataFrame) -> DataFrame:
    """Distinct (filter, address) pairs that list the members of the enabled collections."""
    allow = F.col("membership_rule") == "tm_allowlist"
    return collections.where(F.col("enabled") & F.col("membership_rule").isNotNull()).select(
        F.when(allow, "creator").otherwise("collection").alias("filter"),
        F.when(allow, F.col("verified_creator")).otherwise(F.col("address")).alias("address"),
    ).where(F.col("address").isNotNull()).distinct()


def observed_population(collections: DataFrame, mints: DataFrame, stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What each enabled collection contains now: the allowlist, the stored members, or the
    collection's own full listing, whichever its rule says."""
    rule = collections.where("enabled").select(F.col("id").alias("collection_id"), "membership_rule")
    allow = mints.join(rule.where(F.col("membership_rule") == "tm_allowlist"), "collection_id", "left_semi").select(
        "collection_id", F.col("mint").alias("address"))
    known = stored.join(rule.where(F.col("membership_rule") == "tm_collection"), "collection_id", "left_semi").select(
        "collection_id", "address")
    keyed = snapshots.drop("collection_id").join(allow.unionByName(known), "address")
    core = snapshots.join(rule.where(F.col("membership_rule") == "core_collection"), "collection_id", "left_semi")
    return keyed.select(*snapshots.columns).unionByName(core)


# -- differences ----------------------------------------------------------------------
def membership_diff(collections: DataFrame, stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Moves of core collections: gone assets are removed, seen ones are members again."""
    cores = collections.where(F.col("enabled") & (F.col("membership_rule") == "core_collection")).select(
        F.col("id").alias("collection_id"))
    have = stored.join(cores, "collection_id", "left_semi").select("collection_id", "address", "membership_status")
    seen = observed.select("collection_id", "address").distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull()
    both = have.join(seen, ["collection_id", "address"], "left")
    wrong = gone & (F.col("membership_status") == "member") | ~gone & (F.col("membership_status") != "member")
    return both.where(wrong).select("collection_id", "address", gone.alias("removed"))


def state_diff(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Assets whose known owner differs, or that burned. An unknown owner proves nothing."""
    x = observed.select(
        "address", F.when(~F.col("burned"), F.nullif("owner", F.lit(""))).alias("new_owner"),
        F.col("burned").alias("new_burned"))
    moved = F.col("new_owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("new_owner"))
    burned = F.col("new_burned") & ~F.col("burned")
    return stored.join(x, "address").where(moved | burned).select(
        "id", "address", "collection_id", F.col("owner").alias("old_owner"), "new_owner", burned.alias("newly_burned"),
        "last_activity_slot")


def candidate_union(diff: DataFrame, dirty: DataFrame, drifted: DataFrame, cap: int | None = None) -> DataFrame:
    """Assets to recover, each once; with a ``cap`` those past it are flagged for a rebuild instead.

    Order: state differences, then dirty, then drifted, each by id."""
    sources = [df.select("id", F.lit(i).alias("source")) for i, df in enumerate((diff, dirty, drifted))]
    each = sources[0].unionByName(sources[1]).unionByName(sources[2]).groupBy("id").agg(
        F.min("source").alias("source"))
    if cap is None:
        return each.withColumn("action", F.lit("recover"))
    # cap rows at most, so the split is a broadcast lookup and not a global numbering
    first = each.orderBy("source", "id").limit(cap).select("id", F.lit(True).alias("_in"))
    return each.join(F.broadcast(first), "id", "left").select(
        "id", "source", F.when(F.col("_in"), "recover").otherwise("flag").alias("action"))


# -- probing the tip -------------------------------------------------------------------
def probe_stop_rule(observed: DataFrame, stored: DataFrame, streak: int = AGREE_STREAK,
                    page: int | None = None) -> DataFrame:
    """All observed rows, newest first within their collection, and whether a tip probe has to ``read`` them: until
    ``streak`` tracked assets in a row agree and, with a ``page``, no further than that. Untracked assets neither
    count nor break the streak.

    ``observed`` carries ``updated`` (greater = newer)."""
    known = stored.select("address", F.col("owner").alias("old"), F.col("burned").alias("was_burned"))
    owner = F.when(~F.col("burned"), F.nullif("owner", F.lit("")))
    stale = (owner.isNotNull() & ~F.col("old").eqNullSafe(owner)) | (F.col("burned") & ~F.col("was_burned"))
    tracked = F.col("was_burned").isNotNull()
    rows = observed.join(known, "address", "left").select(
        "collection_id", "address", tracked.alias("tracked"), (tracked & stale).alias("stale"),
        F.col("updated").isNull().cast("int").alias("_undated"), (-F.coalesce("updated", F.lit(0))).alias("_newest"))
    agrees = F.col("tracked") & ~F.col("stale")
    order = ["_undated", "_newest", "address"]
    rows = scan(rows, ["collection_id"], order, {"rn": row_number(), "_agreed": running_sum(agrees.cast("long"))})
    # agreeing rows since the last stale one
    rows = scan(rows, ["collection_id"], order, {"_before": last_before(F.when(F.col("stale"), F.col("_agreed")))})
    full = agrees & (F.col("_agreed") - F.coalesce("_before", F.lit(0)) == streak)
    end = rows.groupBy("collection_id").agg(F.min(F.when(full, F.col("rn"))).alias("_end"))
    read = F.coalesce(F.col("rn") <= F.col("_end"), F.lit(True))
    if page is not None:
        read = read & (F.col("rn") <= page)
    return rows.join(end, "collection_id").select("collection_id", "address", "rn", "tracked", "stale", read.alias("read"))


def recovery_window(signatures: DataFrame, assets: DataFrame, cursor: int | None = None,
                    budget: int | None = None) -> DataFrame:
    """Signatures newer than each asset's last recorded slot (else ``cursor``): failed ones are parked, the others
    replayed. With a ``budget``, those of an asset beyond its newest so many are left for later."""
    floor = assets.select(
        F.col("id").alias("asset_id"), F.coalesce("last_activity_slot", F.lit(cursor or 0)).alias("floor"))
    rows = signatures.join(floor, "asset_id").where(F.col("slot") > F.col("floor"))
    action = F.when(F.col("failed"), "park").otherwise("replay")
    if budget is not None:
        rows = scan(rows.withColumn("_newest", -F.col("slot")), ["asset_id"], ["_newest", "signature"], {"_rn": row_number()})
        action = F.when(F.col("_rn") > budget, "later").otherwise(action)
    return rows.select("asset_id", "signature", "slot", action.alias("action"))


def probe_repair_plan(stale: DataFrame, budget: int = RECOVER_BUDGET, deep: int = MAX_DEEP_CRAWLS) -> DataFrame:
    """Which stale assets of each run get their timeline walked, and how many signatures.

    ``stale``: (run, arrival, asset_id, floor, signatures): ``signatures`` counts those above
    the floor (above 0 without one). The first ``deep`` assets without a floor are walked
    from 0; all share one budget in arrival order; the rest only get their owner corrected."""
    counted = scan(stale.withColumn("_deep", F.col("floor").isNull().cast("long")), ["run"], ["arrival"],
                   {"_nth": running_sum(F.col("_deep"))})
    allowed = F.col("floor").isNotNull() | (F.col("_nth") <= deep)
    counted = counted.withColumn("_need", F.when(allowed, F.col("signatures")).otherwise(F.lit(0)))
    spent = scan(counted, ["run"], ["arrival"], {"_upto": running_sum(F.col("_need"))})
    left = budget - (F.col("_upto") - F.col("_need"))
    walked = allowed & (left > 0)
    return spent.select(
        "run", "asset_id", F.when(walked, F.coalesce("floor", F.lit(0))).alias("walk_from"),
        F.when(walked, F.least(F.col("_need"), left)).otherwise(F.lit(0)).alias("walked"),
        F.when(walked, "walk").otherwise("owner_only").alias("action"))


# -- documents ----------------------------------------------------------------------------
def documents_to_fetch(observed: DataFrame, collections: DataFrame, stored: DataFrame, documents: DataFrame,
                       refetch: bool = False) -> DataFrame:
    """Documents that are missing or came from another URI than the one to use now.

    ``observed``: (address, collection_id, metadata_uri)."""
    from vitrine.functions.scalar import metadata_source_uri

    rule = collections.select(F.col("id").alias("collection_id"), "metadata_uri_template")
    have = documents.select(F.col("asset_id").alias("id"), F.lit(True).alias("_has"))
    state = stored.select("id", "address", "collection_id", F.col("metadata_source_uri").alias("_from")).join(
        have, "id", "left").drop("id")
    uri = metadata_source_uri(F.col("metadata_uri_template"), F.col("address"), F.col("metadata_uri"))
    needed = F.col("_has").isNull() | ~F.col("_from").eqNullSafe(F.col("uri")) | F.lit(refetch)
    return observed.join(rule, "collection_id").withColumn("uri", uri).where(F.col("uri").isNotNull()).join(
        state, ["address", "collection_id"], "left").where(needed).select("address", "collection_id", "uri")
