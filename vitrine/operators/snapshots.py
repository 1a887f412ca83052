"""Asset snapshots and metadata documents: landing, merging, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.scalar import asset_image, document_image, observed_owner
from vitrine.operators import merge
from vitrine.operators.ordered import number_rows
from vitrine.schemas import DOCUMENT, SNAPSHOT
from vitrine.session import commit_tables, committed_tables, durable

# Fixed value: the largest stored attribute position.
MAX_POSITION = 32767
TRAITS = "array<struct<trait_type:string,value:string,position:int>>"


def land_snapshots(raw: DataFrame) -> DataFrame:
    """(body) to typed rows; one row per asset id."""
    a = raw.select(F.from_json("body", SNAPSHOT).alias("a")).where(F.col("a.id").isNotNull())
    return a.select(F.col("a.id").alias("address"), F.coalesce("a.burnt", F.lit(False)).alias("burnt"),
                    F.col("a.ownership.owner").alias("owner"), F.col("a.content").alias("content"))


def missing_snapshots(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Asked-for addresses without a snapshot, matched by id and never by position."""
    return wanted.join(landed.select("address"), "address", "left_anti")


def land_documents_json(raw: DataFrame) -> DataFrame:
    """(address, source_uri, body) with the body parsed; unreadable bodies are dropped."""
    doc = F.from_json("body", DOCUMENT)
    whole = F.try_parse_json("body").isNotNull()
    return raw.where(whole).select("address", "source_uri", "body", doc.alias("doc"), F.get_json_object(
        "body", "$.attributes").startswith("[").alias("lists_attributes"))


def normalized(attributes: Column) -> Column:
    """Storable attributes of a raw list: with a type and a value, the first of each pair,
    at their place in the source. Text is kept as it is, spaces and case included."""
    placed = F.transform(attributes, lambda a, i: F.struct(
        a["trait_type"].alias("trait_type"), a["value"].alias("value"), F.least(i, F.lit(MAX_POSITION)).alias("position"), i.alias("i")))
    kept = F.filter(placed, lambda a: (F.coalesce(a["trait_type"], F.lit("")) != "") & (F.coalesce(a["value"], F.lit("")) != ""))
    pairs = F.transform(kept, lambda a: F.struct(a["trait_type"], a["value"]))
    first = F.filter(kept, lambda a, n: F.array_position(pairs, F.struct(a["trait_type"], a["value"])) == n + 1)
    return F.transform(first, lambda a: F.struct(a["trait_type"], a["value"], a["position"].cast("int").alias("position"))).cast(TRAITS)


def normalize_attributes(rows: DataFrame, attributes: Column, key: str = "address") -> DataFrame:
    return rows.select(key, F.inline(normalized(attributes)))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def snapshot_merge(snapshots: DataFrame, documents: DataFrame) -> DataFrame:
    """One input row per asset; the document wins field by field over the snapshot.

    ``attributes`` NULL means not observed; an empty list of a document is observed, an
    empty list of a snapshot is not."""
    d = documents.select("address", "source_uri", "doc", "lists_attributes")
    from_doc = F.when(F.coalesce("lists_attributes", F.lit(False)), normalized(F.coalesce(
        F.col("doc.attributes"), F.array().cast("array<struct<trait_type:string,value:string>>"))))
    from_snapshot = normalized(F.col("content.metadata.attributes"))
    from_snapshot = F.when(F.size(from_snapshot) > 0, from_snapshot)
    meta = F.col("content.metadata")
    return snapshots.join(d, "address", "left").select(
        "address", F.coalesce(_filled(F.col("doc.name")), meta["name"], F.lit("")).alias("name"),
        F.coalesce(_filled(F.col("doc.symbol")), meta["symbol"]).alias("symbol"),
        F.col("content.json_uri").alias("metadata_uri"), F.col("source_uri").alias("metadata_source_uri"),
        F.coalesce(document_image(F.col("doc")), asset_image(F.col("content"))).alias("image_uri"),
        F.col("burnt").alias("burned"), observed_owner(F.col("owner"), F.col("burnt")).alias("owner"),
        F.coalesce(from_doc, from_snapshot).alias("attributes"))


def land_documents(stored: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """Store fetched JSON; ``fetched_at`` moves only when the content or the source changed.
    Bodies are compared as parsed values, so reordered keys are no change."""
    def state(p: str) -> Column:
        return F.struct(F.to_json(F.parse_json(F.col(f"{p}.body"))).alias("body"), F.col(f"{p}.source_uri").alias("uri"))

    old = stored.select("asset_id", F.struct("body", "source_uri", "fetched_at").alias("o"))
    new = fetched.select("asset_id", F.struct("body", "source_uri").alias("n"))
    out = old.join(new, "asset_id", "full_outer")
    action = (F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept")
              .when(state("o").eqNullSafe(state("n")), "unchanged").otherwise("updated"))
    write = F.col("action").isin("inserted", "updated")
    return out.withColumn("action", action).select(
        "asset_id", F.when(write, F.col("n.body")).otherwise(F.col("o.body")).alias("body"),
        F.when(write, F.col("n.source_uri")).otherwise(F.col("o.source_uri")).alias("source_uri"),
        F.when(write, F.lit(as_of).cast("timestamp")).otherwise(F.col("o.fetched_at")).alias("fetched_at"), "action")


STORE = {
    "assets": "id BIGINT, address STRING, collection_id INT, name STRING, symbol STRING, metadata_uri STRING, metadata_source_uri STRING, "
              "image_uri STRING, burned BOOLEAN, owner STRING, owner_slot BIGINT",
    "attributes": "asset_id BIGINT, collection_id INT, trait_type STRING, value STRING, position INT",
    "documents": "asset_id BIGINT, body STRING, source_uri STRING, fetched_at TIMESTAMP",
    "runs": "collection_id INT, kind STRING, status STRING, slot BIGINT, members BIGINT, inserted BIGINT, updated BIGINT, unchanged BIGINT, skipped BIGINT, "
            "attributes_written BIGINT, attributes_removed BIGINT, documents BIGINT, missing BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP",
}
RUN_KIND, DEEP_KIND = "assets", "deep"


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in STORE[table].split(", ")]


def known_documents(stored: dict[str, DataFrame], fetched: DataFrame) -> DataFrame:
    """Landed documents to merge with: the fetched ones that could be read, and for other assets the stored copy, which a snapshot must not
    override only because nobody fetched it this time."""
    landed = land_documents_json(fetched)
    addresses = stored["assets"].select(F.col("id").alias("asset_id"), "address")
    kept = stored["documents"].select("asset_id", "body", "source_uri").join(addresses, "asset_id").join(landed.select("address"), "address", "left_anti")
    return landed.unionByName(land_documents_json(kept.select("address", "source_uri", "body")))


def snapshot_job(stored: dict[str, DataFrame], snapshots: DataFrame, fetched: DataFrame, homes: DataFrame, slot: int, as_of: str,
                 limited: bool = False) -> dict[str, DataFrame]:
    """Land, merge, upsert, store documents, replace attributes, log the run.

    ``stored``: the tables of STORE; ``snapshots``: landed; ``fetched``: (address, source_uri, body); ``homes``: (address,
    collection_id), what the listing of each collection says. New assets get the ids after the highest stored one, by address. An
    address stored under another collection is skipped whole. Assets whose attributes were not observed keep them. A ``limited``
    run is never logged as done.

    Returns the new tables under their names, each with an ``action``; the counts of actions; and ``runs``, a row per collection and kind.
    Run again on its own result it changes nothing but the times of its runs."""
    documents = known_documents(stored, fetched)
    # parsed once, read by the asset and the attribute side
    merged = durable(snapshot_merge(snapshots, documents).join(homes, "address").withColumn(
        "owner_slot", F.lit(slot).cast("long")).withColumn("ord", F.col("collection_id")))
    upserted = durable(merge.upsert_assets(stored["assets"], merged.drop("attributes")))
    highest = stored["assets"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = number_rows(upserted.where("action = 'inserted'").select("address"), ["address"], "id", highest)
    ids = stored["assets"].select("address", "id").unionByName(new.select("address", "id"))
    assets = durable(upserted.join(ids, "address", "left").select(*_columns("assets"), "action"))
    # an address stored under another collection is skipped whole, its attributes and its document too
    accepted = assets.where(F.col("action").isin("inserted", "updated", "unchanged")).select("address", "collection_id", F.col("id").alias("asset_id"))
    seen = merged.where(F.col("attributes").isNotNull()).join(accepted, ["address", "collection_id"]).select("asset_id", "collection_id", "attributes")
    attributes = merge.replace_attributes(stored["attributes"], seen.select("asset_id"), seen.select("asset_id", "collection_id", F.inline("attributes")))
    kept = land_documents(stored["documents"], land_documents_json(fetched).join(accepted, "address").select("asset_id", "body", "source_uri"), as_of)
    attributes, kept = durable(attributes), durable(kept)
    counts = {
        "asset_counts": merge.action_counts(assets, "collection_id"), "attribute_counts": merge.action_counts(attributes, "collection_id"),
        "document_counts": merge.action_counts(kept.join(assets.select(F.col("id").alias("asset_id"), "collection_id"), "asset_id"), "collection_id"),
    }
    runs = _log(stored["runs"], counts, homes, missing_snapshots(homes, snapshots), slot, as_of, "running" if limited else "done")
    return {"assets": assets, "attributes": attributes, "documents": kept, "runs": runs, **counts}


def _log(stored: DataFrame, counts: dict[str, DataFrame], homes: DataFrame, missing: DataFrame, slot: int, as_of: str, status: str) -> DataFrame:
    """The run log with a row for each collection that was asked for."""
    def of(name: str, **columns: tuple[str, ...]) -> DataFrame:
        return counts[name].groupBy("collection_id").agg(*[
            F.sum(F.when(F.col("action").isin(*actions), F.col("n")).otherwise(0)).alias(c) for c, actions in columns.items()])

    now = F.lit(as_of).cast("timestamp")
    rows = homes.groupBy("collection_id").agg(F.count(F.lit(1)).alias("members"))
    for part in (of("asset_counts", inserted=("inserted",), updated=("updated",), unchanged=("unchanged",), skipped=("skipped_foreign",)),
                 of("attribute_counts", attributes_written=("inserted", "updated"), attributes_removed=("removed",)),
                 of("document_counts", documents=("inserted", "updated")),
                 missing.groupBy("collection_id").agg(F.count(F.lit(1)).alias("missing"))):
        rows = rows.join(part, "collection_id", "left")
    rows = rows.na.fill(0).withColumns({
        "kind": F.lit(RUN_KIND), "status": F.lit(status), "slot": F.lit(slot).cast("long"), "started_at": now,
        "finished_at": now if status == "done" else F.lit(None).cast("timestamp")}).select(*_columns("runs"))
    others = stored.join(rows.select("collection_id", "kind"), ["collection_id", "kind"], "left_anti").select(*_columns("runs"))
    return others.unionByName(rows)


def deep_reconcile(job: dict[str, DataFrame]) -> DataFrame:
    """Corrections of a full pass, by collection: assets inserted or updated, attributes written or removed, documents stored."""
    fixed = F.col("action").isin("inserted", "updated", "removed")
    counts = job["asset_counts"].unionByName(job["attribute_counts"]).unionByName(job["document_counts"])
    return counts.groupBy("collection_id").agg(F.sum(F.when(fixed, F.col("n")).otherwise(F.lit(0))).alias("corrections"))


def run_snapshot_job(spark: SparkSession, store: str, raw_snapshots: DataFrame, fetched: DataFrame, homes: DataFrame, slot: int, as_of: str,
                     limited: bool = False, deep: bool = False) -> dict[str, DataFrame]:
    """``snapshot_job`` from and to a versioned store, the run log in the same commit. A ``deep`` run logs its corrections under a kind of its own too."""
    stored = committed_tables(spark, store, STORE)
    job = snapshot_job(stored, land_snapshots(raw_snapshots), fetched, homes, slot, as_of, limited)
    runs = job["runs"]
    if deep:
        own = runs.where(F.col("kind") == RUN_KIND).join(homes.select("collection_id").distinct(), "collection_id", "left_semi").withColumn("kind", F.lit(DEEP_KIND))
        runs = runs.join(own.select("collection_id", "kind"), ["collection_id", "kind"], "left_anti").unionByName(own)
    rows = {name: job[name].where("action not in ('removed', 'invalid')").select(*_columns(name)) for name in ("assets", "attributes", "documents")}
    commit_tables(spark, store, {**rows, "runs": runs.select(*_columns("runs"))})
    return job
