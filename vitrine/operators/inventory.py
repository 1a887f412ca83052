"""File inventories: what is there, what should be, and what points where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.schemas import DOCUMENT


def read_files(spark, path: str) -> DataFrame:
    """(path, content) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def file_inventory(files: DataFrame) -> DataFrame:
    """Path, size, digest and verdict of each JSON file."""
    value = F.try_parse_json(F.decode("content", "UTF-8"))
    problem = F.when(value.isNull(), "not valid JSON").when(
        ~F.ltrim(F.decode("content", "UTF-8")).startswith("{"), "not a JSON object")
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"),
                        problem.alias("problem"))


def manifest_diff(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every path with its verdict. A path listed twice in the manifest is an error of its own."""
    listed = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min("sha256").alias("_want"))
    found = inventory.select("path", F.col("sha256").alias("_got"), "problem")
    status = (F.when(F.col("_n") > 1, "DUPLICATE").when(F.col("_got").isNull(), "MISSING")
              .when(F.col("_want").isNull(), "EXTRA").when(F.col("_want") != F.col("_got"), "CHANGED")
              .when(F.col("problem").isNotNull(), "UNREADABLE").otherwise("OK"))
    return listed.join(found, "path", "full_outer").select("path", status.alias("status"))


def journal_latest(journal: DataFrame, expected: DataFrame) -> DataFrame:
    """Last record per expected (set, key) of an append-only journal ordered by ``line_no``."""
    rest = [c for c in journal.columns if c not in ("set", "key")]
    last = journal.groupBy("set", "key").agg(F.max_by(F.struct(*rest), "line_no").alias("r"))
    return expected.join(last, ["set", "key"], "left").select(
        "set", "key", F.coalesce("r.status", F.lit("never fetched")).alias("status"),
        *[F.col(f"r.{c}").alias(c) for c in rest if c != "status"])


def manifest_summary(latest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per set: keys, files, absent ones, bytes, sizes, proofs, times, problems.

    ``latest``: (set, key, path, status, size, sha256, proven, fetched_at). A file counts
    only if its size and digest are the journal's and its origin was proven."""
    disk = inventory.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), "problem")
    rows = latest.join(disk, "path", "left")
    ok = F.col("status") == "ok"
    same = ok & F.coalesce((F.col("_size") == F.col("size")) & (F.col("_sha") == F.col("sha256")), F.lit(False))
    good = same & F.coalesce("proven", F.lit(False))
    size = F.when(good, F.col("_size"))
    return rows.groupBy("set").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(good).alias("files"), F.count_if(~ok).alias("absent"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min(size).alias("smallest"), F.max(size).alias("largest"),
        F.min(F.when(good, F.col("fetched_at"))).alias("first_fetched"),
        F.max(F.when(good, F.col("fetched_at"))).alias("last_fetched"),
        F.count_if(ok & ~same).alias("differ"), F.count_if(same & ~good).alias("unproven"),
        F.count_if(good & F.col("problem").isNotNull()).alias("content_problems"))


@dataclass(frozen=True)
class Rule:
    """URLs ``prefix + key + suffix`` are kept at ``folder/key.ext``."""

    prefix: str
    suffix: str
    folder: str
    ext: str
    key: str = "[A-Za-z0-9]+"

    def path(self, url: Column) -> Column:
        pattern = "^" + _quoted(self.prefix) + f"({self.key})" + _quoted(self.suffix) + "$"
        found = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
        return F.concat(F.lit(self.folder + "/"), found, F.lit("." + self.ext))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def references(documents: DataFrame) -> DataFrame:
    """URLs each document points at. ``documents``: (path, key, body)."""
    doc = documents.select("path", "key", F.from_json("body", DOCUMENT).alias("d"))
    files = F.coalesce(F.transform("d.properties.files", lambda f: f["uri"]), F.array().cast("array<string>"))
    urls = F.array_compact(F.concat(F.array("d.image", "d.animation_url"), files))
    return doc.select("path", "key", F.col("d.image").alias("image"), F.posexplode(urls).alias("pos", "url"))


def resolve(refs: DataFrame, rules: list[Rule]) -> DataFrame:
    return refs.withColumn("target", F.coalesce(*[r.path(F.col("url")) for r in rules]))


def reference_closure(documents: DataFrame, rules: list[Rule], inventory: DataFrame) -> DataFrame:
    """References that lead outside the inventory, counted per host."""
    refs = resolve(references(documents), rules)
    lost = refs.join(inventory.select(F.col("path").alias("target")), "target", "left_anti")
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("(not a URL)"))
    return lost.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def own_image_mismatch(documents: DataFrame, url_of: Column) -> DataFrame:
    """Documents whose image is not the one that belongs to their key."""
    image = F.get_json_object("body", "$.image")
    return documents.where(~image.eqNullSafe(url_of)).select("path", image.alias("image"))


def pairing(documents: DataFrame, rules: list[Rule], folder: str, pairs: DataFrame) -> DataFrame:
    """Does a document that names a file of ``folder`` name the one a second map gives it?
    ``pairs``: (key, other)."""
    old = resolve(references(documents), rules).where(F.col("target").startswith(folder + "/"))
    named = old.join(pairs, "key").groupBy("key").agg(
        F.bool_or(F.col("target") == F.concat(F.lit(folder + "/"), F.col("other"), F.lit(".png"))).alias("agrees"))
    return named.groupBy("agrees").agg(F.count(F.lit(1)).alias("n"))
