"""The corpus pipeline over ``documents``: quality, near copies, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and reads it back as the next one's input."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import mixing, packing, quality, simhash, substring
from vitrine.llm.queries import fit_labels, tokenizer_path
from vitrine.llm.text import WORD
from vitrine.session import write_table

#: Documents scored below are rejected.
LEAST_QUALITY = 0.5
#: Texts of one Arrow batch; Spark's default of 10 000 is a whole split of documents.
BATCH_ROWS = 1000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit_quality(docs, fit_labels(spark, sf_dir, "quality"))
    # scores are stored first: a filter on the expression would be pushed below it and take the statistics for every rule anew
    marked = _versioned(docs)
    scores = write_table(quality.score_quality(marked, model).select("doc_id", "version", "score"), "scores")
    rejected = scores.where(F.col("score") < LEAST_QUALITY).select("doc_id", "version").distinct()
    return simhash.join_ids(marked, rejected, ["doc_id", "version"], "left_anti").select(*docs.columns)


def _versioned(docs: DataFrame) -> DataFrame:
    """``docs`` with the MD5 of their texts as ``version``."""
    return docs.withColumn("version", F.md5(F.coalesce("text", F.lit(""))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    copies = write_table(simhash.near_copies(docs).where(~F.col("head")).select("doc_id", "version").distinct(), "copies")
    return simhash.join_ids(_versioned(docs), copies, ["doc_id", "version"], "left_anti").select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of at least 13 words that one with a smaller id has too; those with nothing left go."""
    kept = substring.remove_repeats(docs, layout=True)
    kept = kept.where((F.col("n_words") == 0) | (F.rlike("kept", F.lit(WORD))))
    return _with_text(docs, kept.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("kept").alias("_text")))


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``texts`` (_id, _version, _text), one row for each of those; n_chars follows."""
    about = docs.withColumn("_v", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text").dropDuplicates(["doc_id", "_v"])
    joined = texts.join(about, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_version") == F.col("_v")))
    joined = joined.withColumn("text", F.col("_text")).withColumn("n_chars", F.length("_text").cast("long"))
    return joined.select(*docs.columns)


def _one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without repetitions of ``keys``; only rows that are repeated are shuffled."""
    twice = write_table(rows.groupBy(*keys).count().where("count > 1").select(*keys), "twice")
    once = simhash.join_ids(rows, twice, keys, "left_anti").select(*rows.columns)
    return once.unionByName(simhash.join_ids(rows, twice, keys, "left_semi").select(*rows.columns).dropDuplicates(keys))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken whole, and once more the words taken of it in part."""
    plan = mixing.mix_sources(docs).where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("source").alias("_source"), "passes", "slices")
    rows = _one_of_each(docs.withColumn("_v", F.xxhash64("text")), ["doc_id", "_v", "source"])
    joined = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_v") == F.col("_version"))
                       & F.col("source").eqNullSafe(F.col("_source")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("slices", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["length"].cast("int")))), " ")
    texts = F.concat(F.array_repeat("text", F.col("passes").cast("int")), F.when(F.size("slices") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = joined.withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences, as op7 gives them."""
    pieces = packing.token_pieces(docs, tokenizer_path())
    digests = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, packing.group_count(docs))


def _small_batches(stage):
    """``stage`` with whole texts handed to Python by BATCH_ROWS; a batch is held by the JVM and by the worker at once."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(stage.__name__, _small_batches(stage)) for stage in (quality_filter, near_dedup, passage_dedup, mix, pack)]

#: A fitted classifier, fingerprints and a tokenizer: not for SQL. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
