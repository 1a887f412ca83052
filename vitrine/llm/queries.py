"""The registered queries of this subpackage: thin digests of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import credentials, crawl, licenses, mixing, negatives, packing, quality, simhash, substring, topk, toxicity, vectors, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer_path())
    digests = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, packing.group_count(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 3; rows of fold 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label) of the rows that models may learn from."""
    rows = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & (fold() != 2))
    return rows.select("doc_id", F.col(label).alias("label"))


def scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, fit_labels(spark, sf_dir, "quality"))
    return scored(quality.score_quality(docs, model), 0.7)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, fit_labels(spark, sf_dir, "toxic"))
    return scored(toxicity.score_toxicity(docs, model), 0.3)


@query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


@query("op3_topk", """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5""")
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


CANONICAL = """
  case when regexp_extract(trim(u), e, 1) = '' then trim(u) else
    lower(regexp_extract(trim(u), e, 1)) || '://'
    || regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(u), e, 2)), '^.*@', ''), '^www\\.', ''),
                      case lower(regexp_extract(trim(u), e, 1)) when 'http' then ':80$' when 'https' then ':443$' else '$^' end, '')
    || case regexp_extract(trim(u), e, 3) when '' then '/' else regexp_extract(trim(u), e, 3) end
    || case array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(u), e, 4), '&'), lambda q: q <> '' and not regexp_matches(
         lower(q), '^(utm_[a-z]+|sid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') when '' then '' else '?' || array_to_string(list_sort(list_filter(
         string_split(regexp_extract(trim(u), e, 4), '&'), lambda q: q <> '' and not regexp_matches(
         lower(q), '^(utm_[a-z]+|sid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') end end"""


@query("op8_warc_revisits", f"""
with p as (
  select page_id as p, url as u, 1577836800 + page_id * 60 as t, octet_length(encode(coalesce(html, ''))) as n,
    substr(md5(coalesce(html, '')), 1, 12) as e1, substr(md5(coalesce(html, '') || '2'), 1, 12) as e2,
    '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$' as e
  from pages where page_id is not null and url is not null),
c as (select *, {CANONICAL} as c from p),
f as (
  select c, t as "at", 'urn:page:' || p || ':0' as id, e1 as tag, n from c
  union all select c, t + 259200, 'urn:page:' || p || ':2', e2, n from c where p % 3 = 0),
r as (
  select c, p, t + (1 + p % 5) * 86400 as "at", 1 as nth, case when p % 4 = 0 then '0' else e1 end as tag, null as changed from c
  union all select c, p, t + 691200, 3, null, cast(case when p % 6 = 0 then t + 259200 else t end as varchar) from c where p % 2 = 0),
j as (
  select r.*, m.id as mid, m.tag as mtag, m."at" as mat, m.n as mn,
    row_number() over (partition by r.p, r.nth order by m."at" desc nulls last, m.id desc, m.tag desc) as k
  from r left join f m on m.c = r.c and m."at" < r."at"),
o as (select *, case when mid is null then 'no original' when coalesce(tag = mtag, changed = cast(mat as varchar)) then 'resolved' else 'mismatch' end as outcome
  from j where k = 1)
select 'urn:page:' || p || ':' || nth as record_id, c as url, "at", outcome, mid as original_id,
  case outcome when 'resolved' then 200 end as status,
  case outcome when 'resolved' then array_to_string(list_sort([
    'age: ' || nth, 'cache-control: max-age=' || (p % 1000), 'content-length: ' || mn, 'content-type: text/html', 'etag: "' || mtag || '"',
    'last-modified: ' || coalesce(changed, cast(mat as varchar))]), chr(10)) end as headers,
  case outcome when 'resolved' then 'md5:' || mtag end as payload_digest, case outcome when 'resolved' then cast(mn as bigint) end as payload_length
from o""")
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = crawl.crawl(table(spark, sf_dir, "pages"))
    lines = F.array_sort(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])))
    return warc.resolve_revisits(warc.parse_warc(records)).withColumn("headers", F.array_join(lines, "\n"))


@query("op11_hard_negatives", """
with v as (
  select distinct vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as row_id, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
p as (
  select anchor_id, row_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, row_id) as int) as rank,
  row_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_secrets")
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = credentials.find_secrets(docs, credentials.fit_formats(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != credentials.FORMAT)
    return found.select("doc_id", *(of(b[0]).alias(f"n_{b[0]}") for b in credentials.BASE), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), of(credentials.FORMAT).alias("n_format"))
