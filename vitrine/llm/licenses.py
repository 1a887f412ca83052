"""License scan by ordered signature rules, in built-in functions only.

Most texts hold none of the rules' keywords and are done after that test. For the others the words are normalised
once and the rules whose keyword is there are run. A match is an interval of the normalised text; its place is the
running sum of the gaps and matches before it, taken over exploded rows, so that a text with any number of matches
is no large cell. Two ordered passes over a document's intervals resolve overlaps: a detection within another of at
least its priority goes, and so does one around another of higher priority; of equals the earlier rule stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.license_rules import rules
from vitrine.session import write_table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# phrase: label; a place is where the phrase's words stand in a row
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.95}
LEVELS = sorted(CONFIDENCE)


def _whole(pattern: str) -> str:
    """``pattern`` between spaces that it doesn't consume."""
    return f"(?<= )(?:{pattern})(?= )"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_words, n_base, first_word, last_word, base_labels, detections, labels, score) for each row.

    ``detections``: the distinct (label, priority) that stay after suppression; ``labels``: theirs and the base ones,
    sorted; ``score``: 0 without a label, else 1 less the product of the labels' doubts. ``version`` is the XXH64 of the
    text. A NULL text counts as empty. Repeated rows each get the same answer; extra columns are left out."""
    table = rules()
    keywords = sorted({k for _, _, k, _ in table} | {"license", "cc"})
    keyword_id = {k: i for i, k in enumerate(keywords)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # lower() lowers more than A to Z, but leaves every ASCII keyword standing
    rows = rows.withColumn("plain", F.lower("text"))
    hits = F.array_compact(F.array(*[F.when(F.contains("plain", F.lit(k)), F.lit(i)) for k, i in keyword_id.items()]))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("version"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), hits.alias("hits"))
    words = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), NOT_WORD, " "))
    rows = rows.withColumn("norm", F.when(F.size("hits") > 0, F.concat(F.lit(" "), words, F.lit(" "))))

    count, first, last, labels = [], [], [], []
    norm = F.col("norm")
    for phrase, label in PHRASES.items():
        n = F.when(F.contains(norm, F.lit(phrase)), F.regexp_count(norm, F.lit(_whole(phrase)))).otherwise(F.lit(0))
        n = F.coalesce(n, F.lit(0)).cast("long")
        padded = f" {phrase} "
        at = F.locate(padded, norm)
        back = F.length(norm) - F.locate(padded[::-1], F.reverse(norm)) - len(padded) + 2
        count.append(n)
        first.append(F.when(n > 0, _spaces(F.substring(norm, F.lit(1), at)) - 1))
        last.append(F.when(n > 0, _spaces(F.substring(norm, F.lit(1), back)) - 1))
        labels.append(F.when(n > 0, F.lit(label)))

    signatures = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(priority).alias("priority"),
                                    F.lit(keyword_id[k]).alias("keyword"), F.lit(_whole(pattern)).alias("pattern"))
                           for i, (label, priority, k, pattern) in enumerate(table)])
    active = F.filter(signatures, lambda r: F.array_contains(F.col("hits"), r["keyword"]))
    gaps = F.transform(active, lambda r: F.struct(r.alias("r"), F.split(norm, r["pattern"]).alias("gaps")))
    found = F.transform(F.filter(gaps, lambda g: F.size(g["gaps"]) > 1), lambda g: F.struct(
        g["r"]["rule"].alias("rule"), g["r"]["label"].alias("label"), g["r"]["priority"].alias("priority"),
        F.transform(g["gaps"], lambda x: F.length(x)).alias("gaps"),
        F.transform(F.regexp_extract_all(norm, g["r"]["pattern"], F.lit(0)), lambda x: F.length(x)).alias("sizes")))
    scanned = write_table(rows.select(
        "doc_id", "version", "n_words", reduce(Column.__add__, count).alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"),
        F.when(norm.isNotNull(), found).alias("found")), "scanned")

    kept = resolve(intervals(scanned)).groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("label", "priority"))).alias("detections"))
    kept = kept.withColumnsRenamed({"doc_id": "of", "version": "at"})
    hit = scanned.drop("found").join(kept, (F.col("version") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    by_label = F.coalesce("detections", F.array().cast("array<struct<label:string,priority:int>>"))
    doubt = lambda p: F.element_at(F.create_map(*[F.lit(x) for k, v in CONFIDENCE.items() for x in (k, 1 - v)]), p)
    detected = F.aggregate(by_label, F.lit(1.0), lambda d, x: d * doubt(x["priority"]))
    base_doubt = F.when(F.col("n_base") > 0, F.lit(1 - CONFIDENCE[3])).otherwise(1.0)
    return hit.select(
        "doc_id", "version", "n_words", "n_base", "first_word", "last_word", "base_labels", by_label.alias("detections"),
        F.array_sort(F.array_union("base_labels", F.transform(by_label, lambda x: x["label"]))).alias("labels"),
        F.round(1 - detected * base_doubt, 6).alias("score"))


def intervals(scanned: DataFrame) -> DataFrame:
    """(doc_id, version, rule, label, priority, start, end) of all matches: places in the normalised text."""
    one = scanned.where(F.size("found") > 0).select("doc_id", "version", F.explode("found").alias("f"))
    one = one.select("doc_id", "version", "f.rule", "f.label", "f.priority", F.posexplode(F.arrays_zip(
        F.slice("f.gaps", F.lit(1), F.size("f.sizes")).alias("gap"), F.col("f.sizes").alias("size"))).alias("nth", "m"))
    one = one.select("doc_id", "version", "rule", "label", "priority", "nth", F.col("m.gap").alias("gap"), F.col("m.size").alias("size"))
    one = one.distinct()  # repeated rows
    upto = Window.partitionBy("doc_id", "version", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return one.select("doc_id", "version", "rule", "label", "priority", (end - F.col("size")).alias("start"), end.alias("end"))


def resolve(found: DataFrame) -> DataFrame:
    """Rows of ``found`` that no other row of the document suppresses."""
    def most(value: str, above: int, w) -> Column:
        return F.max(F.when(F.col("priority") >= above, F.col(value))).over(w)

    doc = Window.partitionBy("doc_id", "version")
    before = doc.orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = doc.orderBy("end", F.desc("start"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered, around = F.lit(False), F.lit(False)
    marks = {}
    for level in LEVELS:
        marks[f"_end{level}"] = most("end", level, before)
        marks[f"_start{level}"] = most("start", level + 1, inside)
        here = F.col("priority") == level
        covered = covered | F.coalesce(here & (F.col(f"_end{level}") >= F.col("end")), F.lit(False))
        around = around | F.coalesce(here & (F.col(f"_start{level}") >= F.col("start")), F.lit(False))
    return found.withColumns(marks).where(~covered & ~around).select(*found.columns)
