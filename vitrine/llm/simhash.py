"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two halves of 32 bits. Fingerprints at most 3 bits apart differ in at
most one bit of one half, so every fingerprint is put into the table of each of its halves and
asks for each half with one bit more set (of two halves one bit apart, the one lacking the bit
asks for the other). Rows of one half value meet in the shuffle; complete distances are then
verified there. A link is only reported where it joins two parts of a bucket not yet joined, so
that a group of n near copies gives n - 1 links, not n * n."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.llm.text import LOWER, Slice, grams, mix, slices, tidy
from vitrine.session import write_table

RADIUS = 3
SEED = 42
FP_WIDTH = 3  # near_copies: words of a shingle of its fingerprints, as in near_duplicates
# near_copies: MinHash bands of each text. Of pairs with Jaccard similarity j, (1 - j ** BAND_ROWS) ** BANDS meet in none:
# 0.5 % at 0.8, whatever the kind of edit
BANDS, BAND_ROWS = 10, 4
_rng = np.random.default_rng(SEED)
_ADD, _TIMES = _rng.integers(0, 1 << 64, (2, BANDS, BAND_ROWS), dtype=np.uint64) | np.array([0, 1], np.uint64)[:, None, None]
# near_copies: shingles of one block of a bucket, and what each of its texts counts besides
CELL_BYTES, CELL_TEXT = 4 << 20, 512
# ids are broadcast up to this many, about 50 MB; beyond, both sides are shuffled
BROADCAST_IDS = 1_000_000
# Above this many rows of one half value, rows are compared where a byte of the other half agrees.
PLAIN_RUN = 4096


def fingerprint(text: str | None, width: int) -> int:
    """64 bits: set where over half of the shingles' XXH64 have the bit set; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    k = min(width, len(words))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at: min(at + (1 << 16), n)].tolist(), ends[at + k - 1: at + k - 1 + (1 << 16)].tolist())
        part = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row. NULL and empty texts have fingerprint 0; extra columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long")


def _half(fp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half of each fingerprint that its key names, and the other half."""
    high, low = fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF)
    upper = (key >> np.uint64(32) & np.uint64(1)).astype(bool)
    return np.where(upper, high, low), np.where(upper, low, high)


def _spanning(fp: np.ndarray, stored: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of one bucket that join all that lies within RADIUS of a stored row."""
    part = np.arange(len(fp))
    found = []

    def join(i: int, rows: np.ndarray) -> None:
        rows = rows[part[rows] != part[i]]
        near = rows[np.bitwise_count(fp[rows] ^ fp[i]) <= RADIUS]
        for p in np.unique(part[near]):
            j = near[part[near] == p][0]
            found.append((fp[i], fp[j]))
            part[part == p] = part[i]

    everything = np.arange(len(fp))
    if len(fp) <= PLAIN_RUN:
        for i in np.flatnonzero(stored):
            if not (part == part[0]).all():
                join(i, everything)
    else:  # at most 3 bits over four bytes: one byte agrees
        for shift in (0, 8, 16, 24):
            byte = (other >> np.uint64(shift)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
                for i in rows[stored[rows]]:
                    if not (part[rows] == part[rows[0]]).all():
                        join(i, rows)
    return found


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links (of, u, v)."""
    kept = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        half, other = _half(fp, key)
        stored = half == (key & np.uint64(0xFFFFFFFF))
        edges = np.flatnonzero(np.diff(key)) + 1
        begins, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        if len(key) == 0:
            begins = ends = np.zeros(0, int)
        has = np.add.reduceat(stored, begins, dtype=int) if len(begins) else begins
        found: list[tuple[int, int]] = []
        of: list[int] = []
        for i in np.flatnonzero((ends - begins > 1) & (has > 0)):
            s = slice(begins[i], ends[i])
            links_here = _spanning(fp[s], stored[s], other[s])
            found += links_here
            of += [int(key[begins[i]] >> np.uint64(33))] * len(links_here)
        out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], ["of", "u", "v"])

    pending: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        key, fp = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        pending.append((key, fp))
        if key[0] == key[-1]:
            continue  # the run may go on
        key, fp = (np.concatenate([p[i] for p in pending]) for i in (0, 1))
        cut = int(np.searchsorted(key, key[-1]))
        yield links(key[:cut], fp[:cut])
        pending = [(key[cut:].copy(), fp[cut:].copy())]
    if pending:
        yield links(*(np.concatenate([p[i] for p in pending]) for i in (0, 1)))


def fingerprint_links(fps: DataFrame, of: Column | None = None) -> DataFrame:
    """Links (of, u, v) that connect all distinct fingerprints of ``fps`` (fp) within RADIUS bits, apart for each value of
    ``of``, a small number."""
    of = F.lit(0) if of is None else of
    keys = []
    for segment, half in enumerate((F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))):
        key = of.cast("long") * F.lit(1 << 33) + F.lit(segment << 32) + half
        keys.append(key)
        keys += [F.when(half.bitwiseAND(F.lit(1 << bit)) == 0, key + F.lit(1 << bit)) for bit in range(32)]
    keyed = fps.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(tidy(_bucket_links), "of int, u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: documents whose fingerprints link,
    directly or over others, share a component, named by its smallest doc_id.

    A NULL doc_id never names a component; if all of a component's are NULL, so is its name.
    Repeated rows each stay. NULL and empty texts are linked by fingerprint 0 like any other. An
    empty table gives an empty table."""
    rows = write_table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(fps.select("fp"))).withColumnRenamed("node", "fp")
    placed = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _band_keys(s: Slice, width: int, bands: int) -> np.ndarray:
    """(rows, bands) keys of each row: a hash of BAND_ROWS smallest shingle hashes, each by a permutation of its own. Rows
    without words get 0."""
    lowered = Slice(s.first, np.frombuffer(s.data.tobytes().translate(LOWER), np.uint8), s.offsets, s.starts, s.ends, s.counts)
    words, bounds = lowered.hashes(), s.bounds
    row = np.repeat(np.arange(len(s.counts)), s.counts)
    inside = np.flatnonzero(np.arange(len(words)) + width <= bounds[1:][row])  # shingles that don't cross rows
    shingles, row = grams(words, width)[inside], row[inside]
    short = np.flatnonzero((s.counts > 0) & (s.counts < width))
    one = [grams(words[bounds[r]: bounds[r + 1]], int(s.counts[r])) for r in short]
    row = np.concatenate([row, short])
    order = np.argsort(row, kind="stable")
    row, shingles = row[order], np.concatenate([shingles, *one])[order]
    out = np.zeros((len(s.counts), bands), np.uint64)
    if len(row):
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for band in range(bands):
            key = np.full(len(begins), band, np.uint64)
            for add, times in zip(_ADD[band], _TIMES[band]):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((shingles ^ add) * times, begins))
            out[row[begins], band] = key
    return out


def _keys_of(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(2)):
                keys = _band_keys(s, width, bands).view(np.int64)
                n = len(s.counts)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(bands), pa.array(keys.ravel()))
                fps = np.fromiter((fingerprint(t.as_py(), FP_WIDTH) for t in b.column(2).slice(s.first, n)), np.uint64, n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, n), b.column(1).slice(s.first, n), lists, pa.array(s.counts),
                                                  pa.array(fps.view(np.int64))], ["doc_id", "version", "keys", "n_words", "fp"])
    return run


def _shingles_of(width: int):
    """(version, text) to the different shingles' hashes of each text, sorted, 4 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                lowered = Slice(s.first, np.frombuffer(s.data.tobytes().translate(LOWER), np.uint8), s.offsets, s.starts, s.ends, s.counts)
                words, bounds, out = lowered.hashes(), s.bounds, []
                for r in range(len(s.counts)):
                    own = words[bounds[r]: bounds[r + 1]]
                    hashes = grams(own, min(width, len(own))) if len(own) else own
                    out.append(np.unique(hashes.astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(out)), pa.array(out, pa.binary())], ["version", "shingles"])
    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                one, other = (np.frombuffer(b.column(c)[i].as_py(), np.uint32) for c in (2, 3))
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(other) - both) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _join_parts(similarity: float):
    """Members of one cell (version, root, shingles) to links (a, b) that join its roots over pairs alike. Every pair of
    members of different roots is compared unless other pairs have joined them."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(["version", "root", "shingles"]).combine_chunks()
        version, shingles = rows["version"].to_pylist(), rows["shingles"].to_pylist()
        part = np.unique(np.array(rows["root"].to_pylist(), object), return_inverse=True)[1]
        size = np.array([len(s) // 4 for s in shingles])
        begins = np.cumsum(size) - size
        words, ids = np.unique(np.frombuffer(b"".join(shingles), np.uint32), return_inverse=True)
        mark = np.zeros(len(words), bool)
        found, left = [], np.ones(len(version), bool)
        while left.any():
            queue = np.flatnonzero(left & (part == part[np.argmax(left)])).tolist()
            left[queue] = False
            while queue and left.any():
                i = queue.pop()
                others = np.flatnonzero(left)
                others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9]
                own = ids[begins[i]: begins[i] + size[i]]
                mark[own] = True
                for at in range(0, len(others), 256):
                    some = others[at: at + 256]
                    some = some[left[some]]
                    if not len(some):
                        continue
                    ends = np.cumsum(size[some])
                    of = np.repeat(begins[some] - ends + size[some], size[some]) + np.arange(ends[-1])
                    both = np.add.reduceat(mark[ids[of]], ends - size[some], dtype=np.int64)
                    for j in some[both >= similarity * (size[i] + size[some] - both) - 1e-9]:
                        if left[j]:
                            found.append((version[i], version[j]))
                            reached = np.flatnonzero(left & (part == part[j]))
                            left[reached] = False
                            queue += reached.tolist()
                mark[own] = False
        return pa.table({"a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string())})
    return run


def _part_links(shared: DataFrame, roots: DataFrame, shingles: DataFrame, similarity: float, cell_bytes: int) -> DataFrame:
    """Links (a, b) between texts of one bucket that ``roots`` (node, root) leaves in different parts.

    A bucket's members meet in one cell while their shingles fit ``cell_bytes``. The members of a larger one are dealt into blocks, apart
    for its largest part and the rest: each block of the rest meets itself and all other blocks, so every pair of parts meets."""
    placed = shared.where("n > 2").join(roots, shared["version"] == roots["node"], "left").select(  # of two, both were compared
        "key", "version", F.coalesce("root", "version").alias("root"))
    parts = write_table(placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")), "parts")
    open_keys = parts.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    sizes = shingles.select("version", F.length("shingles").alias("bytes"))
    members = write_table(placed.join(open_keys.select("key", "main"), "key").join(sizes, "version").select(
        "key", "version", "root", "bytes", (F.col("root") == F.col("main")).alias("in_main")), "members")
    total = lambda where: F.sum(F.when(where, F.col("bytes") + CELL_TEXT).otherwise(0))
    blocks = lambda size: F.ceil(size / F.lit(cell_bytes)).cast("int")
    plan = members.groupBy("key").agg(total(F.col("in_main")).alias("main"), total(~F.col("in_main")).alias("rest"))
    plan = plan.withColumn("small", F.col("main") + F.col("rest") <= cell_bytes).select(
        "key", F.when(F.col("small"), 1).otherwise(blocks(F.col("rest"))).alias("n_rest"),
        F.when(F.col("small"), 0).otherwise(blocks(F.col("main"))).alias("n_main"))
    dealt = members.join(plan, "key")
    own = F.when(F.col("in_main") & (F.col("n_main") > 0), F.col("n_rest") + F.pmod(F.xxhash64("version"), F.col("n_main"))).otherwise(
        F.pmod(F.xxhash64("version"), F.col("n_rest"))).cast("int")
    dealt = dealt.withColumn("own", own)
    met = F.sequence(F.lit(0), F.when(F.col("own") < F.col("n_rest"), F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest")) - 1)
    cells = dealt.select("version", "root", "key", "own", F.explode(met).alias("met")).select(
        "version", "root", F.struct("key", F.least("own", "met").alias("one"), F.greatest("own", "met").alias("other")).alias("cell"))
    return cells.join(shingles, "version").groupBy("cell").applyInArrow(_join_parts(similarity), "a string, b string")


def join_ids(rows: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join of wide ``rows`` with ``ids``, NULL equal to NULL: broadcast where their counted number allows."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = ids.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(named) if few else named, same, how)


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, cell_bytes: int = CELL_BYTES,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, head_id, head_version, head) for each row: its group of near copies, named by the document with the
    smallest id, and whether it is that one. ``version`` is the MD5 of the text.

    Texts are near copies if the sets of their ``width``-word shingles (a shorter text is one shingle), A to Z in lower case,
    have a Jaccard similarity of at least ``similarity``; groups follow links over others. Candidates are texts whose
    SimHash fingerprints link within RADIUS bits, as in ``near_duplicates``, and those that share a MinHash band of their shingles,
    where only the similarity counts, not the kind of edit. A candidate counts only after its shingles were compared: first with
    the most central text of each group or band, then between all texts of one that are in different parts yet.
    Equal texts are one group; NULL and empty texts are equal. NULL ids come last. Rows that repeat a doc_id and text stay or go
    together. Extra columns are left out; an empty table gives an empty table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.md5("text"))
    marked = write_table(rows.select("doc_id", "version", "text").mapInArrow(
        tidy(_keys_of(width, BANDS)), "doc_id long, version string, keys array<long>, n_words long, fp long"), "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")).alias("first")
    texts = marked.groupBy("version").agg(first, F.first("keys").alias("keys"), F.max("n_words").alias("n_words"), F.first("fp").alias("fp"))
    worded = texts.where("n_words > 0")
    # texts whose fingerprints link, directly or over others, share a bucket like those of one band
    linked = components(fingerprint_links(worded.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    grouped = worded.select("version", "fp").join(linked, "fp", "left").select("version", F.coalesce("root", "fp").alias("key"))
    tables = write_table(worded.select("version", F.explode("keys").alias("key")).union(grouped), "tables")
    buckets = tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = write_table(tables.join(buckets, "key"), "shared")
    # all are compared with the one that meets most others: the original of its copies, if there is one
    central = shared.groupBy("version").agg(F.sum("n").alias("met"))
    heads = shared.join(central, "version").groupBy("key").agg(F.max(F.struct("met", "version"))["version"].alias("head"))
    pairs = write_table(shared.join(heads, "key").where("version != head").select(
        F.least("version", "head").alias("a"), F.greatest("version", "head").alias("b")).distinct(), "pairs")
    asked = write_table(pairs.select(F.col("a").alias("version")).union(pairs.select("b")).distinct(), "asked")
    shingles = join_ids(rows.select("version", "text"), asked, ["version"], "left_semi").mapInArrow(tidy(_shingles_of(width)), "version string, shingles binary")
    shingles = write_table(shingles.dropDuplicates(["version"]), "shingles")
    both = (pairs.join(shingles.select(F.col("version").alias("a"), F.col("shingles").alias("one")), "a")
            .join(shingles.select(F.col("version").alias("b"), F.col("shingles").alias("other")), "b").select("a", "b", "one", "other"))
    roots = components(both.mapInArrow(tidy(_alike(similarity)), "a string, b string"), "a", "b")
    more = write_table(_part_links(shared, roots, shingles, similarity, cell_bytes), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
    placed = texts.join(roots, texts["version"] == roots["node"], "left").select("version", "first", F.coalesce("root", "version").alias("root"))
    names = placed.groupBy("root").agg(F.min(F.struct("first", "version")).alias("head"))
    named = placed.join(names, "root").select("version", F.col("head.first.doc_id").alias("head_id"), F.col("head.version").alias("head_version"))
    return marked.select("doc_id", "version").join(named, "version").select(
        "doc_id", "version", "head_id", "head_version", (F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("version") == F.col("head_version"))).alias("head"))
