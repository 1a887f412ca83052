"""Passages repeated across documents: seeds from winnowed anchors, extended to whole windows.

Every window of WINDOW words has one anchor: of its word GRAM-grams, the one with the smallest
hash (the last of equals). Equal windows have equal anchors, so a passage of WINDOW words can
only repeat where an anchor does. Documents are joined on their anchors; an anchor that occurs in
one document only is dropped. At the others the match is extended both ways: the windows around
the anchor meet the windows of the same anchor in documents with smaller ids, and consecutive
windows found there merge into maximal repeats, each at least WINDOW words long.

Nothing is compared in pairs. Rows of one anchor are sorted by document and streamed, so memory
follows the different windows around one anchor, not the number of copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.text import Slice, grams, mix, slices, tidy

WINDOW = 13
GRAM = 5
_CHUNK = 100_000  # rows of anchors held at once
_GRAM_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _anchors(s: Slice, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: row, first window, number of windows, anchor word
    (word indices within the slice)."""
    grams_in = window - GRAM + 1
    n = len(s.starts) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    low = np.uint64(grams_in - 1)
    room = np.uint64(15)
    g = grams(s.hashes(0), GRAM, _GRAM_BASE) & ~room
    best = g[:n] | low
    for o in range(1, grams_in):
        np.minimum(best, g[o: o + n] | (low - np.uint64(o)), out=best)
    anchor = np.arange(n) + (grams_in - 1) - (best & room).astype(np.int64)
    row = np.repeat(np.arange(len(s.counts)), s.counts)
    whole = row[:n] == row[window - 1:]
    at = np.flatnonzero(whole)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    new = np.flatnonzero(np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (row[at][1:] != row[at][:-1])]))
    first = at[new]
    return row[first], first, np.diff(np.append(new, len(at))), anchor[first]


def _distinct(row: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Indices, ascending, of the first of each (row, hashes)."""
    key = row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for h in hashes:
        key = mix(key ^ h) * np.uint64(_WINDOW_BASE)
    return np.sort(np.unique(key, return_index=True)[1])


def _seeds(window: int):
    """(doc_id, text) to one row per document and anchor: anchor hash, document, the anchor's first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for s in slices(b.column(1)):
                row, _, _, anchor = _anchors(s, window)
                if not len(row):
                    continue
                h = grams(s.hashes(0), GRAM, _GRAM_BASE)[anchor]
                once = _distinct(row, h)
                row, h, anchor = row[once], h[once], anchor[once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[s.first + row]),
                     pa.array((anchor - s.bounds[row]).astype(np.int32))], ["h", "doc_id", "at"])
    return run


def _extend(window: int):
    """(doc_id, text, version, seeds) to the windows around each seed: anchor hash, document, its version, first
    window, and the windows' hashes. A document tells the same windows around the same anchor once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(3).is_valid())
            ids, versions = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            seed_bounds = b.column(3).offsets.to_numpy()
            seeds = b.column(3).values.to_numpy(zero_copy_only=False)
            for s in slices(b.column(1)):
                row, first, count, anchor = _anchors(s, window)
                if not len(row):
                    continue
                bounds = s.bounds
                g = grams(s.hashes(0), GRAM, _GRAM_BASE)
                rows = np.arange(s.first, s.first + len(s.counts))
                begin, end = seed_bounds[rows], seed_bounds[rows + 1]
                inside = seeds[begin[0]: end[-1]] < np.repeat(s.counts - GRAM + 1, end - begin)
                of = np.repeat(np.arange(len(rows)), end - begin)[inside]
                wanted = g[seeds[begin[0]: end[-1]][inside] + bounds[of]]
                use = np.isin(mix(g[anchor] ^ mix(row.astype(np.uint64))), mix(wanted ^ mix(of.astype(np.uint64))))
                row, first, count, h = row[use], first[use], count[use], g[anchor[use]]
                if not len(row):
                    continue
                w = grams(s.hashes(1), window, _WINDOW_BASE)

                def picked() -> tuple[np.ndarray, np.ndarray]:
                    ends = np.cumsum(count)
                    within = np.arange(ends[-1]) - np.repeat(ends - count, count)
                    return w[np.repeat(first, count) + within], within

                windows, within = picked()
                block = np.add.reduceat(mix(windows + within.astype(np.uint64)), np.cumsum(count) - count)
                once = _distinct(row, h, block)
                row, first, count, h = row[once], first[once], count[once], h[once]
                windows, _ = picked()
                offsets = np.concatenate([[0], np.cumsum(count) * 8]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(windows)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[s.first + row]), pa.array(versions[s.first + row]),
                     pa.array((first - bounds[row]).astype(np.int32)), packed],
                    ["h", "doc_id", "version", "first", "windows"])
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _extend sorted by (h, doc_id) to the windows that a smaller doc_id has too:
    document, version, first window, and a mask of those found."""
    seen, seen_h = np.zeros(0, np.uint64), None  # windows of the anchor at hand, from smaller documents

    def resolve(t: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch | None]:
        nonlocal seen, seen_h
        h, doc = (t.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cut = len(h)
        if not last:  # rows of the last document may go on
            cut = int(np.flatnonzero((h == h[-1]) & (doc == doc[-1]))[0])
            if cut == 0:
                return None, t
        h, doc = h[:cut], doc[:cut]
        packed = t.column(4).slice(0, cut)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset: packed.offset + cut + 1] // 8
        w = np.frombuffer(packed.buffers()[2], np.uint64)[offsets[0]: offsets[-1]]
        count = np.diff(offsets)
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        of = np.repeat(np.arange(cut), count)
        order = np.lexsort((of, w, group[of]))  # rows are in order of doc_id
        ws, gs, ds = w[order], group[of][order], doc[of][order]
        start = np.concatenate([[True], (ws[1:] != ws[:-1]) | (gs[1:] != gs[:-1])])
        lowest = ds[np.flatnonzero(start)][np.cumsum(start) - 1]
        repeated = ds > lowest
        if seen_h is not None and h[0] == seen_h:
            repeated |= (gs == 0) & np.isin(ws, seen)
        else:
            seen = np.zeros(0, np.uint64)
        tail = np.unique(ws[gs == group[-1]])
        seen = np.union1d(seen, tail) if group[-1] == 0 else tail
        seen_h = h[-1]
        hit = np.zeros(len(w), bool)
        hit[order] = repeated
        bit = np.arange(len(w)) - np.repeat(offsets[:-1] - offsets[0], count)
        mask = np.bincount(of, np.where(hit, 1 << bit, 0), cut).astype(np.int64)
        keep = np.flatnonzero(mask)
        out = pa.RecordBatch.from_arrays(
            [t.column(1).slice(0, cut).take(keep), t.column(2).slice(0, cut).take(keep),
             t.column(3).slice(0, cut).take(keep), pa.array(mask[keep].astype(np.int32))],
            ["doc_id", "version", "first", "mask"])
        return out, t.slice(cut) if cut < t.num_rows else None

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= _CHUNK:
            out, rest = resolve(pa.concat_batches(held), False)
            held = [] if rest is None else [rest]
            if out is not None:
                yield out
    if held and sum(x.num_rows for x in held):
        yield resolve(pa.concat_batches(held), True)[0]


def _cut(window: int, layout: bool):
    """(doc_id, text, version, removals) to (doc_id, version, n_words, spans, kept)."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                        ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, kept = [], [], []
            for s in slices(b.column(1)):
                bounds = s.bounds
                data = s.data.tobytes()
                w = grams(s.hashes(1), window, _WINDOW_BASE)
                for r in range(len(s.counts)):
                    i = s.first + r
                    n = int(s.counts[r])
                    n_words.append(n)
                    text = data[s.offsets[r]: s.offsets[r + 1]]
                    covered = None
                    if b.column(3)[i].is_valid:
                        found = b.column(3)[i].values
                        own = found.field(0).to_numpy(zero_copy_only=False) == b.column(2)[i].as_py()
                        first = found.field(1).to_numpy(zero_copy_only=False)[own].astype(np.int64)
                        mask = found.field(2).to_numpy(zero_copy_only=False)[own]
                        told = np.concatenate([first[(mask >> bit & 1).astype(bool)] + bit for bit in range(window - GRAM + 1)])
                        if len(told):  # and wherever the document has the same windows again
                            own_windows = w[bounds[r]: bounds[r] + n - window + 1]
                            steps = np.zeros(n + 1, np.int64)
                            at = np.flatnonzero(np.isin(own_windows, own_windows[told]))
                            steps[at] += 1
                            steps[at + window] -= 1
                            covered = np.cumsum(steps[:n]) > 0
                    if covered is None or not covered.any():
                        spans.append([])
                        kept.append(text.decode() if layout else b" ".join(text.split()).decode())
                        continue
                    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(begins, ends)])
                    lo = bounds[r]
                    pieces = []
                    for x, y in zip(np.append(0, ends), np.append(begins, n)):
                        if x < y:
                            piece = data[s.starts[lo + x]: s.ends[lo + y - 1]]
                            pieces.append(piece if layout else b" ".join(piece.split()))
                    kept.append((b"\n" if layout else b" ").join(pieces).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n_words, pa.int64()), pa.array(spans, schema.field(3).type), pa.array(kept, pa.string())],
                schema=schema)
    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, version, first, mask): the windows of ``docs`` (doc_id, text, version) that also start in
    a document with a smaller doc_id. Bit i of ``mask`` stands for the window at word ``first`` + i."""
    seeds = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(
        tidy(_seeds(window)), "h long, doc_id long, at int")
    by_anchor = Window.partitionBy("h")
    shared = (seeds.select("doc_id", "at", (F.min("doc_id").over(by_anchor) < F.max("doc_id").over(by_anchor)).alias("both"))
              .where("both").groupBy("doc_id").agg(F.collect_list("at").alias("seeds")))
    # a left join, as in remove_repeats: one exchange of the texts serves both
    around = docs.join(shared, "doc_id", "left").select("doc_id", "text", "version", "seeds").mapInArrow(
        tidy(_extend(window)), "h long, doc_id long, version long, first int, windows binary")
    return around.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(
        tidy(_repeats), "doc_id long, version long, first int, mask int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, layout: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_words, spans, kept) for each row: the words covered by a window whose word sequence also
    starts in a document with a smaller doc_id are taken out. ``spans`` are the maximal runs of such words;
    ``kept`` the other words joined by one space, or as they stood with ``layout``; ``version`` the XXH64 of the text.

    ``window`` is at least GRAM and at most GRAM + 15. A NULL text has no words. A row with a NULL doc_id
    keeps all its words and takes none from others. Rows that repeat a doc_id are one document: they take
    nothing from one another. Extra columns are left out; an empty table gives an empty table."""
    if not GRAM <= window <= GRAM + 15:
        raise ValueError("window out of range")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    found = repeated_windows(rows, window).groupBy("doc_id").agg(
        F.collect_list(F.struct("version", "first", "mask")).alias("removals"))
    return rows.join(found, "doc_id", "left").select("doc_id", "text", "version", "removals").mapInArrow(
        tidy(_cut(window, layout)), "doc_id long, version long, n_words long, spans array<struct<start:int,length:int>>, kept string")
