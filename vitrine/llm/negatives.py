"""Hard negatives of anchors by a secondary sort of packed score keys.

Anchors meet all rows in blocks: a task scores one block of anchors against one block of rows. Of each block only what can
still be among the asked ranks goes on: the first positives by a first pass, and, once an anchor's positives are known, the first
negatives of each of their windows by a second. These are ranks of a union, so nothing is lost.

What goes on is packed into keys (anchor, descending score, positives before negatives, id), whose bytes sort in that order.
``repartitionAndSortWithinPartitions`` brings an anchor's keys together in order; an iterator over a partition opens a window at
each positive and lets the negatives of the open windows out as they pass, so of an anchor it holds the open windows only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import write_table

ANCHOR_BLOCK, ROW_BLOCK = 8192, 4096
TILE = 1 << 20  # scores at work at a time
NONE = np.iinfo(np.int64).min + 1
_EXACT = float(1 << 52)
KEY = ">QQQBQ"
_BIAS = 1 << 63
_FIELDS = np.dtype([("anchor", ">u8"), ("version", ">u8"), ("score", ">u8"), ("kind", "u1"), ("row", ">u8")])


def integer_rows(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector, dim) with floor(scale * x) of the rows that take part, identical ones once."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    out = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))
    return out.distinct().withColumn("dim", F.size("vector"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    if not len(column) or not dim:
        return np.zeros((len(column), dim), np.int64)
    return np.concatenate(column.to_numpy()).astype(np.int64).reshape(len(column), dim)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where those are exact."""
    reach = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, anchors.shape[1])
    if reach < _EXACT:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def _tiles(n: int, width: int) -> Iterator[slice]:
    step = max(1, TILE // max(1, width))
    return (slice(a, min(n, a + step)) for a in range(0, n, step))


def first_ranks(got: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` highest values, equal ones from left to right."""
    return np.argsort(-got, axis=1, kind="stable")[:, :k]


def _best_positives(k: int):
    """The first ``k`` rows of each anchor's label within a block."""
    def run(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.sort_values(["label", "vec_id"], ignore_index=True)
        own, vectors, labels = rows["vec_id"].to_numpy(), _matrix(rows["vector"], key[0]), rows["label"].to_numpy()
        for label, part in anchors.groupby("label"):
            a, b = np.searchsorted(labels, [label, label + 1])
            asked = _matrix(part["vector"], key[0])
            ids, versions = part["vec_id"].to_numpy(), part["version"].to_numpy()
            for tile in _tiles(len(part), b - a):
                got = scores(asked[tile], vectors[a:b])
                got[own[None, a:b] == ids[tile, None]] = NONE
                at = first_ranks(got, k)
                top = np.take_along_axis(got, at, 1)
                there = top != NONE
                many = there.sum(1)
                found.append(pd.DataFrame({"vec_id": np.repeat(ids[tile], many), "version": np.repeat(versions[tile], many),
                                           "positive_id": own[a:b][at][there], "score": top[there]}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("vec_id", "version", "positive_id", "score")})
    return run


def pack(anchor, version, score, kind: int, row) -> list[bytes]:
    """Keys whose bytes sort by anchor, falling score, kind and row."""
    out = np.zeros(len(row), _FIELDS)
    biased = lambda x: np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(_BIAS)
    out["anchor"], out["version"], out["row"] = biased(anchor), biased(version), biased(row)
    out["score"], out["kind"] = ~biased(score), kind
    data = out.tobytes()
    size = struct.calcsize(KEY)
    return [data[i: i + size] for i in range(0, len(data), size)]


def _keys(k: int, least: int, most: int):
    """Packed keys of the first ``k`` negatives in each window of a block's anchors; those of the positives come with block 0."""
    def run(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        keys: list[bytes] = []
        if key[2] == 0:
            for a, v, found in zip(anchors["vec_id"], anchors["version"], anchors["positives"]):
                keys += pack(np.full(len(found), a), np.full(len(found), v), [p["score"] for p in found], 0, [p["positive_id"] for p in found])
        if not len(rows):
            return pd.DataFrame({"key": keys})
        rows = rows.sort_values(["vec_id", "label"], ignore_index=True)
        own, vectors, labels = rows["vec_id"].to_numpy(), _matrix(rows["vector"], key[0]), rows["label"].to_numpy()
        ids, versions, of = (anchors[c].to_numpy() for c in ("vec_id", "version", "label"))
        asked = _matrix(anchors["vector"], key[0])
        points = [sorted({int(p["score"]) for p in found}) for found in anchors["positives"]]
        slots = max(map(len, points), default=0)
        low, high = np.ones((len(ids), slots), np.int64), np.zeros((len(ids), slots), np.int64)
        for i, own_points in enumerate(points):
            for j, p in enumerate(own_points):
                low[i, j], high[i, j] = -(-least * p // 100), most * p // 100
        for tile in _tiles(len(ids), len(own)):
            got = scores(asked[tile], vectors)
            got[(labels[None, :] == of[tile, None]) | (own[None, :] == ids[tile, None])] = NONE
            order = np.argsort(-got, axis=1, kind="stable")
            got = np.take_along_axis(got, order, 1)
            picked = np.zeros(got.shape, bool)
            for j in range(slots):
                at = (got > high[tile, j, None]).sum(1)[:, None] + np.arange(k)
                inside = at < len(own)
                value = np.take_along_axis(got, np.minimum(at, len(own) - 1), 1)
                inside &= (value >= low[tile, j, None]) & (value <= high[tile, j, None]) & (value != NONE)
                picked[np.nonzero(inside)[0], at[inside]] = True
            anchor, place = np.nonzero(picked)
            keys += pack(ids[tile][anchor], versions[tile][anchor], got[anchor, place], 1, own[order[anchor, place]])
        return pd.DataFrame({"key": keys})
    return run


def windows(positives: int, negatives: int, least: int, most: int):
    """Rows (anchor, positive, rank, negative, both scores) of an iterator over sorted (key, None)."""
    def run(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        now, opened = None, []
        for key, _ in keys:
            anchor, version, falling, kind, row = struct.unpack(KEY, key)
            if now != (anchor, version):
                now, opened = (anchor, version), []
            score = (_BIAS - 1) - falling
            if kind == 0:
                if len(opened) < positives:
                    opened.append([row - _BIAS, score, 0])
                continue
            for window in opened:
                if window[2] < negatives and least * window[1] <= 100 * score <= most * window[1]:
                    window[2] += 1
                    yield anchor - _BIAS, window[0], window[2], row - _BIAS, window[1], score
    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
                   scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of ``anchors`` and each of its
    first ``positives`` rows of the same label, the first ``negatives`` rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score; all, if fewer. Scores are inner products of the
    vectors floor(scale * x); higher ones come first, equal ones by smaller id. A positive with a score below 0 has no negatives.

    Rows with a NULL id, label or vector, or a NULL or non-finite component, take no part. Identical rows count once; rows that
    share an id but differ in vector or label are rows of their own, and none of them is another row to an anchor of that id.
    Vectors of different lengths don't meet. Scores have 64 bits and wrap beyond. Extra columns are left out; an empty table gives an empty table."""
    spark = rows.sparkSession
    own = write_table(integer_rows(rows, scale, id_col, vector_col, label_col), "rows")
    blocks = own.count() // row_block + 1
    own = own.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    asked = write_table(integer_rows(anchors, scale, id_col, vector_col, label_col).withColumn("version", F.xxhash64("vector", "label")), "anchors")
    parts = asked.count() // anchor_block + 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "version", F.lit(7)), F.lit(parts)).cast("int"))

    def meet(left: DataFrame, run, schema: str) -> DataFrame:
        # the query set against all rows: a task has one block of either
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("dim", "part", "block")
        right = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("dim", "part", "block")
        return left.cogroup(right).applyInPandas(run, schema)

    near = meet(asked, _best_positives(positives), "vec_id long, version long, positive_id long, score long")
    place = Window.partitionBy("vec_id", "version").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= positives)
    near = near.groupBy("vec_id", "version").agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))  # at most `positives`
    opened = write_table(asked.join(near, ["vec_id", "version"]), "opened")
    keys = write_table(meet(opened, _keys(negatives, least, most), "key binary"), "keys")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.rdd.map(lambda r: (bytes(r["key"]), None)).repartitionAndSortWithinPartitions(
        partitions, lambda key: zlib.crc32(key[:16]))
    mined = ordered.mapPartitions(windows(positives, negatives, least, most))
    return spark.createDataFrame(mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
                                 verifySchema=False)
