"""Exact top k by inner product: ball-tree branch and bound.

Candidates are dealt into shards of about SHARD_ROWS; a task builds each shard's ball tree and packs it into one
row. Query blocks meet groups of shards: (query block, shard group) is one task's work, bounded on both sides. It
goes through its shards one after another and keeps each query's best k so far; a node is left out where
q . centre + |q| radius, the most that any of its vectors can reach, is below the query's current kth score. A
first round over one shard gives every query a kth score to start from, which the second round shares.

Scores are integers, so nothing is lost to rounding; bounds are widened by a margin far above theirs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import write_table

SHARD_ROWS, LEAF = 8192, 64
QUERY_BLOCK, SHARD_GROUP = 512, 4
NONE = np.iinfo(np.int64).min + 1  # its negative is a number too
_EXACT = float(1 << 52)


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows; and for each node, parents first: (from, to, left child or -1), centre, radius. The right
    child follows the left one. Rows are halved along the line between two far ends until LEAF are left."""
    order = np.arange(len(vectors))
    spans, centres, radii = [[0, len(vectors), -1]], [], []
    at = 0
    while at < len(spans):
        a, b, _ = spans[at]
        rows = vectors[order[a:b]]
        centre = rows.mean(0) if b > a else np.zeros(vectors.shape[1])
        away = ((rows - centre) ** 2).sum(1)
        centres.append(centre)
        radii.append(np.sqrt(away.max()) if b > a else 0.0)
        if b - a > LEAF:
            one = rows[away.argmax()]
            other = rows[((rows - one) ** 2).sum(1).argmax()]
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (other - one), middle)]
            spans[at][2] = len(spans)
            spans += [[a, a + middle, -1], [a + middle, b, -1]]
        at += 1
    return order, np.array(spans), np.array(centres), np.array(radii)


class Best:
    """The best k of each query of a block so far: scores descending, equal ones by id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.queries, self.ids, self.k, self.floor = queries, ids, k, floor.copy()
        self.real = queries.astype(np.float64)
        self.norm = np.sqrt((self.real ** 2).sum(1))
        self.score = np.full((len(ids), k), NONE)
        self.of = np.full((len(ids), k), np.iinfo(np.int64).max)

    def visit(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, exact: bool) -> None:
        """Score ``rows`` of the queries against all ``vectors``."""
        got = (self.real[rows] @ vectors.T).astype(np.int64) if exact else self.queries[rows] @ vectors.astype(np.int64).T
        got = np.where(ids[None, :] == self.ids[rows, None], NONE, got)
        score = np.concatenate([self.score[rows], got], 1)
        of = np.concatenate([self.of[rows], np.broadcast_to(ids, got.shape)], 1)
        order = np.lexsort((of, -score), axis=1)[:, : self.k] if score.size else np.zeros((len(rows), self.k), int)
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.of[rows] = np.take_along_axis(of, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def search_tree(best: Best, ids: np.ndarray, vectors: np.ndarray, spans: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> None:
    """Branch and bound of all queries of ``best`` together, level by level."""
    reach = np.abs(best.real).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1])
    exact = reach < _EXACT
    slack = 1e-9 * (best.norm * (np.sqrt((centres ** 2).sum(1)).max() + radii.max())) + 1e-6

    def bound(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (best.real[q] * centres[node]).sum(1) + best.norm[q] * radii[node] + slack[q]

    def leaves(q: np.ndarray, node: np.ndarray) -> None:
        order = np.argsort(node, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(part):
                a, b, _ = spans[node[part[0]]]
                best.visit(q[part], vectors[a:b], ids[a:b], exact)

    # straight down to the most promising leaf, for a first kth score
    q = np.arange(len(best.ids))
    node = np.zeros(len(q), int)
    while True:
        left = spans[node, 2]
        inner = left >= 0
        if not inner.any():
            break
        pick = left[inner] + (bound(q[inner], left[inner] + 1) > bound(q[inner], left[inner]))
        node[inner] = pick
    leaves(q, node)
    done = set(zip(q.tolist(), node.tolist()))
    # all nodes that may still hold better ones
    node, ends = np.zeros(len(q), int), []
    while len(q):
        high = bound(q, node)
        keep = high >= best.floor[q]
        q, node, high = q[keep], node[keep], high[keep]
        left = spans[node, 2]
        leaf = left < 0
        ends.append((q[leaf], node[leaf], high[leaf]))
        q, left = q[~leaf], left[~leaf]
        q, node = np.repeat(q, 2), np.column_stack([left, left + 1]).ravel()
    q, node, high = (np.concatenate([e[i] for e in ends]) for i in range(3)) if ends else (np.zeros(0, int),) * 3
    fresh = np.array([(a, b) not in done for a, b in zip(q.tolist(), node.tolist())], bool)
    q, node, high = q[fresh], node[fresh], high[fresh]
    order = np.lexsort((-high, q))
    q, node, high = q[order], node[order], high[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q) if len(q) else q
    at = 0
    while at <= nth.max(initial=-1):  # each query's leaves from the highest bound on, several at a time
        upto = at + max(1, at)
        now = (nth >= at) & (nth < upto) & (high >= best.floor[q])
        leaves(q[now], node[now])
        at = upto


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of the rows whose id and components are there and finite."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def _pack_trees(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable", ignore_index=True)
    dim = int(key[1])
    vectors = _matrix(rows["vector"], dim)
    order, spans, centres, radii = build_tree(vectors.astype(np.float64))
    packed = [rows["vec_id"].to_numpy(np.int64)[order], vectors[order], spans, centres, radii]
    return pd.DataFrame({"shard": [key[0]], "dim": [dim], "parts": [[np.ascontiguousarray(p).tobytes() for p in packed]]})


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(shards):
            return found
        dim = int(queries["dim"].iloc[0])
        queries = queries.sort_values("vec_id", ignore_index=True)
        ids = queries["vec_id"].to_numpy(np.int64)
        best = Best(_matrix(queries["vector"], dim), ids, k, queries["floor"].to_numpy(np.int64))
        for parts in shards.sort_values("shard")["parts"]:
            own = np.frombuffer(parts[0], np.int64)
            radii = np.frombuffer(parts[4], np.float64)
            search_tree(best, own, np.frombuffer(parts[1], np.int64).reshape(-1, dim).astype(np.float64)
                        if dim else np.zeros((len(own), 0)), np.frombuffer(parts[2], np.int64).reshape(-1, 3),
                        np.frombuffer(parts[3], np.float64).reshape(len(radii), dim), radii)
        there = best.score.ravel() != NONE
        return pd.DataFrame({"query_id": np.repeat(ids, k)[there], "vec_id": best.of.ravel()[there], "score": best.score.ravel()[there]})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the ``k`` of ``vectors`` with the highest inner product of
    the vectors floor(scale * x), equal ones by smaller id; all if fewer.

    Rows with a NULL id, a NULL vector or a NULL or non-finite component take no part. A candidate with the query's
    own id is left out; other repeated rows each count. Of a repeated query id the smallest vector asks. Vectors of
    different lengths don't meet. Components beyond 64 bits, and scores beyond them, are not supported. Extra columns
    are left out; an empty table gives an empty table."""
    rows = write_table(integer_vectors(vectors, scale, id_col, vector_col).withColumn("dim", F.size("vector")), "vectors")
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(1000).collect()}
    shards = F.lit(1).cast("long")
    for dim, n in counts.items():  # lengths beyond a thousand different ones have one shard each
        shards = F.when(F.col("dim") == dim, F.lit(n // shard_rows + 1)).otherwise(shards)
    trees = write_table(
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards)).groupBy("shard", "dim")
        .applyInPandas(_pack_trees, "shard long, dim int, parts array<binary>")
        .withColumn("part", F.floor(F.col("shard") / F.lit(SHARD_GROUP))), "trees")
    asked = (integer_vectors(queries, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
             .withColumn("dim", F.size("vector")))
    n_asked = asked.count()
    asked = write_table(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_asked // query_block + 1))), "queries")

    def search(with_floor: DataFrame, over: DataFrame) -> DataFrame:
        # query blocks against all shards: every pair of a block and a group of shards is one task's work
        parts = over.select("dim", "part").distinct()
        left = with_floor.join(parts, "dim").groupBy("block", "dim", "part")
        right = over.join(with_floor.select("block", "dim").distinct(), "dim").select(
            F.col("block").alias("to_block"), F.col("dim").alias("to_dim"), F.col("part").alias("to_part"), "shard", "parts")
        right = right.groupBy("to_block", "to_dim", "to_part")
        return left.cogroup(right).applyInPandas(_search(k), "query_id long, vec_id long, score long")

    first = write_table(search(asked.withColumn("floor", F.lit(int(NONE))), trees.where("shard = 0")), "first")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    started = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select(
        *asked.columns, F.coalesce("kth", F.lit(int(NONE))).alias("floor"))
    found = first.union(search(started, trees.where("shard > 0")))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
