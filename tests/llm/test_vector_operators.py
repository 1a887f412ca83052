"""Vector operators and components against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from vitrine.llm import topk, vectors
from vitrine.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, score long, node long, dim int, shard string"


def rows():
    rnd = np.random.default_rng(6)
    out = []
    for i in range(240):
        out.append((i, rnd.normal(0, 1, 8).astype("f4").tolist(), i % 3))
    for i in range(240, 300):  # near copies of a few
        out.append((i, (np.array(out[i % 7][1]) * rnd.uniform(0.5, 3) + rnd.normal(0, 0.03, 8)).astype("f4").tolist(), out[i % 7][2]))
    out += [(300 + i, out[5][1], out[5][2]) for i in range(40)]  # equal vectors
    out += [(340, None, 1), (341, [0.0] * 8, 1), (342, [1.0, None] + [0.0] * 6, 1), (343, [math.nan] * 8, 1), (344, [math.inf] + [0.0] * 7, 1),
            (345, out[5][1], None), (None, out[5][1], out[5][2]), (346, [1.0, 2.0], 1), (347, [1.0, 2.0], 1), (348, [], 1), (349, [-1.0, -2.0], 1), (350, out[5][1], out[5][2])]
    out.append(out[-1])  # a repeated row
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "s") for r in data], SCHEMA).repartition(4)


def usable(r):
    return r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])


def test_top_k(spark):
    data = [r for r in rows()]
    ints = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in data if usable(r)]
    want = []
    for q, v in sorted({(i, tuple(v)) for i, v in ints if i % 10 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    df = frame(spark, data)
    for shard_rows, block in ((8192, 512), (40, 7)):
        got = topk.top_k(df, df.where("vec_id % 10 = 0"), shard_rows=shard_rows, query_block=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert topk.top_k(frame(spark, []), frame(spark, [])).count() == 0


def test_ball_tree_prunes():
    """Clustered data: far fewer leaves are visited than there are, with the same answer; large components stay exact."""
    rnd = np.random.default_rng(0)
    data = (rnd.normal(0, 300, (40, 6))[rnd.integers(0, 40, 4000)] + rnd.normal(0, 5, (4000, 6))).astype(np.int64)
    for scale in (1, 10 ** 6):  # scores beyond 2 ** 53
        own = data * scale
        order, spans, centres, radii = topk.build_tree(own.astype(float))
        queries, ids = own[:50], np.arange(50)
        best = topk.Best(queries, ids, 5, np.full(50, topk.NONE))
        visited = []
        visit = best.visit
        best.visit = lambda r, v, i, e: (visited.append(len(r)), visit(r, v, i, e))
        topk.search_tree(best, order, own[order].astype(float), spans, centres, radii)
        scores = queries @ own.T
        for q in range(50):
            want = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
            assert [(-int(s), int(i)) for s, i in zip(best.score[q], best.of[q])] == want
        assert sum(visited) < 0.5 * 50 * (spans[:, 2] < 0).sum()


def near_want(data, threshold=0.98):
    links = []
    for i, a in enumerate(data):
        for j in range(i):
            b = data[j]
            if usable(a) and usable(b) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and any(a[1]) and any(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((i, j))
    part = brute.components(len(data), links)
    names, count = {}, [0] * len(data)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    for r, p in zip(data, part):
        if r[0] is not None:
            names[p] = min(r[0], names.get(p, r[0]))
    return sorted(((r[0], count[i], names.get(part[i])) for i, r in enumerate(data)), key=str)


def test_near_duplicates(spark):
    data = rows()
    df = frame(spark, data)
    for shard_nodes in (8192, 40):
        found = vectors.near_duplicates(df, shard_nodes=shard_nodes).cache()
        got = sorted((tuple(r) for r in found.collect()), key=str)
        want = near_want(data)
        if shard_nodes > len(data):
            assert got == want
        assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
        assert vectors.recall(df, found, 1) >= 0.9
    assert vectors.near_duplicates(frame(spark, [])).count() == 0


def test_group_larger_than_a_shard(spark):
    """A linked group several times the size of a shard: links between its shards count too."""
    rnd = np.random.default_rng(8)
    centre = rnd.normal(0, 1, 8)
    x = np.concatenate([centre + rnd.normal(0, 0.06, (500, 8)), rnd.normal(0, 1, (100, 8))])
    data = [(i, v.astype("f4").tolist(), 1) for i, v in enumerate(x)]
    df = frame(spark, data)
    found = vectors.near_duplicates(df, shard_nodes=60).cache()
    got, want = sorted((tuple(r) for r in found.collect()), key=str), near_want(data)
    assert vectors.recall(df, found, 1) >= 0.99 and all(g[1] <= w[1] for g, w in zip(got, want))
    assert [g[2] for g in got] == [w[2] for w in want]


def test_vectors_of_one_direction(spark):
    """They can't be told apart by clusters: dealt by id instead, each node still in few shards, and no link is lost."""
    rnd = np.random.default_rng(2)
    base = rnd.normal(0, 1, 6)
    data = [(i, (base * (1 + i / 64)).astype("f4").tolist(), 1) for i in range(130)] + [(200 + i, rnd.normal(0, 1, 6).astype("f4").tolist(), 1) for i in range(20)]
    df = frame(spark, data)
    nodes = vectors.nodes_of(df, "vec_id", "label", "embedding")
    sizes = [r["n"] for r in vectors.overlapping_shards(nodes, 60).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 60 and sum(sizes) <= 4 * len(data)
    assert sorted(map(tuple, vectors.near_duplicates(df, shard_nodes=60).collect()), key=str) == near_want(data)


def test_graph_reaches_dense_groups():
    """Hundreds of copies around one centre, which has not room for links to them all."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(0, 1, (1500, 16))
    x[:700] = x[0] + rnd.normal(0, 0.05, (700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    found = np.zeros_like(near)
    for q, v in vectors.range_search(x, vectors.build_graph(x), np.arange(len(x)), 0.98):
        found[q, v] = True
    assert not (found & ~near).any() and found.sum() >= 0.98 * near.sum()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(400, i) for i in range(401, 480)] + [(i, i + 1) for i in range(500, 540)] + [(600, 600)]
    want = brute.components(700, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert [got.get(i, i) for i in range(700)] == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
