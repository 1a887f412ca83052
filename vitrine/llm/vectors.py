"""Near-duplicate vectors over a flat proximity graph.

Equal vectors of a label are one node, with a weight. Nodes are dealt into overlapping shards: a label is one shard
while it fits a task; a larger one is clustered on a bounded sample, and each node goes to its OVERLAP nearest
clusters, until all shards fit. Each shard builds a graph: candidates are a node's nearest ones and some far ones,
and robust pruning keeps at most DEGREE neighbours: the NEAREST first, then none much closer to a kept one than to the node. The
adjacency lists of a node are united over its shards. Every node is then searched in its home shard from its medoid: a
greedy beam walk, then, once in range, on through all neighbours in range. It is also compared with the nodes at home in
each other shard of its label whose centre and radius allow a link, in blocks; a link is counted at the home of the
node found, so once. Found links are verified by
their cosine in double precision; links are counted and joined to parts where they are found, never sent as pairs.

``recall`` measures the links found against brute force."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.session import write_table

THRESHOLD = 0.98
SHARD_NODES = 8192
OVERLAP = 2
SAMPLE = 2048  # nodes of a shard that its clusters are fitted on, about
DEGREE, NEAREST, CANDIDATES, FAR, ALPHA, BEAM = 24, 12, 40, 8, 1.2, 16
SEED = 3


def nodes_of(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(label, vector, node, weight): the different vectors that may link; ``node`` is the smallest id."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite
              & F.exists(v, lambda x: x != 0))
    return (vectors.where(usable).groupBy(F.col(label_col).alias("label"), v.alias("vector"))
            .agg(F.min(F.col(id_col).cast("long")).alias("node"), F.count(F.lit(1)).alias("weight")))


def unit(column: pd.Series) -> np.ndarray:
    """Rows scaled to length 1, in double precision; by their largest component first, so that no square is lost."""
    x = np.array(column.tolist(), np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(1, keepdims=True))


APART = 0.75  # of a shard: the largest part that clusters may have, or else they don't divide it


def _centres(clusters_for: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = unit(rows.sort_values("node")["vector"])
        k = int(min(len(x), max(2, -(-rows["size"].iloc[0] * OVERLAP * 2 // clusters_for)), 256))
        centres = x[np.random.default_rng(SEED).choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.sqrt((sums ** 2).sum(1, keepdims=True))
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
        near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :OVERLAP]
        if np.bincount(near.ravel()).max() > APART * len(x):  # vectors that can't be told apart are dealt by their ids
            k = -int(-(-rows["size"].iloc[0] * 2 // clusters_for))
        return pd.DataFrame({"of": [key[0]], "centres": [centres.astype("<f8").tobytes()], "k": [k]})
    return run


def _deal(batches):
    for rows in batches:
        if not len(rows):
            continue
        out = []
        for _, part in rows.groupby("shard"):
            x = unit(part["vector"])
            k = int(part["k"].iloc[0])
            if k < 0:
                at = (part["node"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(-k)
                out.append(part.assign(shard=part["shard"] + "/" + pd.Series(at, part.index).astype(str)))
                continue
            centres = np.frombuffer(part["centres"].iloc[0], "<f8").reshape(k, -1)
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :OVERLAP]
            for nth in range(near.shape[1]):
                piece = part[["label", "vector", "node", "weight"]].copy()
                piece["shard"] = part["shard"] + "/" + pd.Series(near[:, nth], part.index).astype(str)
                piece["home"] = part["home"] & (nth == 0)
                out.append(piece)
        yield pd.concat(out)[["label", "vector", "node", "weight", "shard", "home"]]


def overlapping_shards(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``nodes`` with ``shard`` and ``home``: each node in one or more shards, at home in one of them."""
    shards = write_table(nodes.withColumn("shard", F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string")))
                         .withColumn("home", F.lit(True)), "shards")
    for _ in range(12):  # each round leaves no part of a large shard over APART of it
        sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard_nodes)
        sizes = sizes.select(F.col("shard").alias("of"), "size")
        if sizes.isEmpty():
            break
        sizes = write_table(sizes, "large")
        marked = shards.join(sizes, shards["shard"] == sizes["of"], "left")
        share = F.lit(float(SAMPLE)) / F.col("size")
        sample = marked.where(F.col("of").isNotNull() & (F.pmod(F.xxhash64("node", "shard"), F.lit(1 << 20)) < share * (1 << 20)))
        centres = sample.groupBy("of").applyInPandas(_centres(shard_nodes), "of string, centres binary, k int")
        split = (shards.join(centres, shards["shard"] == centres["of"]).drop("of")
                 .mapInPandas(_deal, f"label {dict(nodes.dtypes)['label']}, vector {dict(nodes.dtypes)['vector']}, node long, weight long, shard string, home boolean"))
        rest = marked.where(F.col("of").isNull()).select(*shards.columns)
        shards = write_table(rest.unionByName(split), "shards")
    return shards


def _prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Robust pruning of many nodes at once: (nodes, DEGREE) kept candidates, -1 where there are fewer. The NEAREST ones
    stay in any case: around a common centre all others would go, and the centre has room for few links back."""
    away = 2 - 2 * np.einsum("nd,ncd->nc", x[node], x[candidates])
    among = 2 - 2 * np.matmul(x[candidates], x[candidates].transpose(0, 2, 1))
    alive = candidates != node[:, None]
    kept = np.full((len(node), DEGREE), -1)
    every = np.arange(len(node))
    for d in range(DEGREE):
        pick = np.where(alive, away, np.inf).argmin(1)
        there = alive[every, pick]
        if not there.any():
            break
        kept[there, d] = candidates[there, pick[there]]
        if d >= NEAREST:
            alive &= ALPHA * among[every, pick] > away
        alive[every, pick] = False
    return kept


def build_graph(x: np.ndarray) -> np.ndarray:
    """(n, at most 2 * DEGREE) neighbours of each row of unit vectors, -1 where there are fewer."""
    n = len(x)
    near = min(CANDIDATES, n)
    rng = np.random.default_rng(SEED)
    out = np.full((n, DEGREE), -1)
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        sims = x[rows] @ x.T
        best = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        out[rows] = _prune(x, rows, np.concatenate([best, rng.integers(0, n, (len(rows), FAR))], 1))
    source, target = np.repeat(np.arange(n), DEGREE), out.ravel()
    source, target = source[target >= 0], target[target >= 0]
    # links work both ways, up to twice the degree
    pairs = np.unique(np.concatenate([np.column_stack([source, target]), np.column_stack([target, source])]), axis=0)
    nth = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    both = np.full((n, 2 * DEGREE), -1)
    fits = nth < 2 * DEGREE
    both[pairs[fits, 0], nth[fits]] = pairs[fits, 1]
    return both


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found), block by block: all rows found within ``threshold`` of the query rows, itself left out."""
    n = len(x)
    medoid = int((x @ x.sum(0)).argmax())
    for at in range(0, len(queries), 512):
        q = queries[at: at + 512]
        every = np.arange(len(q))
        seen, hit = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)

        def meet(who: np.ndarray, node: np.ndarray) -> np.ndarray:
            """Similarities of nodes met for the first time; -3 for the others. Those in range become hits."""
            new = (node >= 0) & ~seen[who, node]  # pairs that come twice in one call are scored twice
            sims = np.full(who.shape, -3.0)
            w, v = who[new], node[new]
            sims[new] = np.einsum("nd,nd->n", x[q[w]], x[v])
            seen[w, v] = True
            close = sims[new] >= threshold
            hit[w[close], v[close]] = True
            return sims

        beam = np.full((len(q), BEAM), -1)
        beam[:, 0], beam[:, 1] = medoid, q
        beam[q == medoid, 1] = -1
        sims = meet(np.broadcast_to(every[:, None], beam.shape), beam)
        done = sims < -2
        active = every
        while len(active):  # each takes a step from the best of its beam not yet left
            best = np.where(done[active], -4.0, sims[active]).argmax(1)
            there = ~done[active, best]
            active, best = active[there], best[there]
            done[active, best] = True
            reach = graph[beam[active, best]]
            got = meet(np.broadcast_to(active[:, None], reach.shape), reach)
            all_sims = np.concatenate([sims[active], got], 1)
            keep = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            beam[active] = np.take_along_axis(np.concatenate([beam[active], reach], 1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], got < -2], 1), keep, 1)
        left = np.zeros_like(hit)
        while True:  # then on from all that is in range
            who, node = np.nonzero(hit & ~left)
            if not len(who):
                break
            left[who, node] = True
            for part in range(0, len(who), 1 << 15):
                w, reach = who[part: part + (1 << 15)], graph[node[part: part + (1 << 15)]]
                meet(np.repeat(w, reach.shape[1]), reach.ravel())
        hit[every, q] = False
        who, node = np.nonzero(hit)
        yield q[who], node


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("node", ignore_index=True)
    graph = build_graph(unit(rows["vector"]))
    ids = rows["node"].to_numpy(np.int64)
    return pd.DataFrame({"node": ids, "near": [ids[g[g >= 0]] for g in graph]})


def _bound(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The centre of a shard's home nodes and the largest angle to it."""
    x = unit(rows["vector"])
    centre = x.sum(0)
    length = np.sqrt((centre ** 2).sum())
    centre = centre / length if length > 0 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({"shard": [key[0]], "centre": [centre.tolist()], "radius": [radius]})


def _reaches(threshold: float):
    """Nodes of one home and the bounds of other shards to (shard, node) where a link is possible."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(key: tuple, own: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(bounds):
            return pd.DataFrame({"shard": pd.Series([], dtype=str), "node": pd.Series([], dtype="int64")})
        centres, names = np.array(bounds["centre"].tolist(), np.float64), bounds["other"].to_numpy(object)
        near = np.arccos(np.clip(unit(own["vector"]) @ centres.T, -1, 1)) <= bounds["radius"].to_numpy() + reach
        who, where = np.nonzero(near)
        return pd.DataFrame({"shard": names[where], "node": own["node"].to_numpy()[who]})
    return run


def _compare(threshold: float):
    """Nodes from elsewhere against the nodes at home in a shard: exact."""
    def run(key: tuple, guests: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
        if not len(guests) or not len(homes):
            return pd.DataFrame({"node": [], "links": [], "part": []}).astype("int64")
        x, own = unit(homes["vector"]), homes["node"].to_numpy(np.int64)
        weight = homes["weight"].to_numpy(np.int64)
        ids, vectors = guests["node"].to_numpy(np.int64), guests["vector"]
        out = []
        for at in range(0, len(ids), 512):
            hit = unit(vectors.iloc[at: at + 512]) @ x.T >= threshold
            node = ids[at: at + 512]
            some = hit.any(1)
            out.append((node[some], hit[some] @ weight, own[hit[some].argmax(1)]))
            # each node found is joined to one that found it; those of one finder are joined by it
            found = np.flatnonzero(hit.any(0))
            out.append((own[found], np.zeros(len(found), np.int64), node[hit[:, found].argmax(0)]))
            for q in np.flatnonzero(some):  # and each finder to all it found: over the smallest of a chain
                v = np.flatnonzero(hit[q])
                if (hit[:, v].argmax(0) != q).any() and len(v) > 1:
                    firsts = np.unique(hit[:, v].argmax(0))
                    out.append((node[firsts], np.zeros(len(firsts), np.int64), np.full(len(firsts), node[q])))
        node, links, part = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pd.DataFrame({"node": node, "links": links, "part": part}).astype("int64").groupby(["node", "part"], as_index=False)["links"].sum()[["node", "links", "part"]]
    return run


def _search(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        x = unit(rows["vector"])
        ids = rows["node"].to_numpy(np.int64)
        size = rows["near"].map(len).to_numpy()
        near = np.concatenate([np.zeros(0, np.int64), *rows["near"]]).astype(np.int64)
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        at = np.where(ids[at] == near, at, -1)  # a neighbour's neighbour in a third shard
        graph = np.full((len(ids), max(1, int(size.max()))), -1)
        graph[np.repeat(np.arange(len(ids)), size), np.arange(len(near)) - np.repeat(np.cumsum(size) - size, size)] = at
        homes = np.flatnonzero(rows["home"].to_numpy())
        weight, at_home = rows["weight"].to_numpy(np.int64), rows["home"].to_numpy()
        links, part = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for q, v in range_search(x, graph, homes, threshold):
            links += np.bincount(q, weight[v] * at_home[v], len(ids)).astype(np.int64)
            while True:  # each part takes the smallest number among its links
                a, b = part[q], part[v]
                apart = a != b
                if not apart.any():
                    break
                np.minimum.at(part, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
                while (part[part] != part).any():
                    part = part[part]
        told = np.union1d(homes, np.flatnonzero(part != np.arange(len(ids))))
        return pd.DataFrame({"node": ids[told], "links": np.where(np.isin(told, homes), links[told], 0), "part": ids[part[told]]})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", label_col: str = "label",
                    vector_col: str = "embedding", shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of ``vectors``: links to rows of the same label with a cosine of at
    least ``threshold``, and the smallest id reachable over links.

    Rows whose id, label or vector is NULL, whose vector is zero or holds a NULL or non-finite component link with
    nothing and are their own component. Vectors of different lengths don't link. Repeated rows each count as a
    vector. Rows that give one id to different vectors of a label are one node, with the links of all. Extra columns
    are left out; an empty table gives an empty table."""
    nodes = write_table(nodes_of(vectors, id_col, label_col, vector_col), "nodes")
    shards = overlapping_shards(nodes, shard_nodes)
    near = shards.groupBy("shard").applyInPandas(_build, "node long, near array<long>")
    near = write_table(near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "near")
    members = shards.select("shard", "node", "vector", "weight", "home").join(near, "node")
    inside = members.groupBy("shard").applyInPandas(_search(threshold), "node long, links long, part long")
    # shards of labels that were cut
    cut = write_table(shards.where(F.col("home") & F.rlike("shard", F.lit("/[0-9]+$"))), "cut")
    bounds = write_table(cut.groupBy("shard").applyInPandas(_bound, "shard string, centre array<double>, radius double")
                         .withColumn("space", F.regexp_replace("shard", "(/[0-9]+)+$", "")), "bounds")
    others = bounds.select("space", F.col("shard").alias("other"), F.col("centre").alias("c"), F.col("radius").alias("r"))
    dot = F.aggregate(F.zip_with("centre", "c", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    pairs = bounds.join(others, "space").where(
        (F.col("shard") != F.col("other"))
        & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) <= F.col("radius") + F.col("r") + float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6))
    pairs = pairs.select("shard", "other", F.col("c").alias("centre"), F.col("r").alias("radius"))
    asked = cut.select("shard", "node", "vector").groupBy("shard").cogroup(pairs.groupBy("shard")).applyInPandas(
        _reaches(threshold), "shard string, node long")
    # queries of one shard are dealt into blocks, each with the shard's nodes
    asked = write_table(asked, "asked")
    blocks = write_table(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_NODES)).cast("int").alias("n")), "blocks")
    guests = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    guests = write_table(guests.join(cut.select("node", "vector"), "node").select("shard", "block", "node", "vector"), "guests")
    homes = cut.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("shard", "block", "node", "vector", "weight")
    across = guests.groupBy("shard", "block").cogroup(homes.groupBy("shard", "block")).applyInPandas(
        _compare(threshold), "node long, links long, part long")
    found = write_table(inside.unionByName(across), "found")
    roots = components(found.select("node", "part"), "node", "part")
    placed = (found.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")
              .join(nodes.select("node", "label", "vector", "weight"), "node")
              .select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.col("links") + F.col("weight") - 1).alias("_links"),
                      F.coalesce("root", "node").alias("_root")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.join(placed, (rows["label"] == placed["_label"]) & (rows["vector"] == placed["_vector"]) & rows["vec_id"].isNotNull(), "left")
    return rows.select("vec_id", F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("_root", "vec_id").alias("component_id"))


def recall(vectors: DataFrame, links: DataFrame, every: int, threshold: float = THRESHOLD, id_col: str = "vec_id",
           label_col: str = "label", vector_col: str = "embedding") -> float:
    """Links that ``links`` (vec_id, n_links) has over those that brute force finds, for ids divisible by ``every``."""
    v = nodes_of(vectors, id_col, label_col, vector_col)
    asked = v.where(F.col("node") % every == 0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    a, b = asked.alias("a"), v.alias("b")
    cosine = dot(F.col("a.vector"), F.col("b.vector")) / F.sqrt(dot(F.col("a.vector"), F.col("a.vector")) * dot(F.col("b.vector"), F.col("b.vector")))
    real = (a.join(b, (F.col("a.label") == F.col("b.label")) & (F.size("a.vector") == F.size("b.vector")) & (cosine >= threshold))
            .groupBy(F.col("a.node").alias("node")).agg((F.sum("b.weight") - 1).alias("real")))
    got = real.join(links, real["node"] == links["vec_id"]).agg(F.sum(F.least("real", "n_links")), F.sum("real")).first()
    return 1.0 if not got[1] else got[0] / got[1]
