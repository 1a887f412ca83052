"""Hard negatives against brute force, whole and in small blocks."""

import math
import random
import struct

from vitrine.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, version long, block int, part int, positives string"


def mined(data, every, positives=5, negatives_=10, least=30, most=90):
    rows = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in data
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        own = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in rows if j != i and len(w) == len(v))
        for p, j, _ in [r for r in own if r[2]][:positives]:
            fit = [r for r in own if not r[2] and least * -p <= 100 * -r[0] <= most * -p]
            out += [(i, j, n + 1, r[1], -p, -r[0]) for n, r in enumerate(fit[:negatives_])]
    return sorted(out)


def data():
    rnd = random.Random(3)
    out = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], 0 if rnd.random() < 0.35 else rnd.randrange(1, 5)) for i in range(260)]  # many ties
    out += [(-10, [1.0, 0.5, 0.0, 0.0], 2), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [math.nan] * 4, 1), (303, [math.inf] + [0.0] * 3, 1),
            (304, [1.0] * 4, None), (None, [1.0] * 4, 1), (310, [0.0] * 4, 1), (311, [0.0] * 4, 2), (312, [0.0] * 4, 1), (320, [1.0, 1.0], 1),
            (321, [0.5, 0.5], 1), (322, [0.5, 0.25], 3), (330, [], 1), (331, [], 1), (340, [1.0] * 4, 3), (340, [1.0] * 4, 3), (350, [1.0] * 4, 1), (350, [0.5] * 4, 2)]
    return out + [(400, [0.5] * 4, 4)] * 150  # a third of the rows is one row


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, "p") for r in rows], SCHEMA).repartition(4)


def test_hard_negatives(spark):
    rows = data()
    df = frame(spark, rows)
    want = mined(rows, 10)
    assert len(want) > 300
    for anchors, block in ((8192, 4096), (7, 23)):
        got = negatives.hard_negatives(df, df.where("vec_id % 10 = 0"), anchor_block=anchors, row_block=block)
        assert sorted(tuple(r) for r in got.collect()) == want
    few = negatives.hard_negatives(df, df.where("vec_id % 10 = 0"), positives=1, negatives=2, least=0, most=100, row_block=50)
    assert sorted(tuple(r) for r in few.collect()) == mined(rows, 10, 1, 2, 0, 100)


def test_empty(spark):
    none = frame(spark, [])
    assert negatives.hard_negatives(none, none).count() == 0
    df = frame(spark, [(1, [1.0], 1), (10, [1.0], 1)])
    assert negatives.hard_negatives(df, df.where("vec_id = 10")).count() == 0  # no negatives
    assert negatives.hard_negatives(df, none).count() == 0


def test_keys_sort_in_order_and_windows_stream():
    keys = (negatives.pack([5, 5], [1, 1], [-3, 9], 1, [2, 4]) + negatives.pack([5, -7], [1, 1], [9, 1 << 60], 0, [8, 9])
            + negatives.pack([5], [1], [4], 1, [1 << 40]))
    order = [struct.unpack(negatives.KEY, k) for k in sorted(keys)]
    assert [(a - (1 << 63), (1 << 63) - 1 - s, kind) for a, _, s, kind, _ in order] == [
        (-7, 1 << 60, 0), (5, 9, 0), (5, 9, 1), (5, 4, 1), (5, -3, 1)]
    seen = []

    def watched():
        for k in sorted(keys):
            seen.append(k)
            yield k, None

    rows = negatives.windows(5, 10, 30, 90)(watched())
    assert next(rows) == (5, 8, 1, 1 << 40, 9, 4)
    assert len(seen) == 4  # let out before the rest was read


def test_large_components(spark):
    rows = [(0, [1e6, 3.0], 1), (1, [1e6, 2.0], 1), (2, [5e5, 1.0], 2), (3, [6e5, 1.0], 2)]
    df = frame(spark, rows)
    got = negatives.hard_negatives(df, df.where("vec_id = 0"))
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 100)
