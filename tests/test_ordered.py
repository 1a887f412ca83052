"""The block-wise scan and the skew-safe joins give what the plain ones give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import ordered, skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(k, i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]))
            for k, n in ((1, 400), (2, 90), (3, 5), (4, 1)) for i in rng.sample(range(1000), n)]
    return spark.createDataFrame(data, "k INT, t INT, v INT, s STRING")




def steps():
    return {
        "rn": ordered.row_number(),
        "total": ordered.running_sum(F.col("v")),
        "peak": ordered.max_before(F.col("v")),
        "seen": ordered.last_before(F.col("s")),
        "back": ordered.lag(F.col("s")),
        "ahead": ordered.lead(F.struct("t", "s")),
    }


def test_blocked_equals_plain(rows):
    plain = ordered.scan(rows, ["k"], ["t"], steps())
    blocked = ordered.scan(rows, ["k"], ["t"], steps(), hot_rows=20)
    assert sorted(map(str, plain.collect())) == sorted(map(str, blocked.collect()))


def test_plain_equals_window(rows):
    w = Window.partitionBy("k").orderBy("t")
    want = rows.select("k", "t", F.row_number().over(w).alias("rn"), F.lag("s").over(w).alias("back"),
                       F.lead("t").over(w).alias("next"))
    got = ordered.scan(rows, ["k"], ["t"], steps()).select("k", "t", "rn", "back", F.col("ahead.t").alias("next"))
    assert sorted(map(tuple, want.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_blocks_are_many_for_a_hot_key(rows, spark):
    hot = rows.where("k = 1")
    blocks = hot.repartitionByRange(8, "k", "t").withColumn("b", F.spark_partition_id())
    assert blocks.groupBy("b").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join(spark, how):
    facts = spark.createDataFrame([(i, None if i % 11 == 0 else (7 if i % 3 else i % 40)) for i in range(500)], "id INT, k INT")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40, 2)] + [(7, "hot")], "k INT, v STRING")
    want = facts.join(lookup, "k", how).select("id", "k", "v")
    heavy = skew.heavy_keys(facts.where("k is not null"), ["k"], 1)
    for given in (None, heavy):
        got = skew.lookup_join(facts, lookup, ["k"], spread="id", how=how, heavy=given).select("id", "k", "v")
        assert sorted(map(tuple, want.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_registry_join_beyond_its_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "REGISTRY_ROWS", 3)
    facts = spark.createDataFrame([(i, i % 9) for i in range(90)], "id INT, k INT")
    registry = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k INT, v STRING")
    got = skew.registry_join(facts, registry, ["k"], spread="id", how="inner")
    assert got.count() == 50


@pytest.mark.parametrize("name", ["interval_rebuild", "chain_derive", "interval_overlap", "owner_asof"])
def test_queries_with_every_asset_hot(spark, name):
    from tests.check_queries import compare, connect
    from vitrine.plans.registry import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.001"
    spark.conf.set(ordered.HOT_ROWS_CONF, "25")
    try:
        verdict = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    finally:
        spark.conf.unset(ordered.HOT_ROWS_CONF)
    assert verdict.startswith("ok"), verdict
