"""The snapshot job over a versioned store: new assets, documents that were not fetched, second runs, limited runs."""

import hashlib
import json

from vitrine.functions.scalar import BASE58
from vitrine.operators import snapshots
from vitrine.session import committed_tables, latest_done


def address(n):
    """32 bytes as base58."""
    number, out = int.from_bytes(hashlib.sha256(f"a{n}".encode()).digest(), "big"), ""
    while number:
        number, digit = divmod(number, 58)
        out = BASE58[digit] + out
    return out


def snapshot(n, name="snap", owner=1, attributes=()):
    return json.dumps({"id": address(n), "burnt": False, "ownership": {"owner": address(1000 + owner)}, "content": {
        "json_uri": f"https://m/{n}", "files": [], "links": {}, "metadata": {"name": f"{name} {n}", "symbol": "S", "attributes": [
            {"trait_type": t, "value": v} for t, v in attributes]}}})


def document(n, name="doc", attributes=()):
    return address(n), f"https://m/{n}", json.dumps({"name": f"{name} {n}", "attributes": [{"trait_type": t, "value": v} for t, v in attributes]})


class Store:
    def __init__(self, spark, folder):
        self.spark, self.path = spark, f"{folder}/store"

    def run(self, snaps, documents, homes, slot, as_of="2024-01-01 00:00:00", **more):
        s = self.spark
        return snapshots.run_snapshot_job(
            s, self.path, s.createDataFrame([(b,) for b in snaps], "body string"), s.createDataFrame(documents, "address string, source_uri string, body string"),
            s.createDataFrame([(address(n), c) for n, c in homes], "address string, collection_id int"), slot, as_of, **more)

    def table(self, name):
        return committed_tables(self.spark, self.path, snapshots.STORE)[name]

    def rows(self, name, *columns):
        return sorted(map(tuple, self.table(name).select(*columns).collect()), key=str)


def test_snapshot_job_twice(spark, tmp_path):
    store = Store(spark, tmp_path)
    snaps = [snapshot(n, attributes=[("Kind", "plain")]) for n in range(6)]
    documents = [document(n, attributes=[("Doc", str(n))]) for n in (0, 1, 2)] + [(address(3), "https://m/3", "{broken")]
    homes = [(n, 1 if n < 4 else 2) for n in range(7)]  # 6 has no snapshot
    job = store.run(snaps, documents, homes, 10)
    order = sorted(range(6), key=address)
    assert store.rows("assets", "id", "address") == sorted([(order.index(n) + 1, address(n)) for n in range(6)], key=str)
    ids = {n: order.index(n) + 1 for n in range(6)}
    # attributes of inserted assets are there: the document's, else the snapshot's
    assert store.rows("attributes", "asset_id", "trait_type", "value") == sorted(
        [(ids[n], "Doc", str(n)) if n < 3 else (ids[n], "Kind", "plain") for n in range(6)], key=str)
    assert store.rows("documents", "asset_id") == sorted([(ids[n],) for n in (0, 1, 2)], key=str)
    runs = store.rows("runs", "collection_id", "kind", "status", "members", "inserted", "updated", "unchanged", "attributes_written", "documents", "missing")
    assert runs == [(1, "assets", "done", 4, 4, 0, 0, 4, 3, 0), (2, "assets", "done", 3, 2, 0, 0, 2, 0, 1)]
    before = {t: store.rows(t, *[c.split()[0] for c in snapshots.STORE[t].split(", ")]) for t in ("assets", "attributes", "documents")}
    # again, and nothing was fetched this time: names and attributes of the documents stay
    job = store.run(snaps, [], homes, 11, "2024-01-02 00:00:00", deep=True)
    for t in before:
        assert {r.action for r in job[t].collect()} <= {"unchanged", "kept"}
        assert store.rows(t, *[c.split()[0] for c in snapshots.STORE[t].split(", ")]) == before[t]
    assert sorted(map(tuple, snapshots.deep_reconcile(job).collect())) == [(1, 0), (2, 0)]
    assert store.rows("runs", "collection_id", "kind", "inserted", "unchanged", "slot") == [
        (1, "assets", 0, 4, 11), (1, "deep", 0, 4, 11), (2, "assets", 0, 2, 11), (2, "deep", 0, 2, 11)]


def test_changes_and_new_assets(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.run([snapshot(n, attributes=[("Kind", "plain")]) for n in range(3)], [document(0, attributes=[("Doc", "a")])], [(n, 1) for n in range(3)], 10)
    ids = dict(store.rows("assets", "address", "id"))
    snaps = [snapshot(0, owner=2), snapshot(1, name="renamed", attributes=[("Kind", "rare")]), snapshot(2), snapshot(7), snapshot(8, attributes=[("Kind", "new")])]
    documents = [document(0, attributes=[("Doc", "b")]), document(8, attributes=[])]
    job = store.run(snaps, documents, [(0, 1), (1, 1), (2, 9), (7, 1), (8, 2)], 20, "2024-02-01 00:00:00", limited=True)
    actions = {r.address: (r.id, r.action) for r in job["assets"].collect()}
    assert [actions[address(n)][1] for n in (0, 1, 2)] == ["updated", "updated", "skipped_foreign"]
    fresh = sorted([7, 8], key=address)
    assert [actions[address(n)] for n in fresh] == [(4, "inserted"), (5, "inserted")]  # after the stored ones
    owners = dict(store.rows("assets", "address", "owner"))
    assert owners[address(0)] == address(1002) and owners[address(2)] == address(1001)
    found = store.rows("attributes", "asset_id", "trait_type", "value")
    assert found == sorted([(ids[address(0)], "Doc", "b"), (ids[address(1)], "Kind", "rare"), (ids[address(2)], "Kind", "plain")], key=str)
    status = {(r.collection_id, r.kind): (r.status, r.finished_at) for r in store.table("runs").collect()}
    assert {s for s in status.values()} == {("running", None)}
    corrections = dict(map(tuple, snapshots.deep_reconcile(job).collect()))
    # 1: two updates, one insert, (Doc b for a) and (rare for plain), one document; 2: an asset and its document
    assert {c: n for c, n in corrections.items() if n} == {1: 3 + 4 + 1, 2: 2}


def test_a_version_that_was_not_committed(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.run([snapshot(0)], [], [(0, 1)], 10)
    spark.createDataFrame([(99, "x")], "id BIGINT, address STRING").write.parquet(f"{store.path}/assets/n=2")
    assert store.rows("assets", "id") == [(1,)] and latest_done(spark, f"{store.path}/commits") == 1
    store.run([snapshot(0), snapshot(1)], [], [(0, 1), (1, 1)], 11)
    assert store.rows("assets", "id") == [(1,), (2,)]


def test_empty(spark, tmp_path):
    store = Store(spark, tmp_path)
    job = store.run([], [], [], 1)
    assert all(job[t].count() == 0 for t in ("assets", "attributes", "documents", "runs"))
