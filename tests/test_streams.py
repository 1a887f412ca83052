"""Live ownership against a plain fold, and restarts of the streams."""

import json
import random
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from vitrine.operators.intervals import interval_rebuild
from vitrine.streaming import deliveries, live, ownership

ROW = "asset_id BIGINT, arrival BIGINT, id BIGINT, slot BIGINT, kind STRING, from_owner STRING, to_owner STRING"


def random_events(rng, asset, n):
    out, owner = [], None
    for i in range(n):
        slot = 10 * i + (rng.choice([0, 0, 0, -35]) if i else 0)
        kind = rng.choices(["transfer", "sale", "burn", "list"], [6, 2, 0.6, 0.6])[0] if i else "mint"
        to = None if kind == "burn" else rng.choice("abcd")
        sender = rng.choices([owner, None, "z"], [8, 1, 0.7])[0] if i else None
        out.append((asset, i, asset * 1000 + i, slot, kind, sender, to))
        owner = to if kind != "list" else owner
    return out


def fold(rows, frontier=()):
    """The rule restated, event by event: what is open, since when, is it burned; and the asset row."""
    out = {}
    states = {f[0]: [f[1:3] if f[1] is not None else None, f[3], f[4], f[5]] for f in frontier}
    for asset, _, id_, slot, kind, sender, to in rows:
        state = states.setdefault(asset, [None, False, None, None])
        open_, burned, owner, owner_slot = state
        if kind == "list":
            out[id_] = (False, False, False, False)
        elif (open_ and slot < open_[1]) or (burned and kind != "burn") or (open_ and sender and sender != open_[0]):
            out[id_] = (False, False, True, False)
        else:
            moved = not burned if kind == "burn" else bool(to) and (owner_slot is None or slot > owner_slot) and owner != to
            out[id_] = (to is not None, open_ is not None, False, moved)
            state[0] = (to, slot) if to else None
            state[1] = burned or kind == "burn"
            if moved:
                state[2:] = [None, None] if kind == "burn" else [to, slot]
    return out, {a: (s[1], s[2], s[3]) for a, s in states.items()}


def random_frontier(rng, assets):
    out = []
    for a in assets:
        burned = rng.random() < 0.1
        opened = not burned and rng.random() < 0.5
        row = not burned and rng.random() < 0.6
        out.append((a, rng.choice("abcd") if opened else None, rng.randint(0, 40) if opened else None, burned,
                    rng.choice("abcd") if row else None, rng.choice([None, rng.randint(0, 90)]) if row else None))
    return out


@pytest.mark.parametrize("block_rows", [200_000, 40, 7])
def test_record_events_equals_the_fold(spark, block_rows):
    """Also with one asset over many blocks, some of them passed without an event taken."""
    rng = random.Random(3)
    groups = [random_events(rng, a, rng.randint(1, 25)) for a in range(1, 40)]
    groups.append(random_events(rng, 40, 300))
    stuck = random_events(rng, 41, 120)
    stuck[20] = (*stuck[20][:3], 10_000, "transfer", None, "a")  # later slots than all that follow
    stuck[90] = (*stuck[90][:3], 10_001, "transfer", "a", "b")
    rows = [r for g in [*groups, stuck] for r in g]
    frontier = random_frontier(rng, range(1, 40, 2))
    want, after = fold(rows, frontier)
    df = spark.createDataFrame(rows, ROW)
    applied = ownership.record_events(df, spark.createDataFrame(frontier, ownership.FRONTIER), block_rows)
    found = applied.collect()
    assert {r.id: (r.opened, r.closed, r.dirty, r.owner_moved) for r in found} == want and len(found) == len(rows)
    assert all((r.owner is not None) == r.opened for r in found)
    assert any(v[2] for v in want.values()) and any(v[0] for v in want.values()) and any(v[3] for v in want.values())
    if block_rows == 7:
        assets = spark.createDataFrame([(f[0], f[3], f[4], f[5], "x") for f in frontier], "id BIGINT, burned BOOLEAN, owner STRING, owner_slot BIGINT, kind STRING")
        got = ownership.asset_rows_after(assets, applied)
        assert {r.id: (r.burned, r.owner, r.owner_slot) for r in got.collect()} == {f[0]: after[f[0]] for f in frontier}
        assert ownership.record_events(df.limit(0), spark.createDataFrame([], ownership.FRONTIER)).count() == 0


def test_record_events_computes_its_events_once(spark):
    """And leaves large ids as they are."""
    rng = random.Random(7)
    rows = [r for a in range(1, 12) for r in random_events(rng, a, 9)]
    at = ROW.split(", ").index("id BIGINT")
    rows = [(*r[:at], (1 << 59) + r[at], *r[at + 1:]) for r in rows]
    computed = spark.sparkContext.accumulator(0)

    def seen(asset):
        computed.add(1)
        return asset

    df = spark.createDataFrame(rows, ROW).withColumn("asset_id", F.udf(seen, "long")("asset_id"))
    applied = ownership.record_events(df, spark.createDataFrame(random_frontier(rng, range(1, 12, 2)), ownership.FRONTIER), 40)
    assert {r.id for r in applied.collect()} == {r[at] for r in rows}
    assert computed.value == len(rows)


def test_clean_assets_agree_with_the_rebuild(spark):
    rng = random.Random(5)
    rows = [r for a in range(1, 30) for r in random_events(rng, a, 12)]
    df = spark.createDataFrame(rows, ROW)
    nothing = spark.createDataFrame([], ownership.FRONTIER)
    applied = ownership.record_events(df, nothing)
    dirty = ownership.dirty_assets(applied)
    cols = ["asset_id", "owner", "from_slot", "to_slot", "opened_by", "closed_by"]
    live = ownership.live_intervals(applied).join(dirty, "asset_id", "left_anti").select(*cols)
    stored = df.withColumn("seq", F.lit(0)).withColumn("block_time", F.lit(None).cast("timestamp"))
    rebuilt = interval_rebuild(stored).join(dirty, "asset_id", "left_anti").select(*cols)
    assert sorted(live.collect(), key=str) == sorted(rebuilt.collect(), key=str) and live.count() > 0


def body(*elements):
    return json.dumps([{"transaction": {"signatures": [s]}, "slot": n, "meta": {"err": None}} for s, n in elements])


def put(folder, text):
    folder.mkdir(exist_ok=True)
    (folder / f"{uuid.uuid4().hex}.txt").write_text(text + "\n")


def test_inbox_restart(spark, tmp_path):
    incoming, inbox, state = tmp_path / "in", tmp_path / "inbox", tmp_path / "state"
    put(incoming, body(("s10", 10), ("s11", 11)))
    deliveries.start_inbox(spark, str(incoming), str(inbox), str(state)).awaitTermination()
    # redelivered, late and new ones, an unusable element, and a body that is no JSON
    put(incoming, body(("s11", 11), ("s12", 12), ("s3", 3)) + "\n[{\"slot\": 4}]\nnot json")
    deliveries.start_inbox(spark, str(incoming), str(inbox), str(state)).awaitTermination()
    got = sorted(r.signature for r in deliveries.read_inbox(spark, str(inbox)).collect())
    assert got == ["s10", "s11", "s12", "s3"]
    deliveries.start_inbox(spark, str(incoming), str(inbox), str(state)).awaitTermination()
    assert deliveries.read_inbox(spark, str(inbox)).count() == 4
    bad = sorted((r.reason, r.body) for r in deliveries.read_quarantine(spark, str(inbox)).collect())
    assert bad == [("no signature", '{"slot":4}'), ("not json", "not json")]
    counts = sorted((r.batch, r.landed, r.usable, r.quarantined) for r in deliveries.read_counts(spark, str(inbox)).collect())
    assert counts == [(0, 2, 2, 0), (1, 5, 3, 2)]


def test_landing_after_a_crash_between_its_sinks(spark, tmp_path):
    incoming, inbox, state = tmp_path / "in", tmp_path / "inbox", tmp_path / "state"
    put(incoming, body(("s10", 10)) + "\n{\"transaction\": {\"signatures\": [\"s1\"]}}\n[]")
    deliveries.start_landing(spark, str(incoming), str(inbox), str(state / "landing")).awaitTermination()
    files = lambda: sorted(f.name for f in (inbox / "landed").rglob("*.parquet"))
    before = files()
    for lost in ("quarantine", "counts"):
        shutil.rmtree(inbox / lost)
    for f in (state / "landing" / "commits").glob("*0*"):
        f.unlink()
    deliveries.start_inbox(spark, str(incoming), str(inbox), str(state)).awaitTermination()
    assert files() == before and [r.signature for r in deliveries.read_inbox(spark, str(inbox)).collect()] == ["s10"]
    assert [r.reason for r in deliveries.read_quarantine(spark, str(inbox)).collect()] == ["no slot"]
    assert [(r.landed, r.usable, r.quarantined) for r in deliveries.read_counts(spark, str(inbox)).collect()] == [(2, 1, 1)]


def live_events(rows):
    """(id, asset, signature, slot, kind, sender, receiver) as rows of the stream; the collection is the asset's last digit."""
    return [(i, a, a % 10, s, 0, slot, None, kind, sender, to) for i, a, s, slot, kind, sender, to in rows]


class Live:
    def __init__(self, spark, folder):
        self.spark, self.out, self.folder = spark, f"{folder}/out", folder

    def registry(self, enabled):
        self.spark.createDataFrame([(c, c in enabled) for c in range(10)], "id INT, enabled BOOLEAN").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/registry")

    def send(self, rows, frontier=None):
        self.spark.createDataFrame(live_events(rows), live.EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.run(frontier)

    def run(self, frontier=None):
        live.start_admission(self.spark, f"{self.folder}/in", f"{self.folder}/registry", self.out, f"{self.folder}/c1").awaitTermination()
        live.start_ownership(self.spark, self.out, f"{self.folder}/c2", frontier).awaitTermination()

    def flags(self):
        return {r.id: (r.opened, r.closed, r.dirty, r.owner_moved) for r in live.read_applied(self.spark, self.out).collect()}

    def history(self):
        cols = ["asset_id", "owner", "from_slot", "to_slot", "opened_by", "closed_by"]
        return sorted(map(tuple, live.read_history(self.spark, self.out).select(*cols).collect()), key=str)


def test_live_ownership(spark, tmp_path):
    stream = Live(spark, tmp_path)
    stream.registry({1, 2, 3})
    frontier = spark.createDataFrame([(3, "h", 50, False, "h", 60), (13, None, None, True, None, None)], ownership.FRONTIER)
    stream.send([(1, 1, "s1", 100, "mint", None, "a"), (2, 2, "s2", 100, "mint", None, "x"), (6, 3, "s6", 70, "sale", "h", "i"),
                 (7, 13, "s7", 80, "transfer", "h", "i"), (8, 4, "s8", 90, "mint", None, "z")], frontier)
    assert stream.flags() == {1: (True, False, False, True), 2: (True, False, False, True), 6: (True, True, False, True), 7: (False, False, True, False)}
    stream.registry({1, 2, 3, 4})  # enabled between two batches
    stream.send([(3, 1, "s3", 200, "transfer", "a", "b"), (1, 1, "s1", 100, "mint", None, "a"), (9, 4, "s9", 95, "mint", None, "z")])
    # late for asset 1; wrong sender for asset 2; a listing
    stream.send([(4, 1, "s4", 150, "transfer", "a", "c"), (5, 2, "s5", 300, "sale", "q", "y"), (10, 4, "s10", 99, "list", "z", None)])
    got = stream.flags()
    assert {i: got[i] for i in (3, 4, 5, 9, 10)} == {3: (True, True, False, True), 4: (False, False, True, False), 5: (False, False, True, False),
                                                   9: (True, False, False, True), 10: (False, False, False, False)}
    assert 8 not in got and spark.read.parquet(f"{stream.out}/held").count() == 1
    rows = live.read_applied(spark, stream.out).orderBy("asset_id", "arrival").collect()
    assert [r.arrival for r in rows if r.asset_id == 1] == [0, 1, 2] and {r.source for r in rows} == {"stream"}

    def by_rebuild():
        cols = ["asset_id", "owner", "from_slot", "to_slot", "opened_by", "closed_by"]
        return sorted(map(tuple, interval_rebuild(live.read_applied(spark, stream.out)).select(*cols).collect()), key=str)

    assert sorted(r.asset_id for r in live.dirty_assets(spark, stream.out).collect()) == [1, 2, 13]
    assert live.rebuild_history(spark, stream.out) == 1
    assert stream.history() == by_rebuild() and live.dirty_assets(spark, stream.out).count() == 0
    # asset 1 went a, c, b by slot; it stands with b since 200, and asset 2 with y since 300: events that continue these are applied
    stream.send([(11, 1, "s11", 400, "sale", "b", "d"), (12, 2, "s12", 400, "sale", "y", "w"), (14, 2, "s14", 200, "sale", "y", "w")])
    got = stream.flags()
    assert (got[11], got[12], got[14]) == ((True, True, False, True), (True, True, False, True), (False, False, True, False))
    before = live.manifest(spark, stream.out)[2]
    assert live.rebuild_history(spark, stream.out) == 2 and stream.history() == by_rebuild()
    now = live.manifest(spark, stream.out)[2]
    bucket_of = {r.asset_id: r.b for r in live.read_applied(spark, stream.out).select("asset_id", live.bucket().alias("b")).distinct().collect()}
    assert {b for b in now if now[b] != before.get(b)} == {bucket_of[1], bucket_of[2]}  # the other buckets keep their files
    assert live.rebuild_history(spark, stream.out) == 2  # nothing new
    stream.run()


def test_a_pass_that_broke_off(spark, tmp_path):
    """A version without a manifest doesn't count, nor does it hinder the next try; standings that were not sent are sent then."""
    stream = Live(spark, tmp_path)
    stream.registry({1})
    stream.send([(1, 1, "s1", 100, "mint", None, "a"), (2, 11, "t1", 100, "mint", None, "p")])
    live.rebuild_history(spark, stream.out)
    good = stream.history()
    stream.send([(3, 1, "s2", 50, "transfer", None, "b")])
    spark.createDataFrame([(1, "junk", 1, None, None, None, 1, None, 0)], f"{live.HISTORY}, bucket INT").write.partitionBy("bucket").parquet(f"{stream.out}/history/n=2")
    assert stream.history() == good
    shutil.rmtree(f"{stream.out}/admitted/version=1", ignore_errors=True)
    assert live.rebuild_history(spark, stream.out) == 2
    assert {r[1] for r in stream.history()} == {"a", "b", "p"} and live.is_done(spark, f"{stream.out}/admitted/version=1")


def test_a_batch_run_again_sees_the_registry_it_saw(spark, tmp_path):
    stream = Live(spark, tmp_path)
    stream.registry({1})
    stream.send([(1, 1, "s1", 100, "mint", None, "a"), (2, 2, "s2", 100, "mint", None, "b")])
    first = stream.flags()
    stream.registry({1, 2})
    for state in ("c1", "c2"):  # as if the driver was lost before it committed the batch
        for f in [*(tmp_path / state / "commits").glob("*0*")]:
            f.unlink()
    stream.run()
    assert stream.flags() == first == {1: (True, False, False, True)}


def test_the_state_gives_what_the_batch_operator_gives(spark):
    rng = random.Random(8)
    rows = [r for a in range(1, 40) for r in random_events(rng, a, 20)]
    frontier = random_frontier(rng, range(1, 40, 2))
    want, after = fold(rows, frontier)
    states = {f[0]: (0, f[1], f[2], f[3], f[4], f[5]) for f in frontier}
    for asset, _, id_, slot, kind, sender, to in rows:
        states[asset], done = live.after(states.get(asset, (0, None, None, False, None, None)), {"kind": kind, "slot": slot, "from_owner": sender, "to_owner": to})
        assert (*done[1:4], done[5]) == want[id_]
    assert {a: s[3:] for a, s in states.items()} == after
