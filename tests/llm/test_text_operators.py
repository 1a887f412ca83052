"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vitrine.llm import licenses, license_rules, mixing, packing, quality, simhash, substring, toxicity
from vitrine.llm.queries import fold, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, version string, h long, stats string, label int"


GPL = "GNU General Public License version 2"


def texts():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve,", "don't", "A.", "漢字"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    passage = prose(30)
    long = prose(30_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, base), (7, base), (8, " ".join(near)), (9, base.upper()),
        (10, prose(20) + " " + passage + " " + prose(9)), (11, passage + "\n" + prose(15)), (12, prose(5) + " " + passage),
        (13, " ".join(["same word"] * 40)), (14, "x " + " ".join(["same word"] * 30)), (15, long), (16, long[:5000]), (6, base), (6, prose(40)),
        (None, base), (None, passage), (17, "Released under the MIT License. GPL-3.0 and cc by nc cc by nc 4.0"), (18, "cc by nc, CC-BY-NC; Apache License, Version 2.0"),
        (19, "Licensed under the GNU General Public License, version 3."), (20, "é" * 200), (21, passage),
    ]


def frame(spark, rows):
    """The documents' columns and others whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}" if d != 20 else None, 0, 9.0, "v", 1, "s", 1) for d, t in rows], COLUMNS).repartition(3)


def test_simhash(spark):
    rows = texts()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    found = sorted(((r.doc_id, f"{r.fp & (2 ** 64 - 1):016x}", r.component_id) for r in got), key=str)
    assert found == brute.simhash(rows)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_large_buckets(spark, monkeypatch):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        fps.add(f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    centre = rnd.getrandbits(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)}  # a dense group
    fps = sorted(fps)
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in fps]
    want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.fingerprint_links(df).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert len(links) < 20 * len(fps)
    assert brute.components(len(fps), [(at[r.u], at[r.v]) for r in links]) == want
    key, fp = np.array([5] * len(fps), np.uint64), np.array(fps, np.uint64)
    plain = simhash._spanning(fp, np.ones(len(fp), bool), fp & np.uint64(0xFFFFFFFF))
    monkeypatch.setattr(simhash, "PLAIN_RUN", 1)
    low = np.array([f & 0xFFFFFFFF for f in fps], np.uint64)  # as in a bucket: the other half is the same
    split = simhash._spanning(low, np.ones(len(fp), bool), low)
    monkeypatch.setattr(simhash, "PLAIN_RUN", 4096)
    whole = simhash._spanning(low, np.ones(len(fp), bool), low)
    to = {}
    for i, f in enumerate(low.tolist()):
        to.setdefault(f, i)
    parts = lambda found: brute.components(len(fps), [(to[int(a)], to[int(b)]) for a, b in found])
    assert plain and parts(split) == parts(whole) and len(key)


def test_near_copies(spark):
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(rnd.choice(words) for _ in range(200))), (3, None), (4, ""), (5, "a b"), (6, "A  b"), (7, " ".join(base))]
    for i in range(8, 20):
        copy = list(base)
        copy[rnd.randrange(200)] = "new"
        rows.append((i, " ".join(copy)))
    rows += [(20, " ".join(base[:100] + [rnd.choice(words) for _ in range(100)])), (None, " ".join(base))]
    got = {r.doc_id: (r.head_id, r.head) for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert {d for d, (_, head) in got.items() if head} == {1, 2, 3, 5, 20}
    assert all(got[i] == (1, False) for i in [7, *range(8, 20), None]) and got[4] == (3, False) and got[6] == (5, False)
    assert simhash.near_copies(frame(spark, [])).count() == 0


def test_near_copies_of_any_edit(spark):
    """Pairs a little above the limit are found, whatever the kind of edit."""
    rnd = random.Random(11)
    words = [f"v{i}" for i in range(5000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    for edit in ("scattered", "appended", "inserted", "block"):
        rows = []
        for i in range(60):
            base = some(250)
            copy, at = list(base), rnd.randrange(220)
            if edit == "scattered":
                for j in rnd.sample(range(250), 5):
                    copy[j] = "new"
            elif edit == "appended":
                copy += some(55)
            elif edit == "inserted":
                copy[at:at] = some(45)
            else:
                copy[at: at + 20] = some(20)
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        got = simhash.near_copies(frame(spark, rows)).where("not head").collect()
        assert all(r.doc_id == r.head_id + 1 for r in got) and len(got) >= 58, edit


def test_near_copies_around_one_original(spark):
    """Copies alike to the original but not to one another are one group, also where one print or bucket is cut up; so are
    chains, and groups around two originals stay two."""
    rnd = random.Random(12)
    words = [f"v{i}" for i in range(5000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    base, far = some(300), some(300)
    rows = []
    for b in (base, far):
        for i in range(150):
            copy = list(b)
            for j in rnd.sample(range(10, 290), 5):
                copy[j] = f"new{rnd.random()}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, " ".join(base)), (1001, " ".join(far))]
    sets = [simhash_shingles(t) for _, t in rows[:150]]
    among = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(x < 0.8 for x in among) > 0.9 * len(among) and all(len(s & simhash_shingles(rows[-2][1])) >= 0.8 * len(s | simhash_shingles(rows[-2][1])) for s in sets)
    chain = [some(200)]
    for _ in range(30):
        chain.append([*chain[-1][15:], *some(15)])
    rows += [(2000 + i, " ".join(c)) for i, c in enumerate(chain)]
    want = {d: 0 if d < 150 or d == 1000 else 150 if d < 1002 else 2000 for d, _ in rows}
    for cell_bytes in (simhash.CELL_BYTES, 20_000):
        got = {r.doc_id: r.head_id for r in simhash.near_copies(frame(spark, rows), cell_bytes=cell_bytes).collect()}
        assert {d for d in want if got[d] != want[d]} == set()


def test_near_copies_by_linked_fingerprints(spark, monkeypatch):
    """Without any band, texts whose fingerprints link are still compared, and only those alike are joined."""
    monkeypatch.setattr(simhash, "BANDS", 0)
    rnd = random.Random(13)
    base = [rnd.choice([f"v{i}" for i in range(5000)]) for _ in range(4000)]
    rows = [(i, " ".join(base + [f"new{i}"] * (i > 1))) for i in range(1, 6)]
    rows += [(6, "x y z"), (7, "x y z x y z x y z x y z x y z x y z x y z"), (8, "x y z")]
    prints = [simhash.fingerprint(t, 3) for _, t in rows]
    assert all((prints[0] ^ p).bit_count() <= 3 for p in prints[:5])
    got = {r.doc_id: r.head_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 6: 6, 7: 7, 8: 6}


def test_join_parts_compares_every_pair():
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    for _ in range(30):
        n = 40
        centres = [rnd.integers(0, 1 << 30, 60) for _ in range(4)]
        sets = []
        for i in range(n):
            own = centres[rnd.integers(0, 4)].copy()
            own[rnd.choice(60, rnd.integers(1, 9), replace=False)] = rnd.integers(0, 1 << 30)
            sets.append(np.unique(own.astype(np.uint32)))
        root = [f"{int(x):02d}" for x in rnd.integers(0, 30, n)]
        alike = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        given = [(i, root.index(root[i])) for i in range(n)]
        links = simhash._join_parts(0.8)(pa.table({"version": [str(i) for i in range(n)], "root": root, "shingles": [s.tobytes() for s in sets]}))
        links = [(int(a), int(b)) for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist())]
        assert all((a, b) in alike or (b, a) in alike for a, b in links)
        assert brute.components(n, given + links) == brute.components(n, given + alike)


def simhash_shingles(text):
    w = text.split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}


def test_substring(spark, monkeypatch):
    rows = texts()
    for chunk in (100_000, 7):  # chunks that cut the rows of one anchor
        monkeypatch.setattr(substring, "_CHUNK", chunk)
        got = substring.remove_repeats(frame(spark, rows)).select(
            "doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda n, s: n + s["length"]), F.sha2("kept", 256)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute.substring(rows)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_in_chunks():
    """The streamed resolution gives the same for any chunk, over many documents of few anchors."""
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    n = 500
    h, doc = rnd.integers(0, 4, n), rnd.integers(0, 60, n)
    order = np.lexsort((doc, h))
    windows = [rnd.integers(0, 12, rnd.integers(1, 9)).astype(np.uint64).tobytes() for _ in range(n)]
    batch = pa.record_batch([pa.array(h[order]), pa.array(doc[order]), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n, dtype=np.int32)),
                             pa.array(windows, pa.binary())], ["h", "doc_id", "version", "first", "windows"])
    want = {}
    for i in range(n):
        for bit, w in enumerate(np.frombuffer(windows[i], np.uint64)):
            if any(h[order][j] == h[order][i] and doc[order][j] < doc[order][i] and w in np.frombuffer(windows[j], np.uint64) for j in range(n)):
                want[i] = want.get(i, 0) | 1 << bit
    for chunk in (3, 50, 1000):
        substring._CHUNK, before = chunk, substring._CHUNK
        try:
            parts = list(substring._repeats(iter([batch.slice(i, 20) for i in range(0, n, 20)])))
        finally:
            substring._CHUNK = before
        got = {f: m for p in parts for f, m in zip(p.column(2).to_pylist(), p.column(3).to_pylist())}
        assert got == want


def test_licenses(spark):
    rows = texts() + [(22, "the mit license " * 300), (23, "Creative Commons Attribution-NonCommercial 4.0, all rights reserved; SPDX-License-Identifier: MIT"),
                      (5000, GPL), (None, GPL), (None, GPL), (5001, "Free Public Licence 1.0.0"), (5002, "either version 2 of the Licence, or (at your option) any later version"),
                      (5003, "PSF licence"), (5004, "see the licence"), (5005, "released under the terms of the Foo Licence")]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), round(r.score, 5))
           for r in licenses.scan_licenses(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute.licenses(rows, license_rules.rules(), licenses.PHRASES, licenses.CONFIDENCE)
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
    assert len(license_rules.rules()) >= 200
    labels = {str(g[0]): g[6] for g in got}
    assert labels["5000"] == "gpl-2" and all(g[6] == "gpl-2" for g in got if g[0] is None and g[1] == len(GPL.split()))
    assert all(labels[str(i)] for i in range(5001, 5006))


def shortest(pattern):
    """Texts that stand for every alternative of a pattern, with nothing optional."""
    from re import _constants as c, _parser

    def texts_of(tree):
        out = [""]
        for op, arg in tree:
            if op is c.LITERAL:
                more = [chr(arg)]
            elif op is c.IN:
                more = [chr(a[1]) if a[0] is c.LITERAL else chr(a[1][0]) if a[0] is c.RANGE else "z" for a in arg if a[0] is not c.NEGATE]
            elif op is c.BRANCH:
                more = [t for branch in arg[1] for t in texts_of(branch)]
            elif op is c.SUBPATTERN:
                more = texts_of(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                more = [t * arg[0] for t in (texts_of(arg[2]) if arg[0] else [""])]
            else:
                assert op in (c.ANY, c.NOT_LITERAL), op
                more = ["z"]
            out = [a + b for a in out for b in more]
        return out

    return texts_of(_parser.parse(pattern))


def test_license_keywords_are_part_of_every_match():
    for label, _, keyword, pattern in license_rules.rules():
        assert all(keyword in t for t in shortest(pattern)), (label, keyword, pattern)


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = texts()
    plain = Tokenizer.from_file(tokenizer_path())
    want = sorted(np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t in rows)
    got = packing.pack(packing.token_pieces(frame(spark, rows), tokenizer_path(), length=256), 2, length=256).collect()
    assert sum(r.length for r in got) == sum(len(w) // 4 for w in want)
    whole = {}
    for r in sorted((r for r in got if r.doc_id not in (6, None)), key=lambda r: (r.doc_id, r.start)):
        assert r.start * 4 == len(whole.setdefault(r.doc_id, b""))
        whole[r.doc_id] += bytes(r.ids)
        assert r.length * 4 == len(r.ids)
    assert all(w in want for w in whole.values())
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 256
    assert packing.pack(packing.token_pieces(frame(spark, []), tokenizer_path()), 1).count() == 0


def test_first_fit():
    rnd = np.random.default_rng(1)
    sizes = np.sort(rnd.integers(1, 100, 400))[::-1]
    bins, offsets = packing.first_fit(sizes, 100)
    room = []
    for size, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        want = next((i for i, left in enumerate(room) if left >= size), len(room))
        if want == len(room):
            room.append(100)
        assert (b, o) == (want, 100 - room[want])
        room[want] -= size


def test_encoder_equals_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer
    from vitrine.llm.text import slices

    monkeypatch.setattr(packing, "CACHED_WORDS", 500)
    rnd = random.Random(1)
    signs = ["a", "Z", "é", "É", "×", "÷", "'", "’", "s", "'s", "'T", "ll", "'ll", ",", ".", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "startoftext", "́", "̸",
             "<", "=", "5", "٣", "ß", "İ", "K", "漢", " ", "\n", "\u0085", "#", "$$", "-", "_", "ñ", "\x1c", "\x00", "😀", "|", "｜"]
    rows = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    plain, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    for s in slices(pa.array(rows), size=20_000):
        ids, count = encoder.encode_rows(s)
        ends = np.cumsum(count)
        for r, (end, n) in enumerate(zip(ends, count)):
            assert ids[end - n: end].tolist() == plain.encode(rows[s.first + r], add_special_tokens=False).ids


def test_mixing_of_small_sources(spark):
    """With blocks of 256 words: sources below a block, and the ones at their caps, get their targets to the word."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, words(100), "a"), (2, words(50), "b"), (3, words(70_000), "c"), (4, "", "d"), (5, words(1), "e"), (6, words(400), "f"), (None, words(30), None)]
    rows += [(10 + i, words(200), "c") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    taken, target = {}, {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"] + sum(s.length for s in r.slices)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert {s: taken[s] for s in ("a", "b", "d", "e", "f", None)} == {"a": 200, "b": 100, "d": 0, "e": 2, "f": 800, None: 60}
    assert abs(taken["c"] - target["c"]) <= 256


@pytest.mark.parametrize("shard_docs", [20_000, 3])
def test_mixing(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = texts()
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    sizes = sorted((d, len(brute.WORD.findall(t or ""))) for d, t in rows if d)
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id) == sizes
    sources = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"] + sum(s.length for s in r.slices)
        assert all(0 <= s.start and s.start + s.length <= r["size"] for s in r.slices)
        own = sources.setdefault(r.source, [0, 0, r.source_size, r.target])
        own[0] += r["size"]
        own[1] += r.taken
    total = sum(s[0] for s in sources.values())
    order = sorted(sources, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * total, set()
    while True:
        level = (left - sum(2 * sources[s][0] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * sources[s][0]}
        if not more:
            break
        capped |= more
    for s, (size, taken, told, target) in sources.items():
        assert size == told
        assert target == pytest.approx(2 * size if s in capped else weight[s] * level)
        assert abs(taken - target) <= 8 * (2 + sum(1 for r in got if r.source == s) / (1 if shard_docs == 3 else 1000))
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(frame(spark, [(1, None), (2, "")])).collect())


def test_apportion(spark):
    rnd = random.Random(4)
    for seats in (0, 1, 7, 100, 10 ** 6):
        weights = [rnd.choice([0.0, 1.0, 2.5, 100.0, 1000.0]) for _ in range(40)]
        caps = [rnd.randrange(0, 60) for _ in weights]
        given = [0] * 40
        for _ in range(min(seats, sum(c for w, c in zip(weights, caps) if w > 0))):
            best = max((i for i in range(40) if given[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
            given[best] += 1
        cells = spark.createDataFrame([(i, w, c) for i, (w, c) in enumerate(zip(weights, caps))], "k int, weight double, cap long")
        assert [r.seats for r in mixing.apportion(cells, seats, ["k"]).orderBy("k").collect()] == given


def labelled():
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ne", "ti", "so", "da", "fu")]
    out = []
    for i in range(600):
        toxic, good = int(i % 4 == 0), int(i % 3 > 0)
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 90))]
        if toxic:
            for _ in range(3):
                t[rnd.randrange(len(t))] = rnd.choice(["blorgish", "snarkel", "grumphy"])
        text = " ".join(t).capitalize() + "." if good else " ".join(f"{x}###" for x in t)
        out.append((i, text, toxic, good))
    return out


def test_toxicity(spark):
    rows = labelled()
    docs = frame(spark, [(d, t) for d, t, _, _ in rows])
    labels = spark.createDataFrame([(d, x) for d, _, x, _ in rows if brute.fold(d) != 2] + [(None, 1), (3, None)], "doc_id long, label int")
    model = toxicity.fit_toxicity(docs, labels)
    new = [(1, None), (1, ""), (2, "kane loti " * 20), (3, "kane loti " * 9 + "snarkell"), (4, "grumphyy " + "miso ruda " * 2000 + "snarkell blorgishh")]
    got = {(r.doc_id, r.score) for r in toxicity.score_toxicity(frame(spark, new), model).collect()}
    scores = dict(got)
    assert len(got) == 4 and scores[1] == 0 and scores[2] < 0.3 and scores[3] > 0.3 and scores[4] > 0.3 and all(0 <= s <= 1 for s in scores.values())
    held = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(held[d] >= 0.3) == bool(x) for d, _, x, _ in rows if brute.fold(d) == 2]) > 0.97
    nothing = toxicity.fit_toxicity(frame(spark, []), spark.createDataFrame([], "doc_id long, label int"))
    assert toxicity.score_toxicity(docs, nothing).where("score between 0 and 1").count() == 600


def test_quality(spark):
    rows = labelled()
    docs = frame(spark, [(d, t) for d, t, _, _ in rows])
    labels = spark.createDataFrame([(d, g) for d, _, _, g in rows if brute.fold(d) != 2] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 60
    scored = quality.score_quality(docs, model)
    held = {r.doc_id: r.score for r in scored.collect()}
    assert np.mean([(held[d] >= 0.7) == bool(g) for d, _, _, g in rows if brute.fold(d) == 2]) > 0.97
    stats = scored.select("doc_id", "stats.*", "score").toPandas()
    assert np.allclose(model.score(stats[quality.STATISTICS].to_numpy()), stats["score"])
    edge = quality.score_quality(frame(spark, texts()), model).collect()
    assert len(edge) == len(texts()) and all(0 <= r.score <= 1 for r in edge)
    constant = quality.fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert constant.rules == [] and quality.score_quality(frame(spark, []), constant).count() == 0


def test_fold(spark):
    ids = [0, 1, 5, 77, 123456789]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fold()).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 4 for i in ids]
