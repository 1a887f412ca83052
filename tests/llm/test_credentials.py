"""Secrets: base spans against plain patterns over strings, automata on known languages, unlabelled credentials of a learned format."""

import hashlib
import random
import re

import numpy as np
import pytest

from vitrine.llm import credentials, queries

SCHEMA = "doc_id long, text string, spans string, kind string, label string, value string, h long"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    """[(start, order, end, kind)] in code points."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def digits(rnd, n, of="0123456789abcdef"):
    return "".join(rnd.choice(of) for _ in range(n))


def corpus():
    rnd = random.Random(9)
    syllables = ["the", "and", "tion", "ver", "lich", "ment", "eau", "ing", "sch", "ent"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(240):
        extra = [f"password={digits(rnd, 18)}", f'Token = "{digits(rnd, 40)}"', "AKIA" + digits(rnd, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                 ".".join(str(rnd.randrange(10, 255)) for _ in range(4)), "4" + digits(rnd, 15, "0123456789"), word().upper() + word().upper()][i % 6]
        rows.append((i, f"{prose(30)} {extra} {prose(20)}"))
    return rows, prose, rnd


EDGES = [
    (1000, None), (1001, ""), (1002, "é漢 api_key: 'abcdef-1' ÀPI KEY"), (1003, "PASSWORD=short secret: longer.value= token='x' apikey=sixsix"),
    (1004, "password: token=abcdefgh"), (1005, "AKIAAKIA" + "Z" * 15 + " AKIA" + "Z" * 15 + "-AKIA" + "9" * 16 + "a"),
    (1006, "x" + "ab12" * 6 + "g" + "0" * 23 + " " + "f" * 24), (1007, "toKen=abcdefgh paſſword=abcdefgh"),
    (1008, "token=" + "a1" * 40_000), (1009, "secret\n=abcdefgh secret= \n abcdefgh token\t=abcdefgh"), (1009, "token=repeated"), (1009, "token=repeated"),
    (None, "token=without-id " + "deadbeef" * 5), (1010, 'api_key":"quoted-value"'), (1011, "=" * 50), (1012, "token=abcdef" + "é" + "token=ghijkl"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows, prose, rnd = corpus()
    bare = [(2000 + i, f"{prose(4)} {digits(rnd, 18)} {prose(4)}") for i in range(40)]  # the format of the passwords, without a keyword
    rows += EDGES + bare
    frame = spark.createDataFrame([(*r, "s", "k", "l", "v", 1) for r in rows], SCHEMA).repartition(5)
    return rows, frame, credentials.fit_formats(frame.where("doc_id is null or doc_id < 2000"), 500)


def test_base_spans(docs):
    rows, frame, model = docs
    got = credentials.find_secrets(frame, model).collect()
    mine = [(r["doc_id"], [tuple(s)[:3] for s in r["spans"] if s["kind"] != "format"]) for r in got]
    want = [(i, [(kind, a, b) for a, _, b, kind in base(t)]) for i, t in rows]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert all((s["score"] is None) == (s["kind"] != "format") for r in got for s in r["spans"])


def test_formats_are_found_without_a_keyword(docs):
    rows, frame, model = docs
    assert set(model) == {*credentials.CREDENTIALS, *credentials.ORDINARY}
    texts = dict(rows)
    found = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "format"] for r in credentials.find_secrets(frame, model).collect()}
    bare = [i for i in texts if i is not None and i >= 2000]
    hit = [i for i in bare if [texts[i][s["start"]: s["end"]] for s in found[i]] == [re.search(r"\b[0-9a-f]{18}\b", texts[i])[0]]]
    assert len(hit) >= 0.9 * len(bare)
    assert not any(found[i] for i in range(240))  # prose, addresses, card numbers and capitals stay


def test_digest(spark, docs, tmp_path):
    rows, frame, _ = docs
    frame.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_secrets(spark, str(tmp_path)).collect()
    for r in got:
        if r["doc_id"] in (None, 1009):
            continue
        own = base(dict(rows)[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[3] == k for s in own) for k in ("assign", "access", "hex")]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in own)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format:")] == [s for s in listed.split(",") if s]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert credentials.find_secrets(none, credentials.fit_formats(none)).count() == 0
    only = spark.createDataFrame([(1, "token=abcdefgh", "s", "k", "l", "v", 1)], SCHEMA)  # nothing ordinary to compare with
    assert [s["kind"] for s in credentials.find_secrets(only, credentials.fit_formats(only)).first()["spans"]] == ["assign"]


def likelihood(automaton, s):
    signs = credentials.SIGN[np.frombuffer(s.encode(), np.uint8)]
    return float(automaton.score(signs, np.array([0]), np.array([len(signs)]))[0])


def test_inference_merges_equal_states():
    """(ab)* has two states; a fixed prefix with a random tail becomes a chain and a loop."""
    rnd = random.Random(2)
    loop = credentials.infer([b"ab" * min(40, int(rnd.expovariate(0.3))) for _ in range(800)])
    assert len(loop.cost) == 2
    assert likelihood(loop, "ab" * 9) > likelihood(loop, "ab" * 4 + "ba" + "ab" * 4) + 10
    key = credentials.infer([("KEY-" + digits(rnd, 12)).encode() for _ in range(600)])
    assert len(key.cost) < 25
    assert likelihood(key, "KEY-" + digits(rnd, 12)) > likelihood(key, "YEK-" + digits(rnd, 12)) + 10
    assert np.allclose(np.exp(key.cost).sum(1), 1)
    assert len(credentials.infer([]).cost) == 1


def test_score_of_long_strings_is_the_same_walk():
    rnd = random.Random(4)
    a = credentials.infer([digits(rnd, rnd.randint(1, 30)).encode() for _ in range(300)] + [b"zz-" + digits(rnd, 9).encode() for _ in range(300)])
    texts = [digits(rnd, n) for n in (0, 1, 127, 128, 129, 700)] + ["zz-" + digits(rnd, 300)]
    data = credentials.SIGN[np.frombuffer("".join(texts).encode(), np.uint8)]
    end = np.cumsum([len(t) for t in texts])
    got = a.score(data, end - [len(t) for t in texts], end)
    for t, value in zip(texts, got):
        state, want = 0, 0.0
        for c in t:
            sign = int(credentials.SIGN[ord(c)])
            want, state = want + a.cost[state, sign], a.after[state, sign]
        assert value == pytest.approx(want + a.cost[state, credentials.END])
