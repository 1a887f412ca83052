"""Secrets in whole texts: fixed patterns, and formats learned from what the patterns find.

Base spans are the matches of three patterns (BASE). The strings they find are labelled credentials; the other long tokens are
labelled by whether they hold a digit, or else two capitals. For each label a probabilistic automaton is inferred: its strings make a prefix tree with
counts, and states whose next characters are equally distributed, as far as their counts can tell (Hoeffding's bound), and whose
successors are too, are merged, in the order of the tree (red and blue states). A random tail becomes a loop, a fixed prefix stays.

Every token of at least SHORTEST credential characters is a candidate. Its score is the log likelihood by the best credential
automaton less that by the best ordinary one; a candidate that has no character in a base span and scores MARGIN or more is a span
of kind ``format``.

The strings to learn from are a bounded sample, the FIT_STRINGS of each label with the smallest hashes over all texts: each task
keeps as many, so what meets in the end doesn't grow with the texts' sizes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.text import string_buffers

# The base kinds in their order, their patterns, the group that counts and its least length.
BASE = [
    ("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", rb"AKIA[A-Z0-9]+", 0, 20),
    ("hex", rb"[0-9a-f]+", 0, 24),
]
KEYWORDS = (b"passw", b"secret", b"token", b"api")  # each match of the first pattern holds one, lower-cased
# End of fixed values.
FORMAT = "format"
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIGN = np.full(256, -1, np.int8)
SIGN[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
END = len(ALPHABET)
CREDENTIALS, ORDINARY = ("assign", "access", "hex"), ("word", "capitals", "number")

FIT_STRINGS = 2000  # distinct strings of each label that an automaton is inferred from
LONGEST = 256       # longer strings are learned up to here; they are scored whole
SHORTEST = 8        # of a candidate
MARGIN = 12.0       # log odds: the prior odds of a credential among tokens are taken as e ** -12
ALPHA = 0.05        # of the compatibility test
UNSEEN, ODD = 1e-4, 0.05  # share of a state's probability spread over all characters: of credentials, of ordinary tokens, which vary more
SLICE = 1 << 20
STEPS = 128         # characters scored for all candidates together; longer ones go on alone

_ASSIGN = BASE[0][1]


class Tree:
    """Prefix tree with counts whose states can be merged."""

    def __init__(self, strings: list[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.passed: list[dict[int, int]] = [{}]  # of a state: how often each character followed, END included
        for s in strings:
            at = 0
            for c in SIGN[np.frombuffer(s, np.uint8)].tolist():
                self.passed[at][c] = self.passed[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                at = self.next[at][c]
            self.passed[at][END] = self.passed[at].get(END, 0) + 1

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """No character's share, here and on all common ways from here, differs by more than Hoeffding's bound."""
        stack, wide = [(a, b)], math.sqrt(0.5 * math.log(2 / alpha))
        while stack:
            a, b = stack.pop()
            one, two = self.passed[a], self.passed[b]
            n, m = sum(one.values()), sum(two.values())
            if not n or not m:
                continue
            bound = wide * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1 and any(abs(one.get(c, 0) / n - two.get(c, 0) / m) > bound for c in one.keys() | two.keys()):
                return False
            stack += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def fold(self, into: int, state: int) -> list[tuple[int, int]]:
        """Add the tree below ``state`` to ``into``. Returns the (state, character) that got a new successor."""
        stack, grown = [(into, state)], []
        while stack:
            into, state = stack.pop()
            for c, n in self.passed[state].items():
                self.passed[into][c] = self.passed[into].get(c, 0) + n
            for c, t in self.next[state].items():
                if c in self.next[into]:
                    stack.append((self.next[into][c], t))
                else:
                    self.next[into][c] = t
                    grown.append((into, c))
        return grown


@dataclass(frozen=True)
class Automaton:
    after: np.ndarray  # state x character: the next state
    cost: np.ndarray   # state x (characters and END): log probability

    def score(self, signs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log likelihood of each string signs[begin:end]."""
        out, state = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
        live = np.argsort(begin - end, kind="stable")  # the longest first
        size = (end - begin)[live]
        for step in range(min(STEPS, int(size.max(initial=0)))):
            now = live[: np.searchsorted(-size, -step, "left")]  # those longer than step
            c = signs[begin[now] + step]
            out[now] += self.cost[state[now], c]
            state[now] = self.after[state[now], c]
        long = live[: np.searchsorted(-size, -STEPS, "left")]
        if len(long):
            after, cost = self.after.tolist(), self.cost.tolist()
            for i in long.tolist():
                s, x = int(state[i]), 0.0
                for c in signs[begin[i] + STEPS: end[i]].tolist():
                    x += cost[s][c]
                    s = after[s][c]
                out[i] += x
                state[i] = s
        return out + self.cost[state, END]


def infer(strings: list[bytes], unseen: float = UNSEEN, alpha: float = ALPHA) -> Automaton:
    """Merge the prefix tree of ``strings`` from the root on: a state next to the kept ones joins the first kept state that it is
    alike, or is kept itself. A character that a state never showed leads back to it, at a share of ``unseen``."""
    tree = Tree(sorted(s[:LONGEST] for s in strings))
    kept, index = [0], {0: 0}
    waiting = [(0, c) for c in sorted(tree.next[0])]
    while waiting:
        at, c = waiting.pop(0)
        state = tree.next[at].get(c)
        if state is None or state in index:
            continue
        same = next((k for k in kept if tree.alike(k, state, alpha)), None)
        if same is None:
            index[state] = len(kept)
            kept.append(state)
            waiting += [(state, d) for d in sorted(tree.next[state])]
        else:
            tree.next[at][c] = same
            waiting += sorted(edge for edge in tree.fold(same, state) if edge[0] in index)
    size = len(ALPHABET)
    after = np.repeat(np.arange(len(kept))[:, None], size, 1)
    cost = np.zeros((len(kept), size + 1))
    for i, state in enumerate(kept):
        n = sum(tree.passed[state].values())
        share = np.full(size + 1, 1 / (size + 1))
        if n:
            share *= unseen
            for c, m in tree.passed[state].items():
                share[c] += (1 - unseen) * m / n
        cost[i] = np.log(share)
        for c, t in tree.next[state].items():
            after[i, c] = index[t]
    return Automaton(after, cost)


def base_matches(text: bytes, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str, bytes]]:
    """(begin, end, kind, credential) in bytes. ``tokens`` are the runs of credential characters of at least 20: the
    matches of the last two patterns that count lie within one."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in re.finditer(_ASSIGN, text, re.IGNORECASE):
            if len(m[2]) >= BASE[0][3]:
                out.append((m.start(), m.end(), "assign", m[2]))
    for a, b in tokens:
        for kind, pattern, group, least in BASE[1:]:
            for m in re.finditer(pattern, text[a:b]):
                if len(m[group]) >= least:
                    out.append((a + m.start(), a + m.end(), kind, m[group]))
    return out


@dataclass
class Found:
    """Of a run of rows: all candidates as begin and end in ``data``, and each row's base matches."""

    data: np.ndarray
    rows: np.ndarray     # row of each candidate
    begin: np.ndarray
    end: np.ndarray
    free: np.ndarray     # candidates without a character in a base match
    base: list[tuple[int, int, int, str, bytes]]  # row, begin and end in its text, kind, credential
    offsets: np.ndarray  # of the rows

    def ordinary(self) -> np.ndarray:
        """Which of ORDINARY each candidate's label is."""
        def many(low: int, high: int) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum((self.data >= low) & (self.data <= high))])
            return upto[self.end] - upto[self.begin]
        return np.where(many(0x30, 0x39) > 0, 2, np.where(many(0x41, 0x5A) > 1, 1, 0))


def scan(column: pa.Array) -> Iterator[Found]:
    """All rows of a string column, in runs of about SLICE bytes."""
    offsets, data = string_buffers(column)
    least = min(SHORTEST, *(b[3] for b in BASE[1:]))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = min(rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1))
        part, local = data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        inside = SIGN[part] >= 0
        cut = np.zeros(len(part) + 1, bool)  # a run ends where its row does
        cut[local] = True
        begin = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
        end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        wide = end - begin >= least
        begin, end = begin[wide], end[wide]
        row = np.searchsorted(local, begin, "right") - 1
        free, base = np.ones(len(begin), bool), []
        first = np.searchsorted(row, np.arange(len(local)))
        large = end - begin >= min(b[3] for b in BASE[1:])
        text = part.tobytes()
        for r in range(to - at):
            a, b = first[r], first[r + 1]
            own = np.flatnonzero(large[a:b]) + a
            matches = base_matches(text[local[r]: local[r + 1]], [(int(begin[i] - local[r]), int(end[i] - local[r])) for i in own])
            for x, y, kind, value in matches:
                base.append((at + r, x, y, kind, value))
                # candidates of a row are apart and in order, so those that meet [x, y) are neighbours
                free[a + np.searchsorted(end[a:b], local[r] + x, "right"): a + np.searchsorted(begin[a:b], local[r] + y, "left")] = False
        yield Found(part, row + at, begin, end, free, base, np.concatenate([np.zeros(at, np.int64), local]))
        at = to


def labelled(docs: DataFrame, fit_strings: int = FIT_STRINGS, text_col: str = "text") -> DataFrame:
    """(label, value): of each label the ``fit_strings`` distinct strings with the smallest hashes in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[bytes, int]] = {}

        def shrink(label: str, most: int) -> None:
            own = kept.get(label, {})
            if len(own) > most:
                kept[label] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:fit_strings])

        for b in batches:
            for f in scan(b.column(0)):
                label = f.ordinary()
                text = f.data.tobytes()
                new = [(kind, value[:LONGEST]) for _, _, _, kind, value in f.base]
                new += [(ORDINARY[label[i]], text[f.begin[i]: min(f.end[i], f.begin[i] + LONGEST)]) for i in np.flatnonzero(f.free)]
                for name, value in set(new):
                    kept.setdefault(name, {})[value] = xxhash.xxh64_intdigest(value) >> 1
                    shrink(name, 4 * fit_strings)
        for label in list(kept):
            shrink(label, fit_strings)
        rows = [(label, v, h) for label, own in kept.items() for v, h in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["label", "value", "h"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "label string, value binary, h long").distinct()
    place = Window.partitionBy("label").orderBy("h", "value")
    return found.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= fit_strings).select("label", "value")


def fit_formats(docs: DataFrame, fit_strings: int = FIT_STRINGS, text_col: str = "text") -> dict[str, Automaton]:
    """An automaton for each label that has strings, each inferred in a task of its own. Credentials that no pattern finds count as
    ordinary here; where many share a format, that format is ordinary."""
    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = infer(rows["value"].tolist(), UNSEEN if key[0] in CREDENTIALS else ODD)
        return pd.DataFrame({"label": [key[0]], "after": [a.after.astype("<i8").tobytes()], "cost": [a.cost.astype("<f8").tobytes()]})

    trained = labelled(docs, fit_strings, text_col).groupBy("label").applyInPandas(train, "label string, after binary, cost binary").collect()
    return {r["label"]: Automaton(np.frombuffer(r["after"], "<i8").reshape(-1, len(ALPHABET)), np.frombuffer(r["cost"], "<f8").reshape(-1, len(ALPHABET) + 1))
            for r in trained}


def likelihood(model: dict[str, Automaton], signs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log likelihood by the best credential automaton less that by the best ordinary one. Without strings of either sort: minus infinity."""
    def best(labels: tuple[str, ...]) -> np.ndarray | None:
        each = [model[x].score(signs, begin, end) for x in labels if x in model]
        return np.max(each, axis=0) if each else None

    secret, plain = best(CREDENTIALS), best(ORDINARY)
    return np.full(len(begin), -np.inf) if secret is None or plain is None else secret - plain


SPAN = "kind: string, start: bigint, end: bigint, score: double"


def find_secrets(docs: DataFrame, model: dict[str, Automaton], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<kind, start, end, score>) for each row: base spans, with a score of NULL, and those of kind ``format``, by
    start, then kind (assign, access, hex, format). Code points from 0, end exclusive.

    A NULL text is an empty one and has no span; a NULL or repeated id keeps its row. Texts are scanned whole, whatever their
    length. Extra columns are left out; an empty table gives an empty table."""
    order = {kind: i for i, kind in enumerate([*(b[0] for b in BASE), FORMAT])}
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list[dict]] = {}
            for f in scan(b.column(1)):
                spans: dict[int, list[tuple]] = {}
                for r, x, y, kind, _ in f.base:
                    spans.setdefault(r, []).append((x, order[kind], y, kind, None))
                own = np.flatnonzero(f.free & (f.end - f.begin >= SHORTEST))
                score = likelihood(model, SIGN[f.data], f.begin[own], f.end[own])
                for i, s in zip(own[score >= margin].tolist(), score[score >= margin].tolist()):
                    start = int(f.offsets[f.rows[i]])
                    spans.setdefault(int(f.rows[i]), []).append((int(f.begin[i]) - start, order[FORMAT], int(f.end[i]) - start, FORMAT, s))
                for r, mine in spans.items():
                    text = f.data[f.offsets[r]: f.offsets[r + 1]]
                    point = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])  # code points before each byte
                    found[r] = [{"kind": kind, "start": int(point[x]), "end": int(point[y]), "score": s} for x, _, y, kind, s in sorted(mine)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([found.get(r, []) for r in range(b.num_rows)], pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans array<struct<{SPAN}>>")
