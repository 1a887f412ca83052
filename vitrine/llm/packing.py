"""Token sequences of fixed length packed from documents by first-fit decreasing.

Documents are dealt at random into groups of about GROUP_DOCS; each group is packed by one task.
A document's tokens are cut at multiples of the sequence length; whole sequences stand alone, the
remainders of a group are placed from longest to shortest, each into the first sequence that has
room. A tournament tree over the room left in the sequences finds that one in logarithmic time.
A group wastes at most a fraction of its last sequences, so padding does not depend on the input's size."""

from __future__ import annotations

import os
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.text import LOWER, Slice, release, slices

LENGTH = 2048
GROUP_DOCS = 20_000
SEED = 17
CACHED_WORDS = 150_000
JOINED = 256
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


class Encoder:
    """Token ids of texts, each different word given to the tokenizer once.

    This tokenizer's pre-tokenizer drops white space and always cuts between a letter and another sign than an
    apostrophe; nothing before it looks across such a cut. So a text's ids are those of the parts so cut, in a row.
    ``flat[begin[c]: begin[c + 1]]`` are those of the part with code c."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads only keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.sign = self.tokenizer.encode("|", add_special_tokens=False).ids[0]
        self.keep(np.zeros(0, np.int64))

    def keep(self, codes: np.ndarray) -> None:
        """Forget all words but these."""
        outer = self

        class Codes(dict):
            def __missing__(self, word: bytes) -> int:
                code = self[word] = len(self)
                outer.fresh.append(word)
                return code

        words = list(getattr(self, "codes", ()))
        kept = Codes((words[c], i) for i, c in enumerate(codes.tolist()))
        if len(codes):
            ids, count = self._of(codes)
            self.begin, self.flat, self.uses = np.concatenate([[0], np.cumsum(count)]), ids, self.uses[codes] // 2
        else:
            self.begin, self.flat, self.uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.codes, self.fresh = kept, []

    def _of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.begin[codes + 1] - self.begin[codes]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begin[codes] - (ends - count), count) + np.arange(total)], count

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each word."""
        if len(self.codes) > CACHED_WORDS:  # those used again stay, at most half of the room
            order = np.argsort(-self.uses, kind="stable")[: CACHED_WORDS // 2]
            self.keep(np.sort(order[self.uses[order] > 1]))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        ids, counts = self._learned(self.fresh)
        self.fresh = []
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(counts), np.int64)]) + np.bincount(codes, minlength=len(self.codes))
        return self._of(codes)

    def _learned(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words in a row, and the number of each. JOINED words go into one text, between signs whose id tells them apart."""
        alone = [b"|" in w for w in words]
        plain = [w.decode() for w, a in zip(words, alone) if not a]
        counts, own, size = np.zeros(len(words), np.int64), [], []
        texts = [" | ".join(plain[at: at + JOINED]) for at in range(0, len(plain), JOINED)]
        for at in range(0, len(texts), 4):  # an encoding is far larger than its ids
            for n, e in enumerate(self.tokenizer.encode_batch_fast(texts[at: at + 4], add_special_tokens=False), at):
                got = np.array(e.ids, np.int64)
                sign = got == self.sign
                part = plain[n * JOINED: (n + 1) * JOINED]
                if sign.sum() != len(part) - 1:  # a word has that id of its own
                    each = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int64) for w in part]
                    own += each
                    size.append(np.array([len(x) for x in each]))
                    continue
                cut = np.concatenate([[-1], np.flatnonzero(sign), [len(got)]])
                own.append(got[~sign])
                size.append(np.diff(cut) - 1)
        single = [np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.int64) for w, a in zip(words, alone) if a]
        is_alone = np.array(alone, bool)
        counts[~is_alone] = np.concatenate([np.zeros(0, np.int64), *size])
        counts[is_alone] = [len(x) for x in single]
        ids = np.zeros(int(counts.sum()), np.uint32)
        mine = np.repeat(is_alone, counts)
        ids[~mine] = np.concatenate([np.zeros(0, np.int64), *own])
        ids[mine] = np.concatenate([np.zeros(0, np.int64), *single])
        return ids, counts

    def encode_rows(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice in a row, and the number of ids of each row."""
        data, offsets = np.frombuffer(s.data.tobytes().translate(LOWER), np.uint8), s.offsets
        kind = _KIND[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = second[_LATIN[data[second]]]
        kind[second] = kind[second - 1] = 1
        cuts = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1  # 1 beside 2
        text = np.insert(data, cuts, 0x20).tobytes()
        offsets = (offsets + np.searchsorted(cuts, offsets)).tolist()
        parts, number = [], []
        for r in range(len(s.counts)):
            row = text[offsets[r]: offsets[r + 1]]
            if b"< |" in row or b"<|" in row:  # perhaps a special token's name
                row = s.data[s.offsets[r]: s.offsets[r + 1]].tobytes()
            row = row.split()
            parts += row
            number.append(len(row))
        ids, count = self.encode(parts)
        return ids, np.diff(np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(number)])])


_ENCODERS: dict[str, Encoder] = {}  # of this worker; kept from task to task, and for KEPT_S without one
_FORGETS: list[threading.Timer] = []
KEPT_S = 3.0
# 1: a-z; 2: other ASCII signs that a cut next to a letter is certain at
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 2
_KIND[ord("a"): ord("z") + 1] = 1
_LATIN = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF, which start with C3
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def _encoder(path: str) -> Encoder:
    while _FORGETS:
        _FORGETS.pop().cancel()
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def _rest() -> None:
    """Unless another task comes, the worker gives up its encoder: idle workers stay with the executor."""
    def forget() -> None:
        _ENCODERS.clear()
        release()

    timer = threading.Timer(KEPT_S, forget)
    timer.daemon = True
    timer.start()
    _FORGETS.append(timer)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: ``start``, the document's ids before it; ``length``; ``doc_tokens``, the
    document's ids in all, its closing ``end_id`` included; ``ids``, little-endian unsigned 32-bit.

    ``tokenizer`` is the path of a tokenizer file that every executor has. NULL and empty texts are the one
    piece [end_id]. Repeated rows each count; extra columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            for s in slices(b.column(1)):
                ids, count = encoder.encode_rows(s)
                tokens = np.concatenate([[0], np.cumsum(count)])
                doc, start, cut = [], [], []
                for r in range(len(s.counts)):
                    own = np.append(ids[tokens[r]: tokens[r + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), length):
                        doc.append(r)
                        start.append(at)
                        cut.append(own[at: at + length].tobytes())
                size = np.diff(tokens) + 1
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(s.first + np.array(doc))), pa.array(start, pa.int64()),
                    pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(size[doc], pa.int64()), pa.array(cut, pa.binary()),
                ], ["doc_id", "start", "length", "doc_tokens", "ids"])
        _rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE)


def first_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For sizes in descending order, each at most ``room``: the first bin with room for each, and its offset there."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [room] * (2 * leaves)  # tree[i] is the most room below node i
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, room - tree[at]
        left = tree[at] - size
        tree[at] = left
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return bins, offsets


def pack(pieces: DataFrame, groups: int, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``pieces`` (doc_id, start, length and any payload) with ``sequence_id`` and ``offset``, its place there.

    Documents are dealt into ``groups`` by a seeded hash of doc_id; a group should hold about GROUP_DOCS
    documents. Ties in length are ordered by doc_id and start, so reruns agree. Extra columns are kept,
    but not under the names ``sequence_id``, ``offset`` and ``_group``."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = first_fit(rows["length"].to_numpy(), length)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    plain = pieces.drop("sequence_id", "offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    dealt = plain.withColumn("_group", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def group_count(docs: DataFrame) -> int:
    """Groups of about GROUP_DOCS documents each, at least one."""
    return docs.count() // GROUP_DOCS + 1
