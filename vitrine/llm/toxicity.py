"""Toxicity score of whole texts by embeddings of subwords.

A word is the bag of its character n-grams, word boundaries included; each n-gram's hash picks one of BUCKETS
embeddings. The embeddings of SPAN consecutive words are averaged and go into a linear softmax over the two
classes. A document is clean if all its spans are (noisy or), so an insult in a long text is not averaged away, and
several count for more. Embeddings and softmax are trained together; misspelt words that were never seen share most n-grams with those that were.

For scoring, embeddings and softmax fold into one number for each bucket."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.text import LOWER, slices

FIT_ROWS = 8000        # labelled rows that a model is fitted on, at most
FIT_BYTES = 64 << 10   # longer texts are not used for fitting
BUCKETS, DIM = 1 << 17, 8
SHORTEST, LONGEST = 3, 6
SPAN, STRIDE = 6, 3
EPOCHS, RATE, DECAY = 50, 0.1, 1e-3


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word index of every n-gram; words are ASCII lower-cased here."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.frombuffer((b"<" + b"><".join(words) + b">").translate(LOWER), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    room = np.repeat(ends, size) - np.arange(len(joined))
    padded = np.concatenate([joined, np.zeros(LONGEST, np.uint8)]).astype(np.uint32)
    h = np.zeros(len(joined), np.uint32)
    buckets, of = [], []
    for n in range(1, LONGEST + 1):
        h = h * np.uint32(0x01000193) + padded[n - 1: n - 1 + len(joined)] + np.uint32(1)
        if n >= SHORTEST:
            inside = np.flatnonzero(room >= n)
            x = h[inside]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            buckets.append((x >> np.uint32(15)).astype(np.int64) % BUCKETS)
            of.append(word[inside])
    return np.concatenate(buckets), np.concatenate(of)


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 word (over all rows) of every span, and its row. A row without words has none."""
    number = np.where(counts > SPAN, -(-(counts - SPAN) // STRIDE) + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), number)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = begin[row] + STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number))
    return at, np.minimum(at + SPAN, begin[row + 1]), row


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, np.clip(x, -40, 40))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the buckets: log odds that an n-gram adds to the mean
    bias: float

    def score(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Scores of rows given as all their words in a row and their numbers of words."""
        calm = np.zeros(len(counts))  # minus the log of the chance that no span is toxic
        if words:
            bucket, word = grams(words)
            total = np.concatenate([[0.0], np.cumsum(np.bincount(word, self.weights[bucket], len(words)))])
            number = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
            begin, end, row = spans(counts)
            mean = (total[end] - total[begin]) / np.maximum(1, number[end] - number[begin]) + self.bias
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            calm[row[first]] = np.add.reduceat(_softplus(mean), first)
        return np.round(-np.expm1(-calm), 9)


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    """Train on texts and 0/1 labels, the same result for the same rows. Without both labels the score is constant."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), bias)
    rng = np.random.default_rng(seed)
    codes: dict[bytes, int] = {}
    split = [t.encode().translate(LOWER).split() for t in texts]
    counts = np.array([len(w) for w in split])
    index = np.fromiter((codes.setdefault(x, len(codes)) for w in split for x in w), np.int64, int(counts.sum()))
    bucket, word = grams(list(codes))
    per_word = np.bincount(word, minlength=len(codes))
    begin, end, row = spans(counts)
    prefix = np.concatenate([[0], np.cumsum(per_word[index])])
    number = np.maximum(1, prefix[end] - prefix[begin])
    seen = np.bincount(bucket, np.bincount(index, minlength=len(codes))[word], BUCKETS)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    each = np.diff(np.append(first, len(row)))
    y = np.repeat(labels[row[first]], each).astype(float)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax = rng.normal(0, 0.1, (DIM, 2))
    biases = np.array([-0.5, 0.5]) * np.log(share / max(1.0, len(row) / len(each)))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (embedding, softmax, biases)]
    for epoch in range(1, EPOCHS + 1):
        direction = softmax[:, 1] - softmax[:, 0]
        value = embedding @ direction
        total = np.concatenate([[0.0], np.cumsum(np.bincount(word, value[bucket], len(codes))[index])])
        odds = (total[end] - total[begin]) / number + biases[1] - biases[0]
        toxic = np.repeat(-np.expm1(-np.add.reduceat(_softplus(odds), first)), each)
        miss = (toxic - y) / np.maximum(toxic, 1e-12) / (1 + np.exp(-np.clip(odds, -40, 40))) / len(each)
        steps = np.bincount(begin, miss / number, len(index) + 1) - np.bincount(end, miss / number, len(index) + 1)
        by_word = np.bincount(index, np.cumsum(steps[:-1]), len(codes))
        by_bucket = np.bincount(bucket, by_word[word], BUCKETS)
        toward = embedding.T @ by_bucket
        decay = DECAY / np.sqrt(1.0 + seen)[:, None] / len(each) * 100
        gradients = (np.outer(by_bucket, direction) + decay * embedding, np.column_stack([-toward, toward]) + 1e-4 * softmax,
                     np.array([-miss.sum(), miss.sum()]))
        for parameter, gradient, (m, v) in zip((embedding, softmax, biases), gradients, state):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient ** 2 - v)
            parameter -= RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-8)
    return Model(embedding @ (softmax[:, 1] - softmax[:, 0]), float(biases[1] - biases[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit in one task on at most ``fit_rows`` rows of ``labels`` (doc_id, label 0/1), those with the smallest hashed ids, whose
    texts have at most FIT_BYTES bytes: a bounded sample whatever the size of the table. Rows with a NULL are left out; of a
    repeated id one label is used, the smallest."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("label").cast("int").alias("_label")).dropna()
              .groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    rows = texts.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(chosen), "_id")  # fit_rows small rows at most

    def train(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["_id", "text"]).head(2 * fit_rows)
        model = fit(found["text"].tolist(), found["_label"].to_numpy())
        return pd.DataFrame({"weights": [model.weights.astype("<f8").tobytes()], "bias": [model.bias]})

    trained = rows.groupBy(F.lit(0).alias("_all")).applyInPandas(train, "weights binary, bias double").first()
    if trained is None:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(np.frombuffer(trained["weights"], "<f8"), trained["bias"])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row. NULL and empty texts have no span, so 0. Extra columns are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [np.zeros(0)]
            for s in slices(b.column(1)):
                words = [w for r in range(len(s.counts)) for w in s.data[s.offsets[r]: s.offsets[r + 1]].tobytes().split()]
                scores.append(model.score(words, s.counts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
