"""Quality score of whole texts by a sparse ensemble of rules over text statistics.

Boosted trees of depth DEPTH are grown on the statistics of a bounded sample of labelled rows; every path from
a root is a conjunctive rule. A logistic regression with an L1 penalty over all rules keeps few of them. The kept
rules are compiled into one Spark column expression, so scoring is a projection over the statistics, which are
built-in functions as well."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.text import WORD

FIT_ROWS = 6000  # labelled rows that a model is fitted on, at most
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 30, 3, 32, 0.3, 20
PENALTY = 2e-3
STATISTICS = ["chars", "words", "word_length", "upper", "digit", "symbol", "symbol_runs", "stops", "distinct_words",
              "distinct_lines", "line_words", "short_words"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``stats``: one double for each name in STATISTICS. NULL counts as empty; then all are 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn("_lines", F.split(t, "\n"))
    chars, words, lines = F.length(t), F.size("_words"), F.size("_lines")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(0.0)

    found = {
        "chars": chars, "words": words, "word_length": ratio(chars, words), "upper": ratio(count(r"\p{Lu}"), chars),
        "digit": ratio(count("[0-9]"), chars), "symbol": ratio(count(r"[^\p{L}\p{N}\s]"), chars),
        "symbol_runs": ratio(count(r"[^\p{L}\p{N}\s]{2,}"), words), "stops": ratio(count(r"[.?!](?=\s|$)"), words),
        "distinct_words": ratio(F.size(F.array_distinct("_words")), words),
        "distinct_lines": ratio(F.size(F.array_distinct("_lines")), lines), "line_words": ratio(words, lines),
        "short_words": ratio(F.size(F.filter("_words", lambda w: F.length(w) <= 3)), words),
    }
    stats = F.struct(*[found[name].cast("double").alias(name) for name in STATISTICS])
    return parts.select(*docs.columns, stats.alias("stats")).withColumn("stats", F.when(F.length(t) > 0, F.col("stats")).otherwise(
        F.struct(*[F.lit(0.0).alias(name) for name in STATISTICS])))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold)


def _grow(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One regression tree: the paths to all its nodes but the root, and its output for each row."""
    paths: list[Rule] = []
    output = np.zeros(len(gradient))

    def split(rows: np.ndarray, path: Rule) -> None:
        if path:
            paths.append(path)
        g, h = gradient[rows], hessian[rows]
        value = g.sum() / (h.sum() + 1.0)
        best = (1e-6, None, None)
        if len(path) < DEPTH:
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = bins[rows, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, x, len(cuts) + 1))[:-1] for x in (g, h, None))
                right_g, right_h = g.sum() - left_g, h.sum() - left_h
                gain = left_g ** 2 / (left_h + 1) + right_g ** 2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            output[rows] = value
            return
        _, j, k = best
        above = bins[rows, j] > k
        split(rows[~above], (*path, (j, False, float(edges[j][k]))))
        split(rows[above], (*path, (j, True, float(edges[j][k]))))

    split(np.arange(len(gradient)), ())
    return paths, output


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, threshold in rule:
        out &= (x[:, j] > threshold) if above else (x[:, j] <= threshold)
    return out


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all weights but the intercept, by accelerated proximal gradient."""
    n, p = x.shape
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1)
    w, v, t = np.zeros(p + 1), np.zeros(p + 1), 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-np.clip(x @ v[:p] + v[p], -30, 30))) - y
        new = v - step * np.append(x.T @ miss, miss.sum()) / n
        new[:p] = np.sign(new[:p]) * np.maximum(np.abs(new[:p]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return w[:p], float(w[p])


@dataclass(frozen=True)
class Ensemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self, stats: str = "stats") -> Column:
        """The score as an expression over the statistics: 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = None
            for j, above, threshold in rule:
                value = F.col(stats)[STATISTICS[j]]
                test = value > F.lit(threshold) if above else value <= F.lit(threshold)
                held = test if held is None else held & test
            total = total + F.when(held, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Ensemble:
    """Fit on statistics (rows by STATISTICS) and 0/1 labels. Without rows, or with one label only, the score is constant."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Ensemble([], base)
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) > BINS else (values[1:] + values[:-1]) / 2
        edges.append(cuts[cuts < values[-1]])
    bins = np.column_stack([np.searchsorted(cuts, x[:, j], "left") for j, cuts in enumerate(edges)])
    margin, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths, output = _grow(bins, edges, y - p, np.maximum(p * (1 - p), 1e-6))
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in paths))
        margin += RATE * output
    held = [(r, _holds(r, x)) for r in rules]
    kept, columns = [], set()
    for r, h in sorted(held, key=lambda rh: len(rh[0])):  # of rules that hold for the same rows, the shortest
        key = h.tobytes()
        if key not in columns and 0 < h.sum() < len(h):
            columns.add(key)
            kept.append((r, h))
    matrix = np.column_stack([h for _, h in kept]).astype(float)
    weights, intercept = _lasso(matrix, y.astype(float), penalty)
    return Ensemble([(r, float(w)) for (r, _), w in zip(kept, weights) if abs(w) > 1e-6], intercept)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """Fit on at most ``fit_rows`` rows of ``labels`` (doc_id, label 0/1), those with the smallest hashed ids: a bounded sample
    whatever the size of the table. Rows with a NULL are left out; of a repeated id one label is used, the smallest."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("label").cast("int").alias("_label")).dropna()
              .groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    rows = statistics(texts.join(F.broadcast(chosen), "_id"))  # fit_rows small rows at most
    found = rows.select("_id", "_label", "stats.*").orderBy("_id", *STATISTICS).limit(2 * fit_rows).toPandas()
    return fit_rules(found[STATISTICS].to_numpy(float), found["_label"].to_numpy(int))


def score_quality(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``stats`` and ``score``; columns of these names are replaced. NULL and empty texts
    get the score of all-zero statistics. Rows are neither added nor lost."""
    plain = docs.drop("stats", "score")
    return statistics(plain, text_col).withColumn("score", model.column())
