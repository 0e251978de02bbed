"""Quality classifier as a sparse rule ensemble.

Statistics of each text (lengths, character classes, repetition) are the inputs. On a bounded sample of labelled rows,
boosted shallow trees are grown; every path from a root to a node is a conjunctive rule. An L1-penalised logistic
regression over the rules keeps few of them, and those compile into one Spark column expression for the score.

Defined cases: a null text is empty; an empty text has all-zero statistics and is scored like any other; rows without
label, or with a null label or doc_id, train nothing; of repeated labels each row counts; with no usable label, or one
class alone, the score is the (smoothed) share of label 1; an empty table gives no rows; columns other than the
key and the text are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import batches, cut, text_or_empty

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "stop", "comma", "exclamation", "question", "pipe", "symbol", "markup", "other_ascii",
    "non_ascii", "distinct_words", "repeated_neighbour", "top_word", "long_words", "short_words", "distinct_lines", "line_words", "last_stop",
)


def _ascii(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_CLASSES = np.stack(
    [
        (np.arange(256) >= 65) & (np.arange(256) <= 90),
        (np.arange(256) >= 48) & (np.arange(256) <= 57),
        _ascii(" \t\r\n"), _ascii("."), _ascii(",;:"), _ascii("!"), _ascii("?"), _ascii("|"), _ascii("#$%&*@"), _ascii("<>{}[]\\/=_~^"), _ascii("\"'()-+`"),
        np.arange(256) >= 128,
    ]
).T.astype(np.float64)


def statistics(text: bytes) -> list[float]:
    """The values of FEATURES; shares are between 0 and 1."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    shares = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES / n).tolist()
    words = text.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.sum() / k), *shares,
        len(counts) / k, same / k, max(counts.values(), default=0) / k, float((sizes > 12).sum() / k), float((sizes < 3).sum() / k),
        len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), float(text.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, one double per feature): one narrow pass over whole texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(it, "k", "t"):
            values = np.array([statistics(t) for t in texts], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), *(pa.array(values[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES))


#: A condition: feature, whether it must be above the bound, the bound.
Condition = tuple[int, bool, float]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * covers(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, name=lambda i: F.col(FEATURES[i])) -> Column:
        """The same score as an expression over the feature columns."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            held = None
            for feature, above, bound in rule:
                one = name(feature) > bound if above else name(feature) <= bound
                held = one if held is None else held & one
            z = z + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for feature, above, bound in rule:
        held &= x[:, feature] > bound if above else x[:, feature] <= bound
    return held


def _grow(x: np.ndarray, binned: np.ndarray, bounds: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, least: int, out: list, step: np.ndarray) -> None:
    value = grad[rows].sum() / (hess[rows].sum() + 1.0)
    if path:
        out.append(path)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        whole = grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)
        for f in features:
            if not len(bounds[f]):
                continue
            b = binned[rows, f]
            g, h, n = (np.bincount(b, weights=w, minlength=len(bounds[f]) + 1)[:-1].cumsum() for w in (grad[rows], hess[rows], np.ones(len(rows))))
            right_g, right_h = grad[rows].sum() - g, hess[rows].sum() - h
            gain = np.where((n >= least) & (len(rows) - n >= least), g**2 / (h + 1.0) + right_g**2 / (right_h + 1.0) - whole, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, i)
    if best[1] is None:
        step[rows] = value
        return
    f, bound = int(best[1]), float(bounds[best[1]][best[2]])
    left = x[rows, f] <= bound
    _grow(x, binned, bounds, grad, hess, rows[left], features, depth - 1, (*path, (f, False, bound)), least, out, step)
    _grow(x, binned, bounds, grad, hess, rows[~left], features, depth - 1, (*path, (f, True, bound)), least, out, step)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, bins: int = 48, rate: float = 0.3) -> list[tuple[Condition, ...]]:
    """Distinct paths of boosted trees, each grown on half of the rows and of the features."""
    rng = np.random.RandomState(seed)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    bounds = [b[b < c.max()] if len(b) else b for b, c in zip(bounds, x.T)]
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T)], axis=1)
    z, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.rand(len(y)) < 0.5)
        features = rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]
        paths: list = []
        step = np.zeros(len(y))
        if len(rows):
            _grow(x, binned, bounds, y - p, p * (1 - p), rows, features, depth, (), max(5, len(y) // 400), paths, step)
        z += rate * np.clip(step, -4, 4)
        for path in paths:
            found.setdefault(frozenset(path), path)
    return list(found.values())


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights, by accelerated proximal gradients over standardised columns."""
    mean, scale = m.mean(axis=0), np.maximum(m.std(axis=0), 1e-3)
    a = ((m - mean) / scale).astype(np.float32)
    n, k = a.shape
    v = np.ones(k, dtype=np.float32)
    for _ in range(15):  # largest eigenvalue, for the step
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-9)
    lipschitz = 0.25 * (float(np.linalg.norm(a @ v)) ** 2 / n + 1) * 1.05
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ u.astype(np.float32) + c, -30, 30))) - y
        w_next = u - (a.T @ r.astype(np.float32)).astype(np.float64) / n / lipschitz
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - penalty / lipschitz, 0)
        b_next = c - r.mean() / lipschitz
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    raw = w / scale
    return float(b - (raw * mean).sum()), raw


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, penalty: float = 0.002, most_rules: int = 60, seed: int = 1) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))))
    rules = tree_rules(x, y, trees, depth, seed)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))))
    m = np.stack([covers(r, x) for r in rules], axis=1).astype(np.float32)
    _, first, _ = np.unique(m, axis=1, return_index=True, return_inverse=True)
    keep = np.sort(first)
    _, weights = lasso_logistic(m[:, keep], y, penalty)
    used = keep[np.argsort(-np.abs(weights) * m[:, keep].std(axis=0), kind="stable")[:most_rules]]
    intercept, weights = lasso_logistic(m[:, used], y, penalty)
    return RuleModel(intercept, [(rules[i], float(w)) for i, w in zip(used, weights) if abs(w) > 1e-6])


def training_labels(labels: DataFrame, label: str = "quality", key: str = "doc_id", most_rows: int = 20_000) -> DataFrame:
    """(doc_id, y): at most `most_rows` labels, those with the least hashes of their ids, so they may be broadcast."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    return known.orderBy(F.xxhash64("doc_id"), "y").limit(most_rows)


def train(stats: DataFrame, known: DataFrame, **options) -> RuleModel:
    """Fit on the rows of stats that `known` (from training_labels) names: the only rows that the driver sees."""
    rows = stats.join(F.broadcast(known), "doc_id").select("y", *FEATURES).orderBy("y", *FEATURES).toPandas()
    return fit_rules(rows[list(FEATURES)].to_numpy(np.float64), (rows["y"].to_numpy(np.float64) >= 0.5).astype(np.float64), **options)


def held_out_rows(key: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("long").cast("string")) % folds == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, most_rows: int = 20_000, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Held-out rows never train."""
    stats = cut(text_statistics(docs, key, text))
    model = train(stats, training_labels(labels.where(~held_out_rows(key)), key=key, most_rows=most_rows), **options)
    scored = stats.select("doc_id", held_out_rows("doc_id").alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, most_rows: int = 20_000, **options) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns; texts are not shuffled."""
    known = cut(training_labels(labels, key=key, most_rows=most_rows))
    ids = known.select(F.col("doc_id").alias("_id")).distinct()
    seen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi")
    model = train(cut(text_statistics(seen)), known, **options)

    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t.encode()) for t in texts], columns=list(FEATURES), dtype=np.float64)

    # Not deterministic as far as the optimiser knows, so that it measures a text once and not for each use of a statistic.
    measured = F.pandas_udf(measure, ", ".join(f"{c} double" for c in FEATURES)).asNondeterministic()
    scored = docs.withColumn("_statistics", measured(text_or_empty(text)))
    return scored.where(model.column(lambda i: F.col("_statistics")[FEATURES[i]]) >= threshold).select(*docs.columns)
