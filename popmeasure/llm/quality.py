"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and lengths of a text's bytes, words and lines. Each feature is cut into at most `bins` bins at
quantiles of the training rows. Boosting goes round the features; each step fits a tree of two cuts to the residuals of
one feature and adds it, shrunk, to that feature's lookup table. Then the pairs whose grid explains most of what is left
are boosted the same way on coarse two-way grids. A score is the sum of the looked-up numbers behind a logistic curve.

The features of all documents are computed once, stored (some 100 bytes a document) and used for training and scoring.
Training takes at most `max_labelled` labelled rows, those with the smallest hash of their id; all other work covers
all rows.

Defined results: null texts have the features of empty ones and are scored like them. Without both classes among the
labels every document scores 0.5. Repeated documents score alike; of contradicting labels the smaller counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popmeasure.llm.common import one_label, written
from popmeasure.llm.words import texts

FEATURES = (
    "log_bytes upper lower digit space line_feed full_stop comma exclamation bar other_symbol high_byte "
    "word_length longest_word distinct_words top_word symbol_words repeated_lines line_length distinct_bytes"
).split()
_BLOCK = 1 << 22


def features_of(text: str | None) -> list[float]:
    """The numbers of FEATURES for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    view = np.frombuffer(raw, np.uint8)
    n = max(len(raw), 1)
    counts = np.zeros(256, np.int64)
    for lo in range(0, len(view), _BLOCK):
        counts += np.bincount(view[lo : lo + _BLOCK], minlength=256)
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    named = counts[[32, 10, 46, 44, 33, 124]]
    high = counts[128:].sum()
    symbol = counts[33:127].sum() - upper - lower - digit - named[2:].sum()
    words = raw.split()
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    n_words = max(len(words), 1)
    lines = raw.split(b"\n")
    ends = sum(c for w, c in tally.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,"))
    return [
        float(np.log1p(len(raw))),
        *(x / n for x in (upper, lower, digit, *named, symbol, high)),
        sum(len(w) * c for w, c in tally.items()) / n_words,
        float(np.log1p(max(map(len, tally), default=0))),
        len(tally) / n_words,
        max(tally.values(), default=0) / n_words,
        ends / n_words,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(len(raw) / len(lines))),
        float((counts > 0).sum()),
    ]


def add_features(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the features of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "x": [features_of(t) for t in texts(frame)]})

    slim = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))
    kind = docs.schema[id_column].dataType
    made = slim.mapInPandas(run, "id string, x array<double>")
    return made.select(F.col("id").cast(kind).alias(id_column), "x")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    grids: list[np.ndarray]
    start: float

    def binned(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.binned(x, self.cuts), self.binned(x, self.coarse)
        z = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            z += table[fine[:, j]]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[coarse[:, a], coarse[:, b]]
        return _sigmoid(z)


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """Values per bin of a tree with two cuts: the best cut, then the best one inside either part."""

    def best_cut(lo: int, hi: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[lo:hi])[:-1], np.cumsum(hess[lo:hi])[:-1]
        if not len(g):
            return 0.0, hi
        total_g, total_h = grad[lo:hi].sum(), hess[lo:hi].sum()
        gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    edges = [0, len(grad)]
    for _ in range(2):
        found = [best_cut(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        gain, cut = max(found)
        if gain <= 1e-9:
            break
        edges = sorted({*edges, cut})
    out = np.zeros(len(grad))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6,
    ridge: float = 1.0,
) -> AdditiveModel:
    """Fit to rows of features and labels 0 or 1."""
    n, d = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(
        [_cuts(x[:, j], bins) for j in range(d)], [], [], [_cuts(x[:, j], 8) for j in range(d)], [],
        float(np.log(share / (1 - share))),
    )
    fine, coarse = model.binned(x, model.cuts), model.binned(x, model.coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(n, model.start)
    for _ in range(rounds):
        for j in range(d):
            p = _sigmoid(z)
            size = len(model.tables[j])
            grad = np.bincount(fine[:, j], weights=y - p, minlength=size)
            step = rate * _tree(grad, np.bincount(fine[:, j], weights=p * (1 - p), minlength=size), ridge)
            model.tables[j] += step
            z += step[fine[:, j]]
    p = _sigmoid(z)
    gains = []
    sizes = [len(c) + 1 for c in model.coarse]
    for a in range(d):
        for b in range(a + 1, d):
            cell = coarse[:, a] * sizes[b] + coarse[:, b]
            grad = np.bincount(cell, weights=y - p, minlength=sizes[a] * sizes[b])
            hess = np.bincount(cell, weights=p * (1 - p), minlength=sizes[a] * sizes[b])
            gains.append((float((grad * grad / (hess + ridge)).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.grids = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(rounds // 4):
        for k, (a, b) in enumerate(model.pairs):
            p = _sigmoid(z)
            cell = coarse[:, a] * sizes[b] + coarse[:, b]
            grad = np.bincount(cell, weights=y - p, minlength=sizes[a] * sizes[b])
            hess = np.bincount(cell, weights=p * (1 - p), minlength=sizes[a] * sizes[b])
            step = (rate * grad / (hess + ridge)).reshape(sizes[a], sizes[b])
            model.grids[k] += step
            z += step.ravel()[cell]
    return model


def train(
    features: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", max_labelled: int = 40_000
) -> AdditiveModel | None:
    """Fit on the labelled rows of `features`; None when a class is missing."""
    known = one_label(labels, id_column, label).orderBy(F.xxhash64(id_column), id_column).limit(max_labelled)
    rows = features.dropDuplicates([id_column]).join(known, id_column).orderBy(id_column).select("x", label)
    found = rows.collect()  # `max_labelled` rows of features
    y = np.array([r[label] for r in found], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r["x"] for r in found]), y)


def score_column(model: AdditiveModel | None, x: Column | str) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf(T.DoubleType())
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(values.to_numpy())) if len(values) else [], dtype="float64")

    return score(x)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every document; `labels` are those to learn from."""
    features = written(add_features(docs, id_column, text))
    model = train(features, labels, id_column)
    return features.select(id_column, score_column(model, F.col("x")).alias("score"))
