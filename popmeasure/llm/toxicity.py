"""Toxicity by a subsequence-kernel support vector machine on Nystroem landmarks.

Kernel: two strings are compared by their common subsequences of `length` characters; each occurrence counts
decay ** (characters it spans in both strings), so a gap or an inserted character costs a factor and does not hide a
word. Values are normalised by the strings' own.

A sentence is the bag of its tokens: text is lowered, ASCII punctuation inside and around words is deleted, words are cut
at white space, and three or more single characters in a row, whatever white space and punctuation stands between them,
are one token more. Text is seen through these tokens only: a word split into pieces of several characters (`id iot`) and
an insult of several ordinary words are not found. A token of over 24 characters is viewed
through windows of 24 that overlap by 12. A sentence is as toxic as its worst token, a document as its worst sentence.

Training takes at most `max_labelled` labelled documents of either class (those with the smallest hash of their id).
Every sentence of a clean document is a negative bag, a toxic document has at least one positive sentence. Spark counts
in how many documents of either class a token occurs. Tokens that only toxic documents share are the first positive
ones, further rounds add the clean tokens that score highest (at most `max_tokens` each time). Landmarks are positive
tokens chosen farthest first; a token's features are its kernel values with them, whitened. A linear support vector
machine is fitted on the features, and a logistic curve maps a document's highest token score to a probability.

Scoring computes a distinct token once per worker and keeps its score, at most `_MEMO` of them.

Defined results: a null, empty or tokenless text scores as the lowest margin; without both classes among the labels
every document scores 0. Repeated documents score alike; of contradicting labels the smaller counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popmeasure.llm.common import one_label, written
from popmeasure.llm.words import gathered, texts

WIDTH, OVERLAP = 24, 12
_MEMO = 1_500_000
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SINGLE = rb"(?:[^\s\x80-\xff]|[\xc2-\xf4][\x80-\xbf]+)"
_SINGLES = re.compile(rb"(?<!\S)" + _SINGLE + rb"(?:\s+" + _SINGLE + rb"){2,}(?!\S)")


def tokens_of(text: str | None) -> list[str]:
    """Distinct tokens of a text."""
    if not text:
        return []
    raw = text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION)
    found = set(raw.split())
    if _SINGLES.search(raw):
        found.update(re.sub(rb"\s", b"", run) for run in _SINGLES.findall(raw))
    return [t.decode("utf-8", "surrogatepass") for t in found]


def views(token: str) -> list[str]:
    """The token, or windows over a long one."""
    if len(token) <= WIDTH:
        return [token]
    return [token[i : i + WIDTH] for i in range(0, len(token) - OVERLAP, OVERLAP)]


def _as_points(strings: list[str], size: int) -> np.ndarray:
    joined = "".join(strings)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), size)


@cache
def _places(size: int, length: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """All choices of `length` places among `size`, and the weight of each: decay ** characters spanned."""
    chosen = np.array(list(combinations(range(size), length)), dtype=np.int64).reshape(-1, length)
    return chosen, decay ** (chosen[:, -1] - chosen[:, 0] + 1.0)


def subsequences(strings: list[str], length: int, decay: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows, codes, weights) of strings of one size: the subsequences of each, and the weights they all have.

    A code has 16 bits for each character, so `length` is 4 at most.
    """
    sizes = np.array([len(s) for s in strings])
    for size in np.unique(sizes[sizes >= length]).tolist():
        chosen, weights = _places(size, length, decay)
        where = np.flatnonzero(sizes == size)
        step = max(1, 400_000 // len(chosen))
        for lo in range(0, len(where), step):
            rows = where[lo : lo + step]
            points = (_as_points([strings[i] for i in rows], size) & 0xFFFF).astype(np.int64)
            codes = points[:, chosen[:, 0]]
            for k in range(1, length):
                codes = (codes << 16) | points[:, chosen[:, k]]
            yield rows, codes, weights


def self_kernel(strings: list[str], length: int = 3, decay: float = 0.6) -> np.ndarray:
    """Kernel of each string with itself: the sum of squares over its distinct subsequences' weights."""
    out = np.zeros(len(strings))
    for rows, codes, weights in subsequences(strings, length, decay):
        order = np.argsort(codes, axis=1)
        codes, each = np.take_along_axis(codes, order, axis=1), weights[order]
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(each.ravel(), starts)
        out[rows] = np.bincount(starts // codes.shape[1], weights=sums * sums, minlength=len(rows))
    return out


class Features:
    """The subsequences of some strings as columns, each string scaled to norm one."""

    def __init__(self, strings: list[str], length: int, decay: float):
        found: dict[tuple[int, int], float] = {}
        for rows, codes, weights in subsequences(strings, length, decay):
            for k, row in enumerate(rows.tolist()):
                for code, weight in zip(codes[k].tolist(), weights.tolist(), strict=True):
                    found[code, row] = found.get((code, row), 0.0) + weight
        self.length, self.decay = length, decay
        self.codes = np.array(sorted({c for c, _ in found}), np.int64)
        self.table = np.zeros((len(self.codes) + 1, len(strings)))  # the last row is for any other subsequence
        for (code, row), value in found.items():
            self.table[np.searchsorted(self.codes, code), row] = value
        self.table /= np.maximum(np.linalg.norm(self.table, axis=0), 1e-12)

    def sums(self, strings: list[str], columns: np.ndarray) -> np.ndarray:
        """For each string, normalised, the weighted sum of the rows of `columns` (one row per code) it contains."""
        out = np.zeros((len(strings), columns.shape[1]))
        for rows, codes, weights in subsequences(strings, self.length, self.decay):
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            hit = self.codes[at] == codes
            row, place = np.nonzero(hit)
            values = columns[at[row, place]] * weights[place][:, None]
            block = np.zeros((len(rows), columns.shape[1]))
            if len(row):
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                block[row[starts]] = np.add.reduceat(values, starts, axis=0)
            out[rows] = block
        touched = np.flatnonzero(out.any(axis=1))  # a string without any of the subsequences stays zero
        own = self_kernel([strings[i] for i in touched], self.length, self.decay)
        out[touched] /= np.sqrt(own)[:, None]
        return out


def normalised_kernel(strings: list[str], others: list[str], length: int = 3, decay: float = 0.6) -> np.ndarray:
    features = Features(others, length, decay)
    return features.sums(strings, features.table)


@dataclass
class SubsequenceSVM:
    features: Features
    whitening: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    length: int = 3
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    FLOOR = -3.0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def margins(self, tokens: list[str]) -> np.ndarray:
        """Margin of each token: its highest view's; tokens shorter than the subsequences have the floor."""
        seen = [views(t) for t in tokens]
        flat = [v for vs in seen for v in vs]
        long_enough = [i for i, v in enumerate(flat) if len(v) >= self.length]
        values = np.full(len(flat), self.FLOOR, np.float64)
        if long_enough:
            columns = (self.features.table @ (self.whitening @ self.weights))[:, None]
            values[long_enough] = self.features.sums([flat[i] for i in long_enough], columns)[:, 0] + self.bias
        starts = np.cumsum([0] + [len(vs) for vs in seen[:-1]]) if seen else np.empty(0, np.int64)
        return np.maximum(np.maximum.reduceat(values, starts), self.FLOOR) if seen else np.empty(0)

    def documents(self, values: list[str | None]) -> np.ndarray:
        """Highest margin of each text."""
        bags = [tokens_of(v) for v in values]
        if len(self.memo) > _MEMO:
            self.memo.clear()
        new = list({t for bag in bags for t in bag if t not in self.memo})
        self.memo.update(zip(new, self.margins(new).tolist(), strict=True))
        get = self.memo.__getitem__
        return np.array([max(map(get, bag), default=self.FLOOR) for bag in bags])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit_linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, steps: int = 400):
    """Squared-hinge linear SVM by Newton steps on the active points; `y` is +1 or -1. Returns (weights, bias)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([reg] * x.shape[1] + [1e-9])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        active = y * (z @ w) < 1
        if not active.any():
            break
        a = z[active] * weight[active][:, None]
        new = np.linalg.solve(ridge + a.T @ z[active] / len(x), a.T @ y[active] / len(x))
        if np.allclose(new, w, atol=1e-8):
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def farthest_first(tokens: list[str], count: int, length: int, decay: float) -> list[str]:
    """Tokens that cover the others: each new one is the least similar to those chosen before."""
    features = Features(tokens, length, decay)
    chosen, nearest = [0], features.table.T @ features.table[:, 0]
    while len(chosen) < min(count, len(tokens)):
        k = int(nearest.argmin())
        if nearest[k] > 0.999:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, features.table.T @ features.table[:, k])
    return [tokens[k] for k in chosen]


def fit_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, 0 or 1), by damped Newton steps."""
    target = np.where(label == 1, 0.99, 0.01)
    z, w = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    ridge = 1e-3 * np.eye(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - target) + ridge @ w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge
        move = np.linalg.solve(hess, grad)
        w = w - move / max(1.0, np.abs(move).max() / 2)
    return float(w[0]), float(w[1])


def _labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, label: str, text: str, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled documents of either class."""
    rows = one_label(labels, id_column, label)
    few = [rows.filter(F.col(label) == c).orderBy(F.xxhash64(id_column), id_column).limit(most) for c in (0, 1)]
    sample = F.broadcast(few[0].unionByName(few[1]).withColumnRenamed(id_column, "__id").withColumnRenamed(label, "y"))
    slim = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("text"))
    return slim.join(sample, "__id").select("text", "y")


def _token_counts(sample: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many sampled documents of either class a token occurs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = (Counter(), Counter())
            for y, value in zip(frame["y"], texts(frame), strict=True):
                counts[y].update({v for t in tokens_of(value) for v in views(t)})
            every = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame(
                {"token": every, "toxic": [counts[1][t] for t in every], "clean": [counts[0][t] for t in every]}
            )

    found = sample.mapInPandas(run, "token string, toxic long, clean long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _witnesses(sample: DataFrame, strong: list[str]) -> list[str]:
    """Few of the tokens `strong`, strongest first, that together occur in the toxic documents.

    A token stays when at least two documents have none of the stronger ones. So the other words of a toxic document
    that was copied many times are not taken for insults.
    """
    rank = {t: k for k, t in enumerate(strong)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [{v for t in tokens_of(value) for v in views(t)} for value in texts(frame)]
            yield pd.DataFrame({"held": [sorted(rank[t] for t in h if t in rank) for h in held]})

    rows = sample.filter("y = 1").mapInPandas(run, "held array<int>").collect()  # one of `max_labelled` rows each
    documents = [set(r["held"]) for r in rows if r["held"]]
    chosen = []
    while documents:
        uncovered = Counter(k for held in documents for k in held)
        best = min(uncovered, key=lambda k: (-uncovered[k], k))
        if uncovered[best] < 2:
            break
        chosen.append(strong[best])
        documents = [held for held in documents if best not in held]
    return chosen


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    label: str = "toxic",
    text: str = "text",
    max_labelled: int = 10_000,
    max_tokens: int = 2_000,
    n_landmarks: int = 64,
    rounds: int = 4,
    length: int = 3,
    decay: float = 0.6,
) -> SubsequenceSVM | None:
    """Fit on the labelled documents among `docs`; None when a class is missing or no token tells the classes apart."""
    sample = written(_labelled_sample(docs, labels, id_column, label, text, max_labelled))
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    counts = written(_token_counts(sample).filter(F.length("token") >= length))
    # log-likelihood ratio against the share of toxic documents; it must beat chance over all tokens
    share = n[1] / (n[0] + n[1])
    both = F.col("toxic") + F.col("clean")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share))
    scored = counts.withColumn("gain", gain).filter(F.col("toxic") > both * (0.5 + share / 2))
    least = float(np.log(max(counts.count(), 2))) + 1
    ranked = scored.filter(F.col("gain") > least).orderBy(F.desc("gain"), "token").limit(max_tokens)
    positive = _witnesses(sample, [r["token"] for r in ranked.collect()])
    if not positive:
        return None
    plain = counts.filter((F.col("clean") > 0) & (F.col("toxic") <= both * (0.5 + share / 2)))
    only_toxic = counts.filter((F.col("clean") == 0) & (F.col("toxic") > 1))
    seen = {r["token"]: r["toxic"] for r in ranked.collect()}
    positives = {t: seen[t] for t in positive}
    chosen = plain.orderBy(F.xxhash64("token"), "token").limit(2 * max_tokens)
    negatives = {r["token"]: r["clean"] for r in chosen.collect()}
    hard: list[str] = []
    for k in range(rounds):
        landmarks = farthest_first(list(positives), n_landmarks, length, decay)
        landmarks += [t for t in hard[:n_landmarks] if t not in set(landmarks)]
        features = Features(landmarks, length, decay)
        values, vectors = np.linalg.eigh(features.table.T @ features.table)
        whitening = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        tokens = [*positives, *negatives]
        parts = [features.sums(tokens[i : i + 500], features.table) for i in range(0, len(tokens), 500)]
        x = np.concatenate(parts) @ whitening  # in parts, as the driver holds every hit of a part
        y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        # a token weighs as the root of the number of documents it is in, the positive ones half as much in all
        up, down = np.sqrt([*positives.values()]), np.sqrt([*negatives.values()])
        weight = np.concatenate([up / up.sum() * down.sum() / 2, down])
        weights, bias = fit_linear_svm(x, y, weight / weight.mean())
        model = SubsequenceSVM(features, whitening, weights, bias, length=length)
        if k + 1 < rounds:
            near = _highest(plain, model, -0.9, max_tokens)
            hard = [t for t, _, _ in sorted(near, key=lambda r: (-(1 + r[1]) * np.log1p(r[2]), r[0]))]
            negatives.update({t: n for t, _, n in near if t not in positives})
            alike = _highest(only_toxic.withColumn("clean", F.col("toxic")), model, 0.0, max_tokens)
            positives.update({t: n for t, _, n in alike if t not in negatives})
    pairs = _document_margins(sample, model)
    model.slope, model.offset = fit_curve(pairs[:, 0], pairs[:, 1])
    return model


def _highest(tokens: DataFrame, model: SubsequenceSVM, over: float, most: int) -> list[tuple[str, float, int]]:
    """(token, margin, number of documents) of the tokens with the highest margins above `over`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames):
            yield frame.assign(m=model.margins(frame["token"].tolist()))

    scored = tokens.select("token", "clean").mapInPandas(run, "token string, clean long, m double")
    rows = scored.filter(F.col("m") > over).orderBy(F.desc("m"), "token").limit(most).collect()
    return [(r["token"], r["m"], r["clean"]) for r in rows]


def _document_margins(sample: DataFrame, model: SubsequenceSVM) -> np.ndarray:
    """(margin, label) of the sampled documents, at most twice `max_labelled` of them."""
    found = sample.select(margin_column(model, "text").alias("m"), F.col("y").cast("double")).collect()
    return np.array([tuple(r) for r in found], dtype=np.float64).reshape(-1, 2)


def margin_column(model: SubsequenceSVM, text: Column | str) -> Column:
    @F.pandas_udf(T.DoubleType())
    def margin(values: pd.Series) -> pd.Series:
        return pd.Series(model.documents([v if isinstance(v, str) else None for v in values]))

    return margin(text)


def probability_column(model: SubsequenceSVM | None, text: Column | str) -> Column:
    """Probability that a text is toxic."""
    if model is None:
        return F.lit(0.0)
    margin = margin_column(model, text)
    return 1 / (1 + F.exp(-(margin * model.slope + model.offset)))
