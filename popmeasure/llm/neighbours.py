"""Nearest vectors by collision counting over sorted projections with query-centred windows.

Vectors are scaled to length one, so the largest cosine is the smallest Euclidean distance. `m` random directions give
every vector `m` projections; each projection is one sorted array. A query's window in an array is centred on its own
projection; virtual rehashing widens all windows in rounds (radius 1, c, c**2 ...). A vector that lies in at least `share * m` windows has passed the
collision threshold and is verified with the exact cosine. A query ends when `k` verified vectors besides its own are nearer
than its radius, when its windows hold all vectors, or at its bound: the distance of the k-th nearest vector that it has
found elsewhere. A query that has a bound starts there: the windows of all rounds before lie inside those of its bound.
Narrow windows are counted by what they hold; wide ones by comparing every vector's place in an array with the window's two
ends, which takes the same time however wide they are.

The index is built in blocks of `block` vectors, queries come in blocks too; a pair of blocks is one task's group, so
memory is bounded whatever the sizes, and every vector is indexed. Blocks are random parts of the vectors and are searched
in waves: the first block, the next ones up to the `WAVE`-th, those up to the `WAVE ** 2`-th and so on. Each wave starts
with the bounds of those before, so nearly all blocks are searched with windows no wider than the k-th neighbour among a
good part of all vectors asks for, and only few vectors pass the threshold there. A bound is never nearer than the k-th
neighbour among all vectors, so nothing that belongs to a result is lost by it. The directions come from the seed; nothing
is fitted to the data.

Equal vectors stand once in the index with their k + 1 smallest ids: no other of them can be among k results.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; vectors of another dimension than the most frequent one do not either. Of rows that repeat an id the smallest vector
counts. Fewer than k candidates are all returned. Equal scores are ordered by id. No other column of the tables is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from popmeasure.llm.common import written

WAVE = 64
TOGETHER = 64  # queries whose windows are looked up at a time
NARROW = 1 / 16  # of an array
_ROUNDING = 1e-6


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): one row per id, with a vector of finite doubles that is not zero and has the usual dimension."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(fine, v).alias("v")).dropna()
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("v") == (size["size"] if size else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def search_block(
    queries: np.ndarray,
    data: np.ndarray,
    bounds: np.ndarray,
    k: int,
    m: int,
    share: float,
    width: float,
    growth: float,
    seed: int,
) -> list[np.ndarray]:
    """For each query the places of the verified vectors of `data`; both are rows of length one.

    At radius r a window reaches `width` standard deviations of the projected difference of vectors r apart.
    No window is wider than that of the query's bound.
    """
    directions = np.random.default_rng(seed).standard_normal((m, data.shape[1]))
    directions /= np.linalg.norm(directions, axis=1)[:, None]
    projected = (data @ directions.T).T
    order = np.argsort(projected, axis=1, kind="stable")
    arrays = np.take_along_axis(projected, order, axis=1)
    place = np.empty(order.shape, np.uint16 if len(data) < 1 << 16 else np.uint32)
    np.put_along_axis(place, order, np.arange(len(data), dtype=place.dtype)[None, :], axis=1)
    out: list[np.ndarray] = []
    for start in range(0, len(queries), TOGETHER):
        part = slice(start, start + TOGETHER)
        out += _expand(queries[part], data, bounds[part], directions, order, arrays, place, k, share, width, growth)
    return out


def window_counts(order: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many windows hold each vector; a window is the places `low` up to `high` of an array."""
    m, n = order.shape
    if (high - low).sum() < NARROW * m * n:
        return np.bincount(np.concatenate([order[i, low[i] : high[i]] for i in range(m)]), minlength=n)
    # below `low` the unsigned difference wraps around to more than any size
    inside = place - low.astype(place.dtype)[:, None] < (high - low).astype(place.dtype)[:, None]
    return inside.sum(axis=0, dtype=np.uint8 if m < 1 << 8 else np.uint32)


def _expand(
    queries: np.ndarray,
    data: np.ndarray,
    bounds: np.ndarray,
    directions: np.ndarray,
    order: np.ndarray,
    arrays: np.ndarray,
    place: np.ndarray,
    k: int,
    share: float,
    width: float,
    growth: float,
) -> list[np.ndarray]:
    m, n = order.shape
    centres, need = queries @ directions.T, max(1, math.ceil(share * m))
    near = [np.empty(0) for _ in queries]
    found = [np.empty(0, np.int64) for _ in queries]
    active, radius = np.arange(len(queries)), 0.25
    while len(active):
        radii = np.where(np.isfinite(bounds[active]), bounds[active], radius)
        half = (width / math.sqrt(data.shape[1]) * radii)[:, None]
        left, right = centres[active] - half, centres[active] + half
        low = np.stack([np.searchsorted(a, left[:, i], "left") for i, a in enumerate(arrays)], axis=1)
        high = np.stack([np.searchsorted(a, right[:, i], "right") for i, a in enumerate(arrays)], axis=1)
        going = []
        for row, j in enumerate(active.tolist()):
            passed = np.flatnonzero(window_counts(order, place, low[row], high[row]) >= need)
            fresh = np.setdiff1d(passed, found[j], assume_unique=True)
            if len(fresh):
                found[j] = passed  # windows only grow
                apart = np.sqrt(np.maximum(2 - 2 * (data[fresh] @ queries[j]), 0))
                near[j] = np.sort(np.concatenate((near[j], apart)))[:k]
            ended = len(near[j]) >= k and near[j][k - 1] <= radii[row]
            if not (ended or radii[row] >= bounds[j] or (high[row] - low[row]).min() >= n):
                going.append(j)
        active, radius = np.array(going, np.int64), radius * growth
    return found


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "embedding",
    m: int = 192,
    share: float = 0.83,
    width: float = 1.5,
    growth: float = 1.2,
    block: int = 8192,
    query_block: int = 16384,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `k` nearest vectors but itself."""
    data = written(usable(vectors, id_column, vector))
    asked = usable(queries, id_column, vector)
    classes = data.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    classes = classes.filter(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(classes)
    asked = written(asked)
    n_classes, n_asked = classes.count(), asked.count()
    blocks, query_blocks = max(1, math.ceil(n_classes / block)), max(1, math.ceil(n_asked / query_block))

    def placed(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n)).cast("int"))

    def search(data_frame: pd.DataFrame, query_frame: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(data_frame) and len(query_frame):
            raw, asked_raw = np.stack(data_frame["v"].to_numpy()), np.stack(query_frame["v"].to_numpy())
            norms, asked_norms = np.sqrt((raw * raw).sum(axis=1)), np.sqrt((asked_raw * asked_raw).sum(axis=1))
            reached = query_frame["reached"].to_numpy(np.float64)  # the k-th score so far
            bounds = np.where(np.isnan(reached), np.inf, np.sqrt(np.maximum(2 - 2 * reached, 0)) + _ROUNDING)
            hits = search_block(
                asked_raw / asked_norms[:, None], raw / norms[:, None], bounds, k + 1, m, share, width, growth, seed
            )
            ids = data_frame["ids"].to_numpy()
            for own, q, q_norm, places in zip(query_frame["id"], asked_raw, asked_norms, hits, strict=True):
                scores = (raw[places] * q).sum(axis=1) / (norms[places] * q_norm)
                if not len(places):
                    continue
                cut = np.sort(scores)[::-1][min(k, len(scores) - 1)]  # the query's own vector may be among them
                best = [(s, p) for s, p in zip(scores.tolist(), places.tolist(), strict=True) if s >= cut]
                listed = sorted((-s, i) for s, p in best for i in ids[p] if i != own)[:k]
                rows["query_id"] += [own] * len(listed)
                rows["vec_id"] += [i for _, i in listed]
                rows["score"] += [-s for s, _ in listed]
        return pd.DataFrame(rows)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    index = placed(classes, "v", "b", blocks)
    questions = placed(asked.select("id", "v"), "id", "qb", query_blocks)
    best, first = None, 0
    while first < blocks:
        last = min(blocks, WAVE * first or 1)  # this wave's blocks: from `first` up to it
        bounded = questions.withColumn("reached", F.lit(None).cast("double"))
        if best is not None:
            reached = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
            bounded = questions.join(reached, "id", "left")
        own = index.filter((F.col("b") >= first) & (F.col("b") < last))
        left = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
        right = bounded.select("*", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("b"))
        found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInPandas(
            search, "query_id long, vec_id long, score double"
        )
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best, first = best_of(found), last
        if first < blocks:
            best = written(best)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
