"""Hard negatives by inner product, searched in an R-tree that is packed by sort-tile-recursive order.

An anchor's positives are the rows of its label with the highest integer inner products; its hard negatives for a
positive are the best rows of other labels whose score lies in a window below the positive's score. All is exact.

Index. Rows are range-partitioned by label, by the two coordinates that vary most and by id, so equal vectors and a
label that owns a third of all rows are split like any others. A partition is a tile. Its task sorts the rows of each
label by tiles of three coordinates into pages of `leaf` rows, which are stored; a page knows its minimum bounding box
and its labels, groups of 16 pages form the level above, and so on up to a root.

Search. A box gives each coordinate's interval, and with the anchor's signs an interval for the inner product. The
bounding boxes of the tiles, `TILE_BOXES` bytes of them at most, tell which tiles an anchor has to visit; beyond that
size every anchor visits every tile, with the same result. Anchors go to tiles in blocks of `block` (a stated query set
against all rows, in blocks): the pages of a tile come first in its task and the anchors stream past them, so a task
holds one tile whatever the number of anchors. In a tile a queue gives the node with the highest bound first. A node is
dropped if its interval misses every score window, if all its rows have the wrong label, or if its bound is strictly
below the k-th score found (equal bounds stay: ties go to the smaller id). A tile answers with its k best rows at most,
a window over these few rows per anchor merges them.

In high dimension the boxes overlap and little is dropped: on the 64 coordinates of the test tables a mean of over nine
tenths of the pages is read (README). The result does not depend on it.

Nulls and edges: a row takes no part if its id, label or vector is null, if a component is null or not finite, or if
its vector has another length than most (of equally common lengths the shorter). Of several rows with one id the
smallest by (label, vector) counts, so repeated rows count once. An anchor without a positive has no negatives; an
empty table gives an empty result. Other columns of the table are not read. A component must fit into 32 bits and an
inner product into 53, where doubles are exact; else the job fails and says so.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popmeasure.llm.common import ship, written

LEAF, FANOUT, AT_ONCE = 128, 16, 16
TILE_BOXES = 64 << 20
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def str_order(vectors: np.ndarray, leaf: int, axes: Sequence[int]) -> list[np.ndarray]:
    """Row numbers of the pages: sorted on the first axis and cut into slabs, these on the next one, and so on."""
    pages = -(-len(vectors) // leaf)
    parts = [np.arange(len(vectors))]
    for k, axis in enumerate(axes):
        slabs = max(1, round(pages ** (1 / len(axes))))
        cut = []
        for rows in parts:
            rows = rows[np.argsort(vectors[rows, axis], kind="stable")]
            if k == len(axes) - 1:
                cut += np.array_split(rows, max(1, -(-len(rows) // leaf)))
            else:
                cut += np.array_split(rows, slabs)
        parts = [rows for rows in cut if len(rows)]
    return parts


class Level(NamedTuple):
    """Bounding boxes of the nodes of one height, and the smallest and largest label in each."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def bounds(self, q: np.ndarray, nodes: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that a row in each node can have with `q`."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = self.low[nodes], self.high[nodes]
        return low @ up + high @ down, high @ up + low @ down


class Want:
    """The best `k` rows of a score window; of equal scores the smaller id."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> float:
        """A score below this one is of no use."""
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        use = (scores >= self.least) & (scores <= self.high)
        if use.any():
            scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]


class Tile:
    """The tree over the pages of one tile, in memory."""

    def __init__(self, ids: list[np.ndarray], labels: list[np.ndarray], vectors: list[np.ndarray]):
        leaf, d = max(map(len, ids)), vectors[0].shape[1]
        self.ids = np.zeros((len(ids), leaf), dtype=np.int64)
        self.labels = np.zeros((len(ids), leaf), dtype=np.int64)
        self.there = np.zeros((len(ids), leaf), dtype=bool)
        self.vectors = np.zeros((len(ids), leaf, d))
        for p, (i, lab, v) in enumerate(zip(ids, labels, vectors, strict=True)):
            self.ids[p, : len(i)], self.labels[p, : len(i)], self.vectors[p, : len(i)] = i, lab, v
            self.there[p, : len(i)] = True
        self.largest = max(float(np.abs(v).max()) for v in vectors)
        level = Level(
            np.stack([v.min(axis=0) for v in vectors]).astype(np.float64),
            np.stack([v.max(axis=0) for v in vectors]).astype(np.float64),
            np.array([lab.min() for lab in labels]),
            np.array([lab.max() for lab in labels]),
        )
        self.levels = [level]
        while len(level.low) > FANOUT:
            at = np.arange(0, len(level.low), FANOUT)
            level = Level(
                np.minimum.reduceat(level.low, at),
                np.maximum.reduceat(level.high, at),
                np.minimum.reduceat(level.first, at),
                np.maximum.reduceat(level.last, at),
            )
            self.levels.append(level)
        self.pages_read = 0

    def scores(self, q: np.ndarray, pages: list[int]) -> np.ndarray:
        """Inner products of whole numbers, exact in doubles."""
        return self.vectors[pages] @ q

    def search(self, q: np.ndarray, label: int, same: bool, own: int, wants: list[Want]) -> None:
        """Best first: rows of the label, or of any other label, but not the row `own`."""
        if self.largest * float(np.abs(q).max()) * len(q) >= 2**53:
            raise ValueError("an inner product needs more than 53 bits")
        heap: list[tuple[float, int, int]] = []

        def push(height: int, nodes: np.ndarray) -> None:
            level = self.levels[height]
            low, high = level.bounds(q, nodes)
            first, last = level.first[nodes], level.last[nodes]
            use = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            use &= np.logical_or.reduce([(low <= w.high) & (high >= w.least) for w in wants])
            for node, bound in zip(nodes[use].tolist(), high[use].tolist(), strict=True):
                heapq.heappush(heap, (-bound, height, node))

        top = len(self.levels) - 1
        push(top, np.arange(len(self.levels[top].low)))
        while heap:
            pages: list[int] = []
            while heap and len(pages) < AT_ONCE:
                bound, height, node = heapq.heappop(heap)
                if all(-bound < w.least for w in wants):
                    heap.clear()  # all that follow have lower bounds
                elif height:
                    below = len(self.levels[height - 1].low)
                    push(height - 1, np.arange(node * FANOUT, min(below, (node + 1) * FANOUT)))
                else:
                    pages.append(node)
            if pages:
                self.pages_read += len(pages)
                use = self.there[pages] & ((self.labels[pages] == label) == same) & (self.ids[pages] != own)
                scores, ids = self.scores(q, pages)[use], self.ids[pages][use]
                for w in wants:
                    w.offer(scores, ids)


# --- index ---------------------------------------------------------------------------------------------------------

PAGES = "tile int, page int, n int, first long, last long, low array<int>, high array<int>, ids binary, labels binary, vectors binary"


def _tile_pages(frames: Iterable[pd.DataFrame], leaf: int, axes: Sequence[int]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    held = [f for f in frames if len(f)]
    if not held:
        return
    rows = pd.concat(held)
    vectors = np.array(rows["vector"].tolist(), dtype=np.int64)
    if (np.abs(vectors) >= 2**31).any():
        raise ValueError("a component needs more than 32 bits")
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    tile, page = TaskContext.get().partitionId(), 0
    for label in np.unique(labels).tolist():
        mine = np.flatnonzero(labels == label)
        parts = [mine[p] for p in str_order(vectors[mine], leaf, axes)] if len(mine) >= leaf // 4 else [mine]
        for p in parts:
            v = vectors[p]
            row = (tile, page, len(p), label, label, v.min(axis=0), v.max(axis=0))
            data = (ids[p].astype("<i8").tobytes(), labels[p].astype("<i8").tobytes(), v.astype("<i4").tobytes())
            yield pd.DataFrame([[*row, *data]], columns=[c.split()[0] for c in PAGES.split(", ")])
            page += 1


class Index(NamedTuple):
    pages: DataFrame
    tiles: int
    boxes: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None  # tile, low, high, first, last


def build_index(rows: DataFrame, n: int, d: int, leaf: int = LEAF, tile_rows: int | None = None) -> Index:
    """`rows` holds (id long, label long, vector array<long>), `n` of them with `d` components each."""
    spread = rows.select(F.posexplode("vector").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v"))
    axes = [r.axis for r in spread.orderBy(F.col("v").desc(), "axis").limit(3).collect()]
    tile_rows = tile_rows or min(max(n // 4096, 1024), 1 << 18)
    tiles = max(1, -(-n // tile_rows))
    order = ["label", *[F.get("vector", F.lit(a)) for a in axes[:2]], "id"]
    dealt = rows.repartitionByRange(tiles, *order)
    pages = written(dealt.mapInPandas(lambda frames: _tile_pages(frames, leaf, axes), PAGES))
    low = [F.min(F.get("low", F.lit(i))) for i in range(d)]
    high = [F.max(F.get("high", F.lit(i))) for i in range(d)]
    boxes = None
    if tiles * (2 * d + 3) * 8 <= TILE_BOXES:
        found = pages.groupBy("tile").agg(F.array(*low).alias("low"), F.array(*high).alias("high"), F.min("first"), F.max("last"))
        got = sorted(tuple(r) for r in found.collect())
        columns = list(zip(*got, strict=True)) if got else [[], [], [], [], []]
        boxes = tuple(np.array(c, dtype=np.float64 if 0 < k < 3 else np.int64) for k, c in enumerate(columns))
    return Index(pages, tiles, boxes)


# --- search --------------------------------------------------------------------------------------------------------


def _windows(scores: Sequence[int], low: int, high: int) -> list[tuple[int, int]]:
    """Whole scores s with low * p <= 100 * s <= high * p for each positive score p."""
    return [(-((-low * p) // 100), (high * p) // 100) for p in scores]


def _routes(index: Index, same: bool, low: int, high: int) -> Column:
    """Array of the tiles that an anchor has to visit."""
    if index.boxes is None:
        return F.sequence(F.lit(0), F.lit(index.tiles - 1))
    tiles, *box = index.boxes
    level = Level(*box)

    @F.pandas_udf("array<int>")
    def route(vector: pd.Series, label: pd.Series, scores: pd.Series) -> pd.Series:
        out = []
        for v, lab, found in zip(vector, label, scores, strict=True):
            least, most = level.bounds(np.asarray(v, dtype=np.float64))
            if same:
                use = (level.first <= lab) & (lab <= level.last)
            else:
                use = (level.first != lab) | (level.last != lab)
                spans = _windows([int(s) for s in found], low, high)
                use &= np.logical_or.reduce([(least <= b) & (most >= a) for a, b in spans if a <= b] or [np.zeros(len(tiles), bool)])
            out.append(tiles[use].tolist())
        return pd.Series(out)

    return route("vector", "label", "scores")


WORK = "tile int, block int, kind int, seq long, label long, vector array<long>, positives array<long>, scores array<long>, ids binary, labels binary, vectors binary"
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def _search(batches: Iterable[pa.RecordBatch], d: int, same: bool, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Pages of a tile, then the anchors that visit it; several tiles one after the other."""
    key, tile = None, None
    pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if (r["tile"], r["block"]) != key:
                key, tile, pages = (r["tile"], r["block"]), None, []
            if r["kind"] == 0:
                vectors = np.frombuffer(r["vectors"], "<i4").reshape(-1, d)
                pages.append((np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), vectors))
                continue
            if tile is None:
                tile, pages = Tile(*map(list, zip(*pages, strict=True))), []
            q = np.array(r["vector"], dtype=np.float64)
            if same:
                wants, given = [Want(k)], [(None, None)]
            else:
                given = list(zip(r["positives"], r["scores"], strict=True))
                wants = [Want(k, a, b) for a, b in _windows(r["scores"], low, high)]
            tile.search(q, r["label"], same, r["seq"], wants)
            for want, (positive, score) in zip(wants, given, strict=True):
                found = zip(want.ids.tolist(), want.scores.tolist(), strict=True)
                out += [(r["seq"], positive, score, i, int(s)) for i, s in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)


def _visit(
    index: Index, anchors: DataFrame, d: int, n_anchors: int, same: bool, k: int, low: int, high: int, block: int
) -> DataFrame:
    """FOUND: up to `k` rows of each tile for each anchor, or for each of its positives."""
    blocks = max(1, -(-n_anchors // block))
    pages = index.pages.select(
        "tile",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(0).alias("kind"),
        F.col("page").cast("long").alias("seq"),
        "ids",
        "labels",
        "vectors",
    )
    asks = anchors.select(
        F.explode(_routes(index, same, low, high)).alias("tile"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(1).alias("kind"),
        F.col("id").alias("seq"),
        "label",
        "vector",
        "positives",
        "scores",
    )
    work = pages.unionByName(asks, allowMissingColumns=True).select(*[c.split()[0] for c in WORK.split(", ")])
    parts = min(index.tiles * blocks, 100_000)
    dealt = work.repartition(parts, "tile", "block").sortWithinPartitions("tile", "block", "kind", "seq")
    return dealt.mapInArrow(lambda batches: _search(batches, d, same, k, low, high), FOUND)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The `k` best of each key with their rank; tiles give `k` rows each at most, so a key has few."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def usable(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (id, label, vector, anchor) that take part, stored, with their number and their vectors' length."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    fit = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole & (F.size("vector") > 0))
    one = fit.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*")
    kept = written(
        one.select(
            "id",
            F.col("label").cast("long").alias("label"),
            F.transform("vector", lambda x: x.cast("long")).alias("vector"),
            F.coalesce("anchor", F.lit(False)).alias("anchor"),
        )
    )
    sizes = kept.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.col("n").desc(), "d").limit(1).collect()
    n, d = (common[0].n, common[0].d) if common else (0, 0)
    return kept.filter(F.size("vector") == d), n, d


def mine(
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    leaf: int = LEAF,
    tile_rows: int | None = None,
    block: int = 1 << 16,
) -> DataFrame:
    """RESULT: the hard negatives of each anchor and positive, best first.

    `rows` has id (whole number), label (whole number), vector (array of whole numbers) and anchor (boolean). A negative
    score s belongs to a positive score p if low * p <= 100 * s <= high * p.
    """
    spark = rows.sparkSession
    ship(spark)
    kept, n, d = usable(rows.select(F.col("id").cast("long"), "label", "vector", "anchor"))
    if not n:
        return spark.createDataFrame([], RESULT)
    index = build_index(kept.drop("anchor"), n, d, leaf, tile_rows)
    none = F.array().cast("array<long>")
    anchors = kept.filter("anchor").select("id", "label", "vector")
    asked = anchors.withColumns({"positives": none, "scores": none})
    n_anchors = asked.count()
    near = _best(_visit(index, asked, d, n_anchors, True, positives, low, high, block), ["anchor_id"], positives)
    pairs = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    ready = written(
        anchors.join(pairs, F.col("id") == F.col("anchor_id")).select(
            *anchors.columns, F.col("found.id").alias("positives"), F.col("found.score").alias("scores")
        )
    )
    hard = _best(
        _visit(index, ready, d, n_anchors, False, negatives, low, high, block), ["anchor_id", "positive_id"], negatives
    )
    return hard.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
