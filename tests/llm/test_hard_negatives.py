"""Hard negatives against plain sorting: hot labels, copies, ties, nulls, many labels, several tiles and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popmeasure.llm import hard_negatives as hn
from popmeasure.llm.common import table
from popmeasure.llm.queries import QUERIES


def brute_force(rows, positives=5, negatives=10, low=30, high=90):
    out = set()
    for anchor, label, v, is_anchor in rows:
        if not is_anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, other) for i, other, w, _ in rows if i != anchor)
        for p_score, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(s, i) for s, i, other in scored if other != label and low * -p_score <= 100 * -s <= high * -p_score]
            out |= {(anchor, p, k, i, -p_score, -s) for k, (s, i) in enumerate(inside[:negatives], 1)}
    return out


def made(seed, n, d=6, labels=4, span=20):
    """A third of the rows has label 0, a third of the vectors is one vector, values are few, so scores tie."""
    rng = np.random.default_rng(seed)
    hot = rng.integers(-span, span, d).tolist()
    return [
        (
            i * 3,
            0 if rng.random() < 1 / 3 else int(rng.integers(labels)),
            hot if rng.random() < 1 / 3 else rng.integers(-span, span, d).tolist(),
            bool(i % 5 == 0),
        )
        for i in range(n)
    ]


SCHEMA = "id long, label int, vector array<long>, anchor boolean"


def mined(spark, rows, **options):
    return [tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()]


@pytest.mark.parametrize(
    ("n", "labels", "options"),
    [
        (150, 4, {}),
        (150, 4, {"leaf": 4, "tile_rows": 20, "block": 7}),
        (120, 90, {"leaf": 2, "tile_rows": 30}),
        (80, 1, {"leaf": 8}),
        (100, 3, {"positives": 2, "negatives": 3, "low": -50, "high": 100, "leaf": 5, "tile_rows": 25}),
    ],
)
def test_equals_sorting(spark, n, labels, options):
    rows = made(n + labels, n, labels=labels)
    got = mined(spark, rows, **options)
    rule = {k: v for k, v in options.items() if k in ("positives", "negatives", "low", "high")}
    want = brute_force(rows, **rule)
    assert len(got) == len(set(got)) and set(got) == want and (want or labels == 1)


def test_without_boxes_every_tile_is_visited(spark, monkeypatch):
    rows = made(3, 90)
    monkeypatch.setattr(hn, "TILE_BOXES", 0)
    assert set(mined(spark, rows, leaf=4, tile_rows=20)) == brute_force(rows)


def test_rows_that_take_no_part(spark):
    rows = made(5, 60)
    bad = [(1000, None, [1] * 6, True), (None, 1, [1] * 6, True), (1001, 1, None, True), (1002, 1, [1, None, 1, 1, 1, 1], True)]
    bad += [(1003, 1, [1, 2], True), (1004, 1, [], False), (1005, 2, [1] * 7, None)]
    repeated = [rows[0], rows[7], rows[7]]
    assert set(mined(spark, rows + bad + repeated)) == brute_force(rows)


def test_of_two_rows_with_one_id_the_smaller_counts(spark):
    rows = made(6, 40)
    first = rows[0]
    assert set(mined(spark, [*rows, (first[0], 99, first[2], True)])) == brute_force(rows)


def test_no_rows_no_anchors_no_positives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1, 2], False), (2, 1, [3, 4], False)]) == []
    assert mined(spark, [(1, 1, [1, 2], True), (2, 2, [3, 4], None)]) == []


def test_clashing_columns(spark):
    rows = made(8, 50)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, tile string, rank int")
    assert {tuple(r) for r in hn.mine(df).collect()} == brute_force(rows)


def test_numbers_too_large_to_be_exact(spark):
    rows = [(1, 1, [1 << 30] * 4, True), (2, 1, [1 << 30] * 4, False)]
    with pytest.raises(Exception, match="53 bits"):
        mined(spark, rows)
    with pytest.raises(Exception, match="32 bits"):
        mined(spark, [(1, 1, [1 << 40], True)])


def test_boxes_prune_clustered_vectors():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (40, 3))
    vectors = (centres[rng.integers(40, size=8000)] + rng.integers(-20, 20, (8000, 3))).astype(np.int64)
    parts = hn.str_order(vectors, 64, [0, 1, 2])
    assert sorted(np.concatenate(parts).tolist()) == list(range(8000)) and max(map(len, parts)) <= 64
    tile = hn.Tile(parts, [np.zeros(len(p), np.int64) for p in parts], [vectors[p] for p in parts])
    assert len(tile.levels) > 1
    q, want = vectors[5].astype(float), hn.Want(10)
    tile.search(q, 0, True, 5, [want])
    scores = vectors @ vectors[5]
    best = [i for i in np.lexsort((np.arange(8000), -scores)).tolist() if i != 5][:10]
    assert want.ids.tolist() == best and tile.pages_read <= len(parts) / 3
    # a window far from what the tile holds is answered by the root
    before = tile.pages_read
    tile.search(q, 0, True, 5, [hn.Want(10, 1e12, 2e12)])
    assert tile.pages_read == before


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (300, 8))
    parts = hn.str_order(vectors, 16, [2, 5, 1])
    tile = hn.Tile(parts, [np.zeros(len(p), np.int64) for p in parts], [vectors[p] for p in parts])
    for q in rng.integers(-50, 50, (20, 8)).astype(float):
        low, high = tile.levels[0].bounds(q)
        for k, p in enumerate(parts):
            scores = vectors[p] @ q
            assert low[k] <= scores.min() and scores.max() <= high[k]


def test_query_equals_sorting(spark, sf):
    got = QUERIES["op13_hard_negatives"](spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = []
    for r in table(spark, sf, "embeddings").collect():
        v = np.array(r.embedding, dtype=np.float64)
        if r.label is not None and np.isfinite(v).all():
            label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
            rows.append((r.vec_id, label, np.floor(256 * v).astype(int).tolist(), r.vec_id % 100 == 0))
    assert {tuple(r) for r in got.collect()} == brute_force(rows)
    assert got.filter(F.col("rank") > 10).count() == 0
