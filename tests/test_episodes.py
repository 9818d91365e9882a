import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from popmeasure.operators.episodes import first_in_gap, first_per_key, latest_per_key, with_row_id


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def brute_force(rows, gap):
    """Number the rows of a key by date and id, drop a row at most `gap` days after the one before."""
    kept, last = set(), {}
    for key, group, when, ident in sorted(
        (r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[1], r[2], r[3])
    ):
        before = last.get((key, group))
        if before is None or (when - before).days > gap:
            kept.add(ident)
        last[key, group] = when
    return kept | {r[3] for r in rows if None in r[:3]}


def run(spark, rows, gap, kind="date"):
    df = spark.createDataFrame(rows, f"person string, grp string, ts {kind}, id long")
    return [r.id for r in first_in_gap(df, ["person", "grp"], "ts", gap, tie="id").collect()]


@pytest.mark.parametrize(("gap", "kept"), [(0, True), (89, False), (90, False), (91, True)])
def test_gap_limits(spark, gap, kept):
    rows = [("p", "I20", day(0), 1), ("p", "I20", day(gap), 2), ("p", "I21", day(gap), 3)]
    got = run(spark, rows, 90)
    assert sorted(got) == ([1, 2, 3] if kept and gap else [1, 3])


def test_chain_keeps_the_first_only(spark):
    rows = [("p", "g", day(n), n) for n in (0, 80, 160, 240, 331)]
    assert sorted(run(spark, rows, 90)) == [0, 331]


def test_ties_and_nulls(spark):
    rows = [("p", "g", day(0), 2), ("p", "g", day(0), 1), (None, "g", day(0), 3), (None, "g", day(1), 4)]
    rows += [("p", "g", None, 5), ("q", None, day(0), 6), ("q", None, day(0), 7)]
    assert sorted(run(spark, rows, 90)) == [1, 3, 4, 5, 6, 7]
    assert sorted(run(spark, [(None, "g", day(0), 8)] * 3, 90)) == [8, 8, 8]  # equal rows stay three rows


@pytest.mark.parametrize("gap", [0, 1, 7, 90])
def test_equals_brute_force(spark, gap):
    rng = random.Random(gap)
    rows = [
        (rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["x", "y"]), day(rng.randrange(900)), i)
        for i in range(1500)
    ]
    rows += [("sparse", "x", day(rng.randrange(20000)), 10_000 + i) for i in range(200)]
    got = run(spark, rows, gap)
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, gap)


def test_timestamps_count_the_time_of_day(spark):
    start = dt.datetime(2020, 1, 1, 12)
    rows = [("p", "g", start, 1), ("p", "g", start + dt.timedelta(days=90), 2)]
    rows += [("q", "g", start, 3), ("q", "g", start + dt.timedelta(days=90, seconds=1), 4)]
    assert sorted(run(spark, rows, 90, "timestamp_ntz")) == [1, 3, 4]


def test_repeated_rule_is_stable(spark):
    rows = [("p", "g", day(n % 50), n) for n in range(200)]
    df = spark.createDataFrame(rows, "person string, grp string, ts date, id long")
    once = first_in_gap(df, ["person", "grp"], "ts", 0, tie="id")
    assert sorted(once.collect()) == sorted(first_in_gap(once, ["person", "grp"], "ts", 0, tie="id").collect())


def test_window_group_is_bounded_by_the_calendar(spark):
    """A key with very many rows reaches the window as one row per gap-long bucket."""
    df = spark.range(200_000).select(
        F.lit("hot").alias("person"),
        F.timestamp_seconds(F.col("id") * 157).cast("timestamp_ntz").alias("ts"),
        "id",
    )
    out = first_in_gap(df, "person", "ts", 90, tie="id")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in text and "partial_max" in text
    assert text.count("Range (") == 1  # rows without a key need no second pass
    assert [r.id for r in out.collect()] == [0]


def test_latest_and_first_per_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "w"), (None, 1, "u"), (None, 2, "v")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r.k, r.v) for r in latest_per_key(df, "k", "o").collect()} == {("a", "y"), ("b", "w"), (None, "v")}
    first = first_per_key(df, "k", "o")
    assert first.columns == df.columns
    assert {(r.k, r.v) for r in first.collect()} == {("a", "x"), ("b", "w"), (None, "u")}


def test_row_ids_are_unique(spark):
    df = with_row_id(spark.range(1000, numPartitions=7))
    assert df.select("row_id").distinct().count() == 1000
