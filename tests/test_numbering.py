"""Consecutive numbers, levels, full and range joins, chains of rows: against plain Python, with hot and null keys."""

import datetime as dt
import itertools
import random
import re

import pytest
from helpers import plan
from pyspark.sql import functions as F

from popmeasure.operators.episodes import episodes, first_in_gap
from popmeasure.operators.joins import full_join, with_earlier, without_earlier
from popmeasure.operators.levels import level_table, with_level_code
from popmeasure.operators.measures import order_by_measure
from popmeasure.operators.numbering import first_in_file_order, number_in_key, number_rows, number_scan


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def random_rows(seed, n=1200):
    """A third of all rows belongs to one person; persons, groups and dates may be null; dates repeat."""
    rng = random.Random(seed)
    person = lambda: "hot" if rng.random() < 1 / 3 else rng.choice(["a", "b", "c", "d", None])
    return [
        (person(), rng.choice(["x", "y", None]), day(rng.randrange(700)) if rng.random() > 0.05 else None, i)
        for i in range(n)
    ]


SCHEMA = "person string, grp string, ts date, id long"


def nulls_first(*values):
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


@pytest.mark.parametrize("bucket_days", [1, 30, 5000])
def test_number_in_key_equals_sorting(spark, bucket_days):
    rows = random_rows(bucket_days)
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"grp": "bucket"})  # clashes with an inner name
    got = number_in_key(df, ["person", "bucket"], "ts", "id", bucket_days, out="rn").collect()
    want = {}
    rows.sort(key=lambda r: nulls_first(r[0], r[1], r[2], r[3]))
    for _, same in itertools.groupby(rows, key=lambda r: r[:2]):
        want |= {r[3]: k for k, r in enumerate(same, 1)}
    assert {r.id: r.rn for r in got} == want and len(got) == len(rows)


def test_number_in_key_spreads_a_hot_key(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("person"),
        F.date_add(F.lit(day(0)), (F.col("id") % 900).cast("int")).alias("ts"),
        "id",
    )
    out = number_in_key(df, "person", "ts", "id", out="rn")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Join" not in text
    # no window over wide rows has a whole person as its group: the one over a person alone sees counts
    wide = [line for line in text.splitlines() if "row_number()" in line and "Window" in line]
    assert wide and all(re.search(r"\[person#\d+, bucket#\d+L?\]", line) for line in wide)
    hot = [r.rn for r in out.filter("person = 'hot'").orderBy("ts", "id").collect()]
    assert hot == list(range(1, 20_001))


def test_number_in_key_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert number_in_key(empty, "person", "ts").collect() == []
    assert number_rows(empty, ["person", "id"]).collect() == []


def test_gap_rule_numbers_its_rows(spark):
    rows = random_rows(7)
    df = spark.createDataFrame(rows, SCHEMA)
    firsts = first_in_gap(df, ["person", "grp"], "ts", 20, tie="id", number="rn")
    known = df.dropna(subset=["person", "grp", "ts"])
    want = {r.id: r.rn for r in number_in_key(known, ["person", "grp"], "ts", "id", out="rn").collect()}
    got = {r.id: r.rn for r in firsts.collect()}
    keyless = {r[3] for r in rows if None in r[:3]}
    assert keyless and all(got[i] is None for i in keyless)
    assert all(got[i] == want[i] for i in got if i not in keyless) and max(filter(None, got.values())) > 20


def test_number_rows_is_consecutive_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, id long").repartition(7)
    got = number_rows(df, ["k", F.col("at").desc_nulls_last(), "id"], "n")
    assert got.columns == ["k", "at", "id", "n"]
    key = lambda r: (nulls_first(r[0]), (r[1] is None, -(r[1] or 0)), r[2])
    assert [r.id for r in got.orderBy("n").collect()] == [r[2] for r in sorted(rows, key=key)]
    assert sorted(r.n for r in got.collect()) == list(range(1, 3001))
    assert "SinglePartition" not in plan(got) and "Window" not in plan(got)


def test_equal_rows_get_different_numbers(spark):
    got = number_rows(spark.createDataFrame([("a",)] * 50, "k string"), ["k"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 51))


def test_number_scan_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000, numPartitions=6).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    got = number_scan(spark.read.parquet(path), "n")
    assert [(r.id, r.n) for r in got.orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
    text = plan(number_scan(spark.read.parquet(path), "n"))
    assert "SinglePartition" not in text and "hashpartitioning" not in text
    first = first_in_file_order(spark.read.parquet(path).withColumn("file", F.lit("x")), "k").collect()
    assert {(r.k, r.id) for r in first} == {(k, k) for k in range(7)} and first[0].file == "x"
    spark.range(0).write.parquet(str(tmp_path / "e"))
    assert number_scan(spark.read.parquet(str(tmp_path / "e"))).collect() == []


def test_rank_over_the_whole_table(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 5.0), ("d", 2.0)], "k string, v double")
    ranked = order_by_measure(df, "v", desc=True, rank_col="pos", tie="k").collect()
    assert [(r.k, r.pos) for r in ranked] == [("c", 1), ("a", 2), ("d", 3), ("b", 4)]


def test_levels_of_a_column(spark):
    rows = [("b", 1.0), ("a", 9.0), ("b", 3.0), (None, 7.0), ("c", None), ("", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert dict(level_table(df, "k").collect()) == {"": 1, "a": 2, "b": 3, "c": 4}
    assert dict(level_table(df, "k", by="v").collect()) == {"": 1, "b": 2, "a": 3, "c": 4}
    for limit in (0, 100):
        got = with_level_code(df, "k", by="v", desc=True, max_broadcast=limit).collect()
        assert [r.k_level for r in sorted(got, key=lambda r: (r.k is None, r.k, r.v))] == [2, 1, 3, 3, 4, None]
    assert with_level_code(df.limit(0), "k").collect() == []


def python_full_join(left, right):
    out = [(a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0]]
    out += [(a[0], a[1], None) for a in left if all(a[0] != b[0] for b in right)]
    return out + [(b[0], None, b[1]) for b in right if all(a[0] != b[0] for a in left)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: nulls_first(*r))


def test_full_join_multiplies_repeated_keys(spark):
    rng = random.Random(5)
    left = [(rng.choice(["hot", "hot", "a", "b", None]), i) for i in range(60)]
    right = [(rng.choice(["hot", "b", "c", None]), 100 + i) for i in range(30)]
    for a, b in ((left, right), (left, [("z", 1)]), ([], right), (left, []), (left, [(None, 1), (None, 1)])):
        x, y = spark.createDataFrame(a, "k string, v int"), spark.createDataFrame(b, "k string, v int")
        out = full_join(x, y, "k")
        assert out.columns == ["k", "v_x", "v_y"] and order(out.collect()) == order(python_full_join(a, b))
    x, y = spark.createDataFrame([(None, 1)], "k string, v int"), spark.createDataFrame([(None, 2)], "k string, w int")
    assert order(full_join(x, y, "k", null_safe=False).collect()) == [(None, None, 2), (None, 1, None)]


def test_full_join_has_no_full_outer_node(spark):
    x = spark.range(100_000).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    y = spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("w"))
    text = full_join(x, y, "k").hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in text and "LeftAnti" in text and "FullOuter" not in text


@pytest.mark.parametrize("days", [0, 1, 7, 90])
def test_range_join_equals_brute_force(spark, days):
    rows, others = random_rows(days, 300), random_rows(days + 1, 60)
    df, other = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(others, "person string, grp string, at date, no long")

    def preceded(r):
        return None not in r[:3] and any(
            o[:2] == r[:2] and o[2] is not None and 0 <= (r[2] - o[2]).days <= days for o in others
        )

    got = {r.id for r in without_earlier(df, other, ["person", "grp"], "ts", "at", days).collect()}
    assert got == {r[3] for r in rows if not preceded(r)}
    got = with_earlier(df, other, ["person", "grp"], "ts", "at", days)
    assert sorted(r.id for r in got.collect()) == sorted(r[3] for r in rows if preceded(r))
    assert got.columns == df.columns and "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_range_join_of_instants(spark):
    noon = dt.datetime(2020, 1, 1, 12)
    second = dt.timedelta(seconds=1)
    rows = [(i, noon + dt.timedelta(days=90) + s) for i, s in enumerate((-second, 0 * second, second))] + [(3, noon - second)]
    df = spark.createDataFrame([("p", t, i) for i, t in rows], "k string, t timestamp_ntz, id int")
    other = spark.createDataFrame([("p", noon)], "k string, t timestamp_ntz")
    assert {r.id for r in without_earlier(df, other, "k", "t", "t", 90).collect()} == {2, 3}
    with pytest.raises(ValueError, match="between dates"):
        without_earlier(df, other, "k", "t", "t", 0)


def chains(rows, gap):
    out = []
    known = sorted((r for r in rows if None not in r[:3]), key=lambda r: r[:3])
    for key, same in itertools.groupby(known, key=lambda r: r[:2]):
        for r in same:
            if out and out[-1][0] == key and (r[2] - out[-1][2]).days <= gap:
                out[-1][2:] = [r[2], out[-1][3] + 1]
            else:
                out.append([key, r[2], r[2], 1])
    return sorted((*key, a, b, n) for key, a, b, n in out)


@pytest.mark.parametrize("gap", [1, 4, 90])
def test_episodes_equal_brute_force_and_the_gap_rule(spark, gap):
    rows = random_rows(gap, 900)
    df = spark.createDataFrame(rows, SCHEMA)
    got = episodes(df, ["person", "grp"], "ts", gap, count="n")
    assert sorted(tuple(r) for r in got.collect()) == chains(rows, gap)
    known = df.dropna(subset=["person", "grp", "ts"])
    firsts = first_in_gap(known, ["person", "grp"], "ts", gap, tie="id").select("person", "grp", "ts")
    assert order(firsts.collect()) == order(got.select("person", "grp", "start").collect())


def test_episodes_of_instants_end_on_the_last_instant_of_the_gap(spark):
    start, gap = dt.datetime(2020, 3, 20, 12, 0, 0, 7), dt.timedelta(days=90)
    times = [start, start + gap, start + 2 * gap + dt.timedelta(microseconds=1)]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame([("p", t) for t in times], f"k string, t {kind}")
        assert [(r.start, r.end, r.admissions) for r in episodes(df, "k", "t", 90).orderBy("start").collect()] == [
            (times[0], times[1], 2),
            (times[2], times[2], 1),
        ]


def test_episodes_combine_rows_before_they_are_shuffled(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("k"), F.date_add(F.lit(day(0)), (F.col("id") % 400).cast("int")).alias("t"))
    out = episodes(df, "k", "t", 90)
    text = plan(out)
    assert "partial_min" in text and "MergingSessions" in text
    assert [(r.start, r.end, r.admissions) for r in out.collect()] == [(day(0), day(399), 50_000)]
