"""Stored tables: replaced partitions, text files, co-partitioned tables, profiles of two sources."""

import datetime as dt

import pytest
from helpers import plan
from pyspark.sql import functions as F

from popmeasure.operators.checks import column_profile, compare_columns
from popmeasure.operators.matrix import matrix_cells, matrix_margins, matrix_with_margins
from popmeasure.plans import admissions as adm_plans
from popmeasure.sources import bindings as b
from popmeasure.sources.storage import new_path, save_bucketed, shared_folder, stored
from popmeasure.sources.tables import load_table, save_table


def test_stored_rows_and_folder(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    kept = stored(df)
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.schema == df.schema
    assert kept.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_folder(spark).lstrip("/"))


def test_only_the_written_partitions_are_replaced(spark):
    path = new_path(spark)
    rows = spark.createDataFrame([(y, y * 10 + k) for y in (1, 2, None) for k in (1, 2) if y], "year int, v int")
    save_table(rows, path, ["year"])
    save_table(rows.filter("year = 2 AND v = 21").withColumn("v", F.lit(7)), path, ["year"], replace="partitions")
    save_table(rows.limit(0), path, ["year"], replace="partitions")
    back = load_table(spark, path)
    assert {(r.year, r.v) for r in back.collect()} == {(1, 11), (1, 12), (2, 7)}
    assert "PartitionFilters: [isnotnull(year" in plan(back.filter("year = 2"))
    save_table(rows.filter("year = 1"), path, ["year"])  # the whole table again
    assert {r.year for r in load_table(spark, path).collect()} == {1}
    with pytest.raises(ValueError, match="partitioned"):
        save_table(rows, path, replace="partitions")
    with pytest.raises(ValueError, match="replace what"):
        save_table(rows, path, ["year"], replace="rows")


def test_csv_keeps_nulls_and_awkward_texts(spark):
    rows = [(1, "a,b", dt.date(2020, 1, 2)), (2, None, None), (3, "", dt.date(2020, 1, 3)), (4, 'say "x"', None)]
    df, path = spark.createDataFrame(rows, "id int, v string, d date"), new_path(spark)
    save_table(df, path, fmt="csv")
    rows[2] = (3, None, rows[2][2])  # text files do not tell an empty text from none
    assert sorted(tuple(r) for r in load_table(spark, path, df.schema, "csv").collect()) == rows
    with pytest.raises(ValueError, match="unsupported"):
        save_table(df, path, fmt="xlsx")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_and_group_without_an_exchange(spark, sf, no_broadcast):
    inputs = b.episode_diagnosis(spark, sf), b.episode_geography(spark, sf), b.ethnicity_by_part(spark, sf)
    spells, people = adm_plans.bucketed_inputs(*inputs, b.AREA_CODES, "1996-01-01", "2000-12-31", buckets=4)
    out = adm_plans.cohort_from_buckets(spells, people)
    assert "Exchange" not in plan(out)
    want = adm_plans.admission_cohort(*inputs, b.AREA_CODES, "1996-01-01", "2000-12-31")
    key = lambda rows: sorted(map(str, rows))
    assert key(out.collect()) == key(want.collect()) and out.count() > 50


def test_bucketed_rows_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2)], "k string, v int")
    assert sorted(map(str, save_bucketed(df, "k", 3, ["v"]).collect())) == sorted(map(str, df.collect()))


def test_column_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, None, None)], "a int, b date, c string")
    rows = {r.column_name: tuple(r)[1:] for r in column_profile(df).collect()}
    assert rows == {"a": ("int", 3, 0, 2), "b": ("date", 3, 3, 0), "c": ("string", 3, 1, 2)}
    assert {tuple(r)[2:] for r in column_profile(df.limit(0)).collect()} == {(0, 0, 0)}
    both = {r.column_name: r for r in compare_columns(df, df.select("a", F.lit(1.5).alias("z"))).collect()}
    assert both["a"].second_distinct_values == 2 and both["b"].second_type is None and both["z"].first_rows is None


def test_margins_in_one_pass(spark):
    rows = [("r1", "c1", 1, 2), ("r1", "c1", 0, 3), ("r1", "c2", 4, 5), ("r2", "c2", 1, 9), (None, "c1", 1, 1)]
    df = spark.createDataFrame(rows, "r string, c string, n long, d long")
    out = matrix_with_margins(df, "r", "c", "n", "d")
    got = {(x.margin, x.r, x.c): (x.d, x.n, x.percentage) for x in out.collect()}
    assert got[0, "r1", "c1"] == (5, 1, 20.0) and got[1, "r1", None] == (10, 5, 50.0)
    assert got[0, None, "c1"] == (1, 1, 100.0) and got[1, None, None] == (1, 1, 100.0)  # a null row is a level
    assert got[2, None, "c2"] == (14, 5, 35.7) and got[3, None, None] == (20, 7, 35.0)
    # the same margins as the two-step form where no key is null
    known = df.dropna()
    margins = matrix_margins(matrix_cells(known, "r", "c", "n", "d"), "c", "n", "d")
    one = matrix_with_margins(known, "r", "c", "n", "d").filter("margin = 2").select(*margins.columns)
    assert sorted(one.collect()) == sorted(margins.collect())


def test_margins_expand_cells_and_not_rows(spark):
    df = spark.range(100_000).select(
        (F.col("id") % 3).alias("r"), (F.col("id") % 4).alias("c"), F.lit(1).alias("n"), F.lit(2).alias("d")
    )
    text = plan(matrix_with_margins(df, "r", "c", "n", "d"))
    assert text.count("Expand") == 1 and text.count("Range (") == 1
    assert text.index("Expand") < text.rindex("HashAggregate")  # rows are aggregated below the expansion
