import math
import random
import re

import pytest
from helpers import plan
from pyspark.sql import functions as F

from popmeasure.operators.breakdown import by_area, by_characteristic, proportion_by_characteristic
from popmeasure.operators.checks import crosstab_counts, null_report
from popmeasure.operators.compare import shares_long, side_by_side
from popmeasure.operators.enrich import duplicate_keys, enrich, map_labels
from popmeasure.operators.extract import any_code_filter, exclude, extract_admissions, extract_deaths, usable_ethnicity
from popmeasure.operators.matrix import matrix_cells, matrix_margins, matrix_wide
from popmeasure.operators.measures import (
    max_group_total,
    order_by_measure,
    population_totals,
    proportion,
    share_of_total,
    with_group_mean,
    yearly_count,
    yearly_yll,
)
from popmeasure.operators.reshape import (
    distinct_causes,
    distinct_causes_in_row,
    distinct_wide,
    explode_causes,
    primary_cause,
    recode,
    unpivot_measures,
)
from popmeasure.operators.standardise import dsr, join_population, rate_gaps, rate_inputs, regroup
from popmeasure.plans.admissions import in_person_order, numbered_admissions
from popmeasure.sources.constants import FIVE_YEAR_BANDS, STANDARD_POPULATION
from popmeasure.sources.schemas import CAUSE_COLUMNS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


# --- joins ---------------------------------------------------------------------------------------------------------


def test_null_keys_match_only_when_asked(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "k string")
    lookup = spark.createDataFrame([("a", 1), (None, 2)], "code string, v int")
    assert rows(enrich(df, lookup, {"k": "code"})) == [("a", 1), ("z", None), (None, 2)]
    assert rows(enrich(df, lookup, {"k": "code"}, null_safe=False)) == [("a", 1), ("z", None), (None, None)]


def test_lookup_guards(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    lookup = spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    assert rows(duplicate_keys(lookup, "k")) == [("a", 2)]
    assert enrich(df, lookup, "k").count() == 2
    with pytest.raises(ValueError, match="not unique"):
        enrich(df, lookup, "k", require_unique=True)
    with pytest.raises(ValueError, match="both sides"):
        enrich(df, lookup.withColumnRenamed("w", "v"), "k")
    with pytest.raises(ValueError, match="salt_by"):
        enrich(df, lookup, "k", salts=4)


def test_salted_join_is_the_same_join(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("7", 2)], "code string, v int")
    plain = enrich(df, lookup, {"k": "code"}, null_safe=False)
    salted = enrich(df, lookup, {"k": "code"}, null_safe=False, salts=8, salt_by="id")
    assert plain.columns == salted.columns and rows(plain) == rows(salted)


def test_copies_of_a_salted_lookup_are_not_broadcast(spark, tmp_path):
    """Its files are small, its copies need not be: Spark sizes both alike, and a broadcast of them ends the driver."""
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    spark.range(5).selectExpr("id AS code", "id * 10 AS v").write.parquet(str(tmp_path / "lookup"))
    lookup = spark.read.parquet(str(tmp_path / "lookup"))
    salted = enrich(df, lookup, {"k": "code"}, null_safe=False, salts=8, salt_by="id")
    text = plan(salted)
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text
    assert "BroadcastExchange" in plan(enrich(df, lookup, {"k": "code"}, null_safe=False))  # no salt, no copies
    assert rows(salted) == rows(df.selectExpr("id", "k", "if(k < 5, k * 10, NULL) AS v"))


def test_large_lookup_is_not_broadcast_and_its_hot_key_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(60_000, numPartitions=8).select(
            "id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k")
        )
        lookup = spark.range(5_000).select("id", (F.col("id") * 2).alias("v")).withColumnRenamed("id", "code")
        out = enrich(df, lookup, {"k": "code"})
        text = plan(out)
        assert "SortMergeJoin(skew=true)" in text and "BroadcastHashJoin" not in text
        assert out.count() == 60_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_map_labels(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "census string")
    mapping = spark.createDataFrame([("x", "X")], "old string, new string")
    assert rows(map_labels(df, "census", mapping, "label")) == [("x", "X"), ("y", None), (None, None)]


# --- extracts ------------------------------------------------------------------------------------------------------


def diagnosis(**change):
    import datetime as dt

    row = dict(
        episode_id=1, nhs_number="p", diagnosis_code="I251", diagnosis_order=1, order_in_spell=1, provider_code="a",
        provider_name="A", gender="Male", age_on_admission=50, admission_date=dt.date(2019, 1, 1),
        admission_source_code="1", admission_source_description="s", admission_method_code="2",
        admission_method_description="m",
    )
    return {**row, **change}


def test_extract_admissions_conditions(spark):
    import datetime as dt

    from popmeasure.sources.schemas import schema_of

    cases = [
        diagnosis(),
        diagnosis(episode_id=2, diagnosis_code="J10"),
        diagnosis(episode_id=3, diagnosis_order=2),
        diagnosis(episode_id=4, order_in_spell=2),
        diagnosis(episode_id=5, admission_date=dt.date(2018, 3, 31)),
        diagnosis(episode_id=6, admission_date=dt.date(2018, 4, 1)),
        diagnosis(episode_id=7, admission_date=dt.date(2024, 3, 31)),
        diagnosis(episode_id=8, admission_date=dt.date(2024, 4, 1)),
        diagnosis(episode_id=9, nhs_number=None),
        diagnosis(episode_id=10),  # no geography
        diagnosis(episode_id=11),  # other area
        diagnosis(episode_id=12, nhs_number="unknown", diagnosis_code="I2"),
    ]
    schema = schema_of("episode_diagnosis")
    diag = spark.createDataFrame([tuple(c[f] for f in schema.names) for c in cases], schema)
    geo = spark.createDataFrame(
        [(i, "E2" if i == 11 else "E1", "c", "l1", "l2", "g") for i in range(1, 13) if i != 10],
        schema_of("episode_geography"),
    )
    eth = spark.createDataFrame([("p", "A", "White", 0), ("p", "B", "Other", 0)], schema_of("ethnicity"))
    out = extract_admissions(diag, geo, eth, ["E1"], keep=("episode_id",))
    got = sorted((r.episode_id, r.diagnosis_group, r.ethnic_code) for r in out.collect() if r.ethnic_code != "B")
    assert got == [(1, "I25", "A"), (6, "I25", "A"), (7, "I25", "A"), (12, "I2", None)]
    assert out.count() == 7  # a person listed twice doubles the rows


def stored_extract_inputs(spark, folder):
    """Diagnoses, geography and ethnicity in small files; person "p" has 30 spells on 15 days, "q" one."""
    import datetime as dt

    from popmeasure.sources.schemas import schema_of

    cases = [diagnosis(episode_id=i, admission_date=dt.date(2019, 1, 1 + i // 2)) for i in range(30)]
    cases.append(diagnosis(episode_id=30, nhs_number="q"))
    schema = schema_of("episode_diagnosis")
    tables = {
        "diagnosis": spark.createDataFrame([tuple(c[f] for f in schema.names) for c in cases], schema),
        "geography": spark.createDataFrame([(i, "E1", "c", "l1", "l2", "g") for i in range(31)], schema_of("episode_geography")),
        "ethnicity": spark.createDataFrame([("p", "A", "White", 0)], schema_of("ethnicity")),
    }
    for name, df in tables.items():
        df.write.parquet(str(folder / name))
    return [spark.read.parquet(str(folder / name)) for name in tables]


def person_joins(df):
    return set(re.findall(r"(\w+Join) \[nhs_number#\d+, __salt#\d+\]", plan(df)))


def test_numbered_admissions_do_not_broadcast_copies_of_the_people(spark, tmp_path):
    out = numbered_admissions(*stored_extract_inputs(spark, tmp_path), ["E1"], salts=8)
    assert person_joins(out) == {"SortMergeJoin"}
    assert rows(out.select("episode_id", "ethnic_code", "rn")) == sorted(
        [(i, "A", i + 1) for i in range(30)] + [(30, None, 1)], key=lambda t: tuple((v is None, str(v)) for v in t)
    )


def test_ordered_extract_does_not_broadcast_copies_of_the_people(spark, tmp_path):
    out = in_person_order(extract_admissions(*stored_extract_inputs(spark, tmp_path), ["E1"], keep=("episode_id",), salts=8))
    assert person_joins(out) == {"SortMergeJoin"}
    assert [(r.episode_id, r.ethnic_code) for r in out.collect()] == [(i, "A") for i in range(30)] + [(30, None)]


def test_extract_deaths_and_any_code(spark):
    import datetime as dt

    from popmeasure.sources.schemas import schema_of

    schema = schema_of("deaths_register")

    def death(pid, date, la="E1", **codes):
        row = dict.fromkeys(schema.names)
        row.update(patient_id=pid, reg_date=date, residence_la_code=la, **codes)
        return tuple(row[f] for f in schema.names)

    data = [
        death("a", dt.date(2013, 12, 31), s_underlying_cod_icd10="I20"),
        death("b", dt.date(2014, 1, 1), s_underlying_cod_icd10="J20", s_cod_code_15="I10"),
        death("c", dt.date(2023, 12, 31), s_underlying_cod_icd10="I21"),
        death("d", dt.date(2024, 1, 1), s_underlying_cod_icd10="I21"),
        death("e", dt.date(2020, 1, 1), s_underlying_cod_icd10="J21"),
        death("f", dt.date(2020, 1, 1)),
        death("g", dt.date(2020, 1, 1), la="E9", s_underlying_cod_icd10="I21"),
    ]
    eth = spark.createDataFrame([("b", "A", "White", 1)], schema_of("ethnicity"))
    deaths = extract_deaths(spark.createDataFrame(data, schema), eth, ["E1"])
    assert sorted(r.patient_id for r in deaths.collect()) == ["b", "c", "e", "f"]
    assert sorted((r.patient_id, r.ethnic_code) for r in any_code_filter(deaths).collect()) == [("b", "A"), ("c", None)]


def test_usable_ethnicity_and_exclude(spark):
    data = [("p", "A", "x"), ("p", "Z", "x"), ("p", None, "x"), ("p", "A", ""), ("p", "A", None), (None, "A", "x")]
    df = spark.createDataFrame(data, "pseudo_nhs_number string, ethnic_code string, ethnicity_category string")
    assert rows(usable_ethnicity(df)) == [("p", "A", "x")]
    df = spark.createDataFrame([("Not CVD",), ("Stroke",), (None,)], "g string")
    assert rows(exclude(df, "g", "Not CVD")) == [("Stroke",)]


# --- reshape -------------------------------------------------------------------------------------------------------


def test_causes(spark):
    cols = CAUSE_COLUMNS[:4]
    data = [(1, "I251", "I259", None, "NULL"), (2, "I2", "J10", "XI50", "I50")]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} string" for c in cols))
    long = explode_causes(df)
    assert rows(long.select("id", "icd10_code")) == [
        (1, "I251"), (1, "I259"), (2, "I2"), (2, "I50"), (2, "J10"), (2, "XI50"),
    ]
    assert rows(primary_cause(long, CAUSE_COLUMNS[0]).select("id", "icd10_code")) == [(1, "I251"), (2, "I2")]
    assert rows(explode_causes(df, prefix="J").select("icd10_code")) == [("J10",)]
    coded = long.withColumn("sub", F.substring("icd10_code", 1, 3))
    assert rows(distinct_causes(coded)) == [(1, "I25"), (2, "I2"), (2, "I50"), (2, "J10"), (2, "XI5")]
    assert rows(distinct_causes_in_row(df, cols)) == [
        (1, "I25", "Ischaemic heart diseases"),
        (2, "I50", "Other forms of heart disease"),
    ]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_wide_distinct_equals_distinct(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 0.0, -0.0, 1.5, float("nan")]), rng.randrange(3)) for _ in range(200)]
    rows += [("hot", 1.0, 1)] * 300 + [("once", None, k) for k in range(50)] + [(None, None, 7), (None, None, None)]
    df = spark.createDataFrame(rows, "k string, v double, n int").repartition(4)
    assert sorted(map(str, distinct_wide(df, limit).collect())) == sorted(map(str, df.distinct().collect()))
    assert distinct_wide(df.limit(0), limit).collect() == []


def test_wide_distinct_keeps_rows_whose_hashes_collide(spark):
    """Nulls do not change the hash, so these rows share one; they are compared whole."""
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None)], "a string, b string")
    assert df.select(F.xxhash64("a", "b")).distinct().count() == 1
    assert sorted(map(str, distinct_wide(df).collect())) == ["Row(a='x', b=None)", "Row(a=None, b='x')"]


def test_wide_distinct_shuffles_repeated_rows_only(spark):
    df = spark.range(5000).select((F.col("id") % 4990).alias("k"), F.repeat(F.lit("w"), 200).alias("wide"))
    text = plan(distinct_wide(df))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1 and "LeftSemi" in text


def test_distinct_in_row_keeps_the_group_of_the_full_code(spark):
    import itertools
    import random
    import re

    from test_functions import PATTERNS

    from popmeasure.plans.prepare import all_cause_deaths

    pool = ["I20", "I20I50", "I201", "I99", "I99I51", "I99I52", "I60", "I60I50", "II50", "I5", "I50", "I501", "I512"]
    pool += ["I55I50", "I55", "J20", "JI50", "NULL", "I4", None, "I291", "I29", "I31I51"]
    rng = random.Random(1)
    data = [(i, *rng.sample(pool, 4)) for i in range(300)]
    data += [(1000 + i, a, b, None, None) for i, (a, b) in enumerate(itertools.product(pool, pool))]
    df = spark.createDataFrame(data, "id int, a_cod_1 string, a_cod_2 string, a_cod_3 string, a_cod_4 string")
    want = {
        (row[0], c[:3], next((label for p, label in PATTERNS if re.search(p, c)), None))
        for row in data
        for c in row[1:]
        if c and c.startswith("I") and len(c) >= 3
    }
    got = rows(distinct_causes_in_row(df, df.columns[1:]))
    assert len(got) == len(want) and set(got) == want
    both = all_cause_deaths(df.withColumns({"sex": F.lit(1), "age": F.lit(1)}), person=("id", "sex", "age"))
    assert rows(both.select("id", "icd_subgroup", "cvd_group")) == got


def test_distinct_in_row_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "I20", "I21")], "id int, a_cod_1 string, a_cod_2 string")
    assert "Exchange" not in plan(distinct_causes_in_row(df, ["a_cod_1", "a_cod_2"]))


def test_unpivot_and_recode(spark):
    df = spark.createDataFrame([("g", 1.0, None)], "k string, a double, b double")
    long = recode(unpivot_measures(df, ["a", "b"]), "outcome", {"a": "A"})
    assert rows(long) == [("g", "A", 1.0), ("g", "b", None)]


# --- measures ------------------------------------------------------------------------------------------------------


def test_counts_and_sums(spark):
    df = spark.createDataFrame(
        [("a", 2, 1.0), ("a", 3, None), ("b", 1, 4.0), (None, 1, 1.0)], "k string, w long, yll double"
    )
    assert rows(yearly_count(df, ["k"], 10)) == [("a", 0.2), ("b", 0.1), (None, 0.1)]
    assert rows(yearly_count(df, ["k"], 10, weight="w")) == [("a", 0.5), ("b", 0.1), (None, 0.1)]
    assert rows(yearly_yll(df, ["k"], 10)) == [("a", None), ("b", 0.4), (None, 0.1)]
    assert rows(population_totals(df, ["k"], "w", "p")) == [("a", 5), ("b", 1), (None, 1)]


def test_proportion_counts_null_flags_in_the_total(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "k string, f boolean")
    got = rows(proportion(df, ["k"], "f"))
    assert got[0][:3] == ("a", 3, 1) and math.isclose(got[0][3], 100 / 3) and got[1] == ("b", 1, 0, 0.0)


def test_share_reads_the_base_once(spark, sf):
    from catalog.queries import QUERIES

    for name in ("share_of_deaths_primary_clinical", "share_of_deaths_all_cause_clinical", "grand_total"):
        assert "ReusedExchange" in plan(QUERIES[name](spark, sf)), name
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert rows(share_of_total(df, "k")) == [("a", 2, 4, 50.0), ("b", 1, 4, 25.0), (None, 1, 4, 25.0)]


def test_max_and_mean(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)], "k string, l string, v double")
    assert rows(max_group_total(df, ["k"], "v")) == [(4.0,)]
    assert rows(with_group_mean(df, "l", "v").select("k", "l", "group_mean")) == [
        ("a", "x", 1.5), ("a", "y", 3.0), ("b", "x", 1.5),
    ]
    hole = df.unionByName(spark.createDataFrame([("c", "x", None)], df.schema))
    assert rows(max_group_total(hole, ["k"], "v")) == [(None,)]


def test_order(spark):
    df = spark.createDataFrame([("x", "a", 2), ("x", "b", 1), ("y", "c", 5)], "f string, k string, v int")
    ranked = order_by_measure(df, "v", within="f", rank_col="pos").collect()
    assert [(r.f, r.k, r.pos) for r in ranked] == [("x", "b", 1), ("x", "a", 2), ("y", "c", 1)]
    assert [r.v for r in order_by_measure(df, "v", desc=True).collect()] == [5, 2, 1]



# --- breakdowns ----------------------------------------------------------------------------------------------------


def events(spark):
    data = [
        ("g", "A", "Male", 1, 10.0), ("g", "A", "Female", 1, 5.0), ("g", "B", "Male", None, None),
        ("h", "B", None, 2, 1.0), ("h", None, "Male", 2, 1.0), ("h", "C", "Male", 2, 1.0),
    ]
    return spark.createDataFrame(data, "k string, area string, sex string, imd int, yll double")


def test_by_area(spark):
    areas = {"A": ["A"], "B": ["B"], "Both": ["A", "B"]}
    got = rows(by_area(events(spark), ["k"], "area", areas, 10, yll="yll"))
    assert got == [
        ("g", "A", 0.2, 1.5), ("g", "B", 0.1, None), ("g", "Both", 0.3, None), ("h", "B", 0.1, 0.1),
        ("h", "Both", 0.1, 0.1),
    ]


def test_by_characteristic_tells_null_levels_apart(spark):
    got = rows(by_characteristic(events(spark), ["sex", "imd"], [F.count(F.lit(1)).alias("n")], ["k"]))
    assert got == [
        ("g", "imd", "1", 2), ("g", "imd", None, 1), ("g", "sex", "Female", 1), ("g", "sex", "Male", 2),
        ("h", "imd", "2", 3), ("h", "sex", "Male", 2), ("h", "sex", None, 1),
    ]


def test_levels_add_up_and_the_base_is_read_once(spark, sf):
    from catalog.queries import QUERIES

    out = QUERIES["emergency_by_characteristic"](spark, sf)
    sums = {r.characteristic: r.n for r in out.groupBy("characteristic").agg(F.sum("total_admissions").alias("n")).collect()}
    assert set(sums.values()) == {spark.read.parquet(f"{sf}/orders.parquet").count()}
    assert all(0 <= r.lower_ci <= r.percentage + 1e-9 <= r.upper_ci + 2e-9 <= 100 + 1e-6 for r in out.collect())
    text = plan(out)
    assert text.count("orders.parquet") == 1 and "Python" not in text and "SinglePartition" not in text


def test_proportion_by_characteristic(spark):
    df = spark.createDataFrame([("a", True), ("b", None)], "k string, f boolean")
    got = {r.level: (r.total_admissions, r.emergency_admissions) for r in proportion_by_characteristic(df, ["k"], "f").collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}


# --- rates ---------------------------------------------------------------------------------------------------------


def bands(spark, group, count, population):
    data = [(group, b, float(count(i)), int(population(i))) for i, b in enumerate(FIVE_YEAR_BANDS)]
    return spark.createDataFrame(data, "g string, age_band string, n double, population_count long")


def test_equal_rates_give_the_crude_rate(spark):
    out = dsr(bands(spark, "a", lambda i: 10 + i, lambda i: (10 + i) * 500), ["g"]).first()
    assert math.isclose(out.value, 200.0) and out.lowercl < 200 < out.uppercl
    assert (out.total_count, out.total_pop) == (sum(range(10, 29)), 500 * sum(range(10, 29)))


def test_rate_by_hand(spark):
    def count(i):
        return 3 + (i * 7) % 5

    def population(i):
        return 900 + 13 * i

    out = dsr(bands(spark, "a", count, population), ["g"]).first()
    z, o = 1.959963984540054, sum(count(i) for i in range(19))
    value = sum(w * count(i) / population(i) for i, w in enumerate(STANDARD_POPULATION))
    var = sum((w / population(i)) ** 2 * count(i) for i, w in enumerate(STANDARD_POPULATION)) / 100_000**2
    low = o * (1 - 1 / (9 * o) - z / (3 * math.sqrt(o))) ** 3
    high = (o + 1) * (1 - 1 / (9 * (o + 1)) + z / (3 * math.sqrt(o + 1))) ** 3
    assert math.isclose(out.value, value)
    assert math.isclose(out.lowercl, value + 1e5 * math.sqrt(var / o) * (low - o))
    assert math.isclose(out.uppercl, value + 1e5 * math.sqrt(var / o) * (high - o))


def test_small_counts_and_zero_population(spark):
    small = bands(spark, "small", lambda i: 9.99 if i == 0 else 0, lambda i: 100)
    ten = bands(spark, "ten", lambda i: 10 if i == 0 else 0, lambda i: 100)
    empty = bands(spark, "empty", lambda i: 5, lambda i: 0 if i == 3 else 100)
    got = {r.g: r for r in dsr(small.unionByName(ten).unionByName(empty), ["g"]).collect()}
    assert got["small"].value is None and got["small"].statistic == "dsr NA for total count < 10"
    assert got["ten"].value is not None and got["ten"].statistic == "dsr per 100000"
    assert got["empty"].value is None
    assert rows(rate_gaps(empty, ["g"])) == [("empty", 0, 0, 1)]


def test_unmatched_rows_take_no_part(spark):
    base = bands(spark, "a", lambda i: 10, lambda i: 1000)
    extra = spark.createDataFrame([("a", None, 7.0, 50), ("a", "90+", 3.0, None)], base.schema)
    assert dsr(base.unionByName(extra), ["g"]).first() == dsr(base, ["g"]).first()


def test_joining_populations(spark):
    counts = spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", 3.0)], "k string, n double")
    pop = spark.createDataFrame([("a", 10), (None, 20), ("d", 30)], "k string, population_count long")
    full = [("a", 1.0, 10), ("c", 3.0, None), ("d", None, 30), (None, 2.0, 20)]
    assert rows(join_population(counts, pop, ["k"])) == full
    filled = rows(join_population(counts, pop, ["k"], fill_missing_count=True))
    assert filled == [("a", 1.0, 10), ("c", 3.0, None), ("d", 0.0, 30), (None, 2.0, 20)]


def test_rate_inputs_equal_counting_and_joining(spark):
    people = spark.createDataFrame([("a",), ("a",), (None,), ("c",)], "k string")
    census = spark.createDataFrame([("a", 10), ("a", 5), (None, 20), ("d", 3), ("c", None)], "k string, observation long")
    direct = rate_inputs(people, census, ["k"], 2, fill_missing_count=False)
    assert rows(direct) == [("a", 1.0, 15), ("c", 0.5, None), ("d", None, 3), (None, 0.5, 20)]
    joined = join_population(yearly_count(people, ["k"], 2, "n"), population_totals(census, ["k"]), ["k"])
    assert rows(direct) == rows(joined)
    assert rows(regroup(direct.withColumn("all", F.lit(1)), ["all"])) == [(1, None, None)]


# --- matrix, comparison, checks ------------------------------------------------------------------------------------


def test_matrix(spark):
    data = [(1, "a", 10, 5), (1, "a", 10, 5), (2, "b", 8, 2), (None, "a", 9, 9), (1, None, 9, 9)]
    df = spark.createDataFrame(data, "q int, e string, den long, num long")
    cells = matrix_cells(df, "q", "e", "num", "den")
    assert rows(cells) == [(1, "a", 20, 10, 50.0), (2, "b", 8, 2, 25.0)]
    assert rows(matrix_wide(cells, "q", "e", "percentage", ["a", "b"])) == [(1, 50.0, None), (2, None, 25.0)]
    top = matrix_margins(cells, "e", "num", "den").collect()
    assert [(r.e, r.den, r.percentage) for r in top] == [("a", 20, 50.0), ("b", 8, 25.0)]


def test_compare(spark):
    hosp = spark.createDataFrame([("g", 60.0), (None, 40.0)], "k string, hosp double")
    deaths = spark.createDataFrame([("g", 100.0), ("x", 1.0)], "k string, deaths double")
    names = {"hosp": "Hospitalisations", "deaths": "Deaths"}
    assert rows(shares_long(hosp, deaths, "k", "hosp", "deaths", names)) == [
        ("g", "Deaths", 100.0), ("g", "Hospitalisations", 60.0), (None, "Deaths", 0.0),
        (None, "Hospitalisations", 40.0),
    ]
    assert rows(side_by_side(hosp, deaths, "k")) == [("g", 60.0, 100.0), (None, 40.0, None)]


def test_checks(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "p string, q string")
    assert rows(null_report(df, ["p", "q"])) == [(3, "p", 1, True), (3, "q", 1, True)]
    assert rows(crosstab_counts(df, "p", "q")) == [("a", "x", 1), ("a", None, 1), (None, "x", 1)]


# --- verdicts of the first round -------------------------------------------------------------------------------------


def test_all_cause_identity_is_every_other_column(spark):
    from popmeasure.plans.prepare import PERSON_COLUMNS, all_cause_deaths

    causes = [c for c in CAUSE_COLUMNS]
    base = ["patient_id", "record_id", "sex", "age", "lsoa", "residence_la_code", "ethnic_code", "marital_status"]

    def row(person, record, status, code):
        return (person, record, 1, 70, "L1", "E1", "A", status, code, *[None] * 15)

    schema = ", ".join(
        f"{c} {'int' if c in ('record_id', 'sex', 'age') else 'string'}" for c in [*base, *causes]
    )
    register = spark.createDataFrame(
        [
            row("p", 1, "M1", "I211"), row("p", 2, "M1", "I214"), row("p", 3, "M2", "I211"),
            row(None, 4, "M1", "I211"), row(None, 5, "M1", "I211"), row(None, 5, "M1", "I219"),
        ],
        schema,
    )
    assert all_cause_deaths(register, record="record_id").count() == 4
    assert all_cause_deaths(register.drop("record_id")).count() == 3
    assert all_cause_deaths(register, person=PERSON_COLUMNS).count() == 2  # the narrow identity loses deaths
    double = spark.createDataFrame([("I21", "t"), ("I21", "u")], "icd_subgroup string, icd10_short_title string")
    with pytest.raises(ValueError, match="not unique"):
        all_cause_deaths(register, titles=double)


def test_pivot_loses_no_category(spark):
    cells = spark.createDataFrame([(1, "a", 50.0), (2, "b", 25.0), (2, "c", 5.0)], "q int, e string, percentage double")
    assert matrix_wide(cells, "q", "e", "percentage").columns == ["q", "a", "b", "c"]
    with pytest.raises(Exception, match="without a column: c"):
        matrix_wide(cells, "q", "e", "percentage", ["a", "b"]).collect()


def test_rate_of_a_zero_population_and_of_missing_counts(spark):
    rows_ = [("x", "0-4", 20.0, 0), ("x", "5-9", 20.0, 100), ("y", "0-4", None, 100), ("y", "5-9", 20.0, 100)]
    cells = spark.createDataFrame(rows_, "g string, age_band string, n double, population_count bigint")
    out = {r["g"]: r for r in dsr(cells, ["g"]).collect()}
    assert out["x"]["value"] is None and out["x"]["statistic"] == "dsr NA for zero population"
    other = {r["g"]: r for r in dsr(cells, ["g"], fill_missing_count=False).collect()}
    assert (out["y"]["total_pop"], other["y"]["total_pop"]) == (200, 100) and other["y"]["value"] > out["y"]["value"]
