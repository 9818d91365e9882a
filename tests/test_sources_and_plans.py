import pytest
from pyspark.sql import functions as F

from popmeasure.plans import emergency, rates, reports
from popmeasure.plans.prepare import all_cause_deaths, icd_titles, primary_deaths
from popmeasure.plans.sources_align import conform_sources
from popmeasure.sources import bindings as b
from popmeasure.sources.schemas import TABLES, schema_of
from popmeasure.sources.tables import (
    conform,
    conform_union,
    inline_table,
    load_table,
    save_table,
    schema_diff,
    standard_population,
    temp_table,
)


def test_schemas_parse():
    for name in TABLES:
        assert schema_of(name).names


def test_csv_and_parquet_round_trip(spark, tmp_path):
    lookup = inline_table(
        spark,
        [("L1", "East", 1, 1), (None, "It's \\ odd", None, None)],
        "lsoa string, locality string, imd_decile int, imd_quintile int",
    )
    lookup.write.option("header", True).csv(str(tmp_path / "csv"))
    schema = schema_of("lsoa_lookup")
    back = load_table(spark, str(tmp_path / "csv"), schema, "csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, lookup.collect()))
    save_table(lookup, str(tmp_path / "pq"))
    assert load_table(spark, str(tmp_path / "pq"), schema).schema == schema
    save_table(lookup.filter("imd_decile = 1"), str(tmp_path / "pq"))
    assert load_table(spark, str(tmp_path / "pq")).count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        load_table(spark, str(tmp_path / "pq"), schema_of("icd10_listing"))
    with pytest.raises(ValueError, match="needs a schema"):
        load_table(spark, str(tmp_path / "csv"), None, "csv")
    with pytest.raises(ValueError, match="unsupported"):
        load_table(spark, str(tmp_path / "csv"), schema, "xlsx")


def test_partitioned_save(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("area"), "id")
    save_table(df, str(tmp_path / "t"), ["area"])
    assert sorted(p.name for p in (tmp_path / "t").glob("area=*")) == ["area=0", "area=1", "area=2"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_conform(spark):
    first = spark.createDataFrame([("E1", 1, "x")], "`LA CODE` string, n int, extra string")
    second = spark.createDataFrame([("E2", 2)], "code string, n int")
    a = conform(first, {"LA CODE": "area"}, ["extra"])
    assert [tuple(r) for r in conform_union(a, conform(second, {"code": "area"})).collect()] == [("E1", 1), ("E2", 2)]
    with pytest.raises(ValueError, match="missing"):
        conform(first, {"absent": "area"})
    with pytest.raises(Exception, match="(?i)number of columns|resolve|match"):
        conform_union(a, second).collect()
    diff = {r.column_name: (r.first_type, r.second_type) for r in schema_diff(first, second).collect()}
    assert diff == {"LA CODE": ("string", None), "n": ("int", "int"), "extra": ("string", None), "code": (None, "string")}


def test_conform_sources_filters_the_first(spark):
    cols = "residence_la_code string, underlying_cause string, deaths bigint, sex int, age int, lsoa string"
    df = spark.createDataFrame([("E1", "I20", 1, 1, 50, "L"), ("E2", "I20", 2, 1, 50, "L")], cols)
    out = conform_sources(df, df, {}, {}, first_area="E1")
    assert sorted(r.residence_la_code for r in out.collect()) == ["E1", "E1", "E2"]


def test_standard_population_is_a_sized_relation(spark):
    df = standard_population(spark)
    assert df.count() == 19 and df.agg(F.sum("standard_population")).first()[0] == 100_000
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_temp_table(spark):
    df = temp_table(spark.range(5), "five")
    assert spark.sql("SELECT count(*) FROM five").first()[0] == 5
    kept = temp_table(df, "five_kept", materialise=True)
    assert kept.count() == 5 and "Range" not in kept._jdf.queryExecution().executedPlan().toString()


def test_primary_equals_the_filtered_long_form(spark, sf):
    from popmeasure.operators.reshape import explode_causes, primary_cause

    register = b.deaths_register(spark, sf)
    long = primary_cause(explode_causes(register), "s_underlying_cod_icd10")
    want = long.filter(F.col("icd10_code").rlike("^I") & (F.length("icd10_code") >= 3)).count()
    assert primary_deaths(register).count() == want


def test_one_record_per_person_needs_no_shuffle(spark, sf):
    register = b.deaths_register(spark, sf)
    person = ("record_id", "sex", "age", "residence_la_code")
    plain = all_cause_deaths(register, person=person)
    in_row = all_cause_deaths(register, person=person, one_record_per_person=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, in_row.select(*plain.columns).collect()))
    assert "Exchange hashpartitioning" not in in_row._jdf.queryExecution().executedPlan().toString()


def test_titles_keep_one_null_group(spark):
    listing = inline_table(
        spark,
        [("I20", "b", 2), ("I201", "a", 1), ("I2", "short", 3), ("X", "odd", 4)],
        "icd10_code string, icd10_short_title string, position int",
    )
    got = {r.icd_subgroup: r.icd10_short_title for r in icd_titles(listing, "position").collect()}
    assert got == {"I20": "a", None: "short"}


def test_under_75_and_area_constants(spark, sf):
    df = inline_table(spark, [(74, True), (75, True), (None, True)], "age_on_admission int, emergency boolean")
    assert emergency.under_75(df).count() == 1
    out = emergency.emergency_by_characteristic(df, ["age_on_admission"], area_code="E38000258")
    assert {r.area_code for r in out.collect()} == {"E38000258"}


def test_split_and_merge_ethnicity(spark):
    df = inline_table(
        spark,
        [("White - British",), ("Mixed - White and Asian",), ("Other Ethnic Groups - Chinese",)],
        "ethnicity string",
    )
    split = rates.split_ethnicity(df)
    assert {(r.ethnicity_broad, r.ethnicity) for r in split.collect()} == {
        ("White ", " White British"), ("Mixed ", " White and Asian"), ("Other Ethnic Groups ", " Chinese"),
    }
    merged = rates.merge_small(split, rates.MIXED_AND_OTHER)
    assert {r.ethnicity for r in merged.collect()} == {" White British", " Mixed", " Other Ethnic Groups"}


def test_reports_write_long_tables(spark, sf, tmp_path):
    from catalog import queries as q

    base = q.cvd_only(q.primary(spark, sf, "clinical", "lsoa", "ethnicity"))
    reports.write_death_tables(base, str(tmp_path / "deaths"), b.AREAS)
    area = spark.read.parquet(str(tmp_path / "deaths/by_area"))
    assert {r.area for r in area.select("area").distinct().collect()} <= set(b.AREAS)
    total = area.groupBy("area").agg(F.sum("deaths").alias("n")).collect()
    n = {r.area: round(r.n, 6) for r in total}
    assert n["Both areas"] == round(n["Area A"] + n["Area B"], 6)
    shares = spark.read.parquet(str(tmp_path / "deaths/share")).agg(F.sum("percentage_deaths")).first()[0]
    assert round(shares, 6) == 100
    hosp = q.admissions(spark, sf, "titles", "lsoa", "ethnicity")
    reports.write_admission_tables(hosp, str(tmp_path / "hosp"), b.AREAS, q.ICD10, "cvd_group", materialise=False)
    assert spark.read.parquet(str(tmp_path / "hosp/methods")).count() == 5
