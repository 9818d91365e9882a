"""Physical plans over stored tables: what reaches the scan, what is shuffled, and how often the base is read."""

import re

import pytest
from helpers import plan
from pyspark.sql import functions as F

from popmeasure.operators.extract import any_code_filter, extract_admissions
from popmeasure.plans import admissions as adm_plans
from popmeasure.plans import deaths as death_plans
from popmeasure.plans.prepare import add_lookups, all_cause_deaths, primary_deaths
from popmeasure.sources import bindings as b
from popmeasure.sources.schemas import schema_of
from popmeasure.sources.tables import load_table


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    for name, df in {
        "register": b.deaths_register(spark, sf),
        "diagnosis": b.episode_diagnosis(spark, sf),
        "geography": b.episode_geography(spark, sf),
        "ethnicity": b.ethnicity_by_part(spark, sf).withColumn("is_deceased", F.lit(0)),
        "clinical": b.clinical_groups(spark, sf).withColumn("icd10_short_title", F.lit("t")),
    }.items():
        df.write.parquet(str(folder / name))
    return lambda name, table=None: load_table(spark, str(folder / name), schema_of(table) if table else None)


def scan(df, name):
    """The scan node of a stored table in the formatted plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return next(part for part in text.split("\n\n") if f"/{name}]" in part and "ReadSchema" in part)


def test_extract_filters_and_columns_reach_the_scans(stored):
    diagnosis, geography = stored("diagnosis", "episode_diagnosis"), stored("geography", "episode_geography")
    out = extract_admissions(diagnosis, geography, stored("ethnicity"), b.AREA_CODES, "1996-01-01", "2000-12-31")
    text = scan(out, "diagnosis")
    for pushed in (
        "StringStartsWith(diagnosis_code,I)",
        "EqualTo(diagnosis_order,1)",
        "EqualTo(order_in_spell,1)",
        "GreaterThanOrEqual(admission_date,1996-01-01)",
        "LessThan(admission_date,2000-12-31)",
        "IsNotNull(nhs_number)",
    ):
        assert pushed in text, pushed
    assert "In(local_authority" in scan(out, "geography")
    assert "is_deceased" not in scan(out, "ethnicity")


def test_primary_deaths_read_the_underlying_cause_only(stored):
    out = primary_deaths(stored("register")).groupBy("cvd_group", "sex").count()
    text = scan(out, "register")
    assert "StringStartsWith(s_underlying_cod_icd10,I)" in text
    assert re.search(r"ReadSchema: struct<sex:int,s_underlying_cod_icd10:string>", text)


def test_any_code_test_is_pushed(stored):
    text = scan(any_code_filter(stored("register")), "register")
    assert "Or(" in text and text.count("StringStartsWith(") == 16


def test_death_tables_read_the_register_once_and_shuffle_cells(stored):
    clinical = stored("clinical", "clinical_group")
    base = primary_deaths(stored("register"), b.AREA_NAMES, clinical=clinical)
    text = plan(death_plans.deaths_by_area(base, b.AREAS))
    assert text.count("/register]") == 1 and "partial_count" in text and "partial_sum" in text
    text = plan(death_plans.deaths_by_characteristic(base, characteristics=["sex", "age_group"]))
    assert text.count("/register]") == 1 and text.count("Exchange hashpartitioning") == 1


def test_all_cause_shuffles_once_for_the_distinct(stored):
    text = plan(all_cause_deaths(stored("register")))
    assert text.count("Exchange hashpartitioning") == 1 and "Expand" not in text
    assert plan(all_cause_deaths(stored("register"), one_record_per_person=True)).count("Exchange") == 0


def test_cohort_reads_the_diagnoses_once(stored):
    out = adm_plans.admission_cohort(
        stored("diagnosis", "episode_diagnosis"), stored("geography"), stored("ethnicity"), b.AREA_CODES,
        "1996-01-01", "2000-12-31",
    )
    assert plan(out).count("/diagnosis]") == 1


def test_unused_lookups_are_not_joined(stored):
    rows = add_lookups(primary_deaths(stored("register")), clinical=stored("clinical", "clinical_group"))
    text = plan(rows.groupBy("clinical_subgroup").count())
    assert text.count("Join") == 1


def test_salted_person_joins_give_the_same_rows(spark, sf, stored):
    people = b.ethnicity_by_customer(spark, sf)
    register = stored("register").drop("ethnic_code")
    plain = death_plans.death_cohort(register, people, b.AREA_CODES, "1996-01-01", "2000-12-31")
    salted = death_plans.death_cohort(
        register, people, b.AREA_CODES, "1996-01-01", "2000-12-31", salts=5, salt_by=["record_id"]
    )
    assert plain.columns == salted.columns and sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))
    args = (stored("diagnosis", "episode_diagnosis"), stored("geography"), stored("ethnicity"), b.AREA_CODES)
    dates = ("1996-01-01", "2000-12-31")
    one, many = extract_admissions(*args, *dates), extract_admissions(*args, *dates, salts=5)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_a_salted_join_leaves_the_next_aggregate_its_own_shuffle(spark, stored):
    """Without salt, an aggregate on the join key would run in the join's partitions, hot ones included."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        people = stored("ethnicity").withColumnRenamed("pseudo_nhs_number", "person")
        register = stored("register").drop("ethnic_code")
        joined = death_plans.death_cohort(
            register, people.withColumnRenamed("person", "pseudo_nhs_number"), b.AREA_CODES, "1996-01-01",
            "2000-12-31", salts=4, salt_by=["record_id"],
        )
        text = plan(all_cause_deaths(joined))
        assert re.search(r"Exchange hashpartitioning\(patient_id#\d+, __salt", text)
        assert text.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
