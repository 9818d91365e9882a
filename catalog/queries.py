"""One entry per operator and plan. Every query reads the given tables whole.

Doubles are rounded to six decimals in the result, here and in the SQL, because two engines may add in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import nullable
from popmeasure.functions import (
    age_group,
    after_first,
    before_first,
    classify,
    code_match,
    code_prefix,
    five_year_band,
    in_levels,
    quintile_from_decile,
    relabel,
    two_bands,
)
from popmeasure.operators.breakdown import by_characteristic
from popmeasure.operators.checks import compare_columns, crosstab_counts, null_report
from popmeasure.operators.enrich import duplicate_keys, enrich, map_labels
from popmeasure.operators.episodes import first_in_gap, latest_per_key, with_row_id
from popmeasure.operators.extract import any_code_filter, exclude, extract_admissions, extract_deaths, filter_codes
from popmeasure.operators.extract import usable_ethnicity
from popmeasure.operators.joins import full_join, without_earlier
from popmeasure.operators.levels import with_level_code
from popmeasure.operators.matrix import matrix_wide, matrix_with_margins
from popmeasure.operators.measures import (
    count_rows,
    max_group_total,
    mean_of_groups,
    order_by_measure,
    population_totals,
    proportion,
    with_grand_total,
    yearly_count,
    yearly_yll,
)
from popmeasure.operators.numbering import first_in_file_order, number_rows, number_scan
from popmeasure.operators.reshape import distinct_causes, distinct_causes_in_row, explode_causes, primary_cause
from popmeasure.operators.standardise import join_population, rate_gaps, rate_inputs
from popmeasure.plans import admissions as adm_plans
from popmeasure.plans import deaths as death_plans
from popmeasure.plans import emergency as em_plans
from popmeasure.plans import rates as rate_plans
from popmeasure.plans.prepare import (
    UNDERLYING,
    add_broad_ethnicity,
    add_lookups,
    all_cause_deaths,
    icd_titles,
    prepare_admissions,
    primary_deaths,
)
from popmeasure.plans.sources_align import conform_sources, multi_cause_rows
from popmeasure.sources import bindings as b
from popmeasure.sources.constants import CENSUS_ETHNICITY, ICD10_GROUP_RULES, SEX_LABELS
from popmeasure.sources.schemas import CAUSE_COLUMNS
from popmeasure.sources.storage import new_path
from popmeasure.sources.tables import inline_table, load_table, save_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = "1996-01-01", "2000-12-31"
DEATH_YEARS, ADMISSION_YEARS = 10, 6
CLINICAL, ICD10 = death_plans.CLINICAL, death_plans.ICD10
ETHNIC_LEVELS = ["Asian", "Black", "Mixed ", "Other", "Unknown", "White "]


def register(name: str, fn: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: comparable(name, fn(spark, sf_dir))


def query(fn: Query) -> Query:
    register(fn.__name__, fn)
    return fn


def comparable(name: str, df: DataFrame, digits: int = 6) -> DataFrame:
    """The result with rounded doubles, dates as text, and the columns of `nullable` cast."""

    def column(n: str, t: str) -> F.Column:
        c = F.col(f"`{n}`")
        if t == "double":
            return F.round(c, digits).alias(n)
        if t == "date" or n in nullable.FLAGS.get(name, []):
            return c.cast("string").alias(n)
        return c.cast("double").alias(n) if n in nullable.NUMBERS.get(name, []) else c

    return df.select(*[column(n, t) for n, t in df.dtypes])


# --- study bases -----------------------------------------------------------------------------------------------


def titles(spark: SparkSession, d: str, pattern: str | None = None) -> DataFrame:
    return icd_titles(b.icd10_listing(spark, d).drop("simplified_cause"), "position", pattern)


def deaths_lookups(spark: SparkSession, d: str, *wanted: str) -> dict:
    found = {
        "lsoa": lambda: (b.lsoa_lookup(spark, d), "lsoa"),
        "ethnicity": lambda: b.ethnicity_coding(spark),
        "clinical": lambda: b.clinical_groups(spark, d),
        "titles": lambda: titles(spark, d),
    }
    return {w: found[w]() for w in wanted}


def primary(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    return primary_deaths(b.deaths_register(spark, d), b.AREA_NAMES, **deaths_lookups(spark, d, *wanted))


def all_cause(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    register_ = b.deaths_register(spark, d).drop("deaths_weight", "reg_date")
    return all_cause_deaths(register_, b.AREA_NAMES, record="record_id", **deaths_lookups(spark, d, *wanted))


def cvd_only(df: DataFrame) -> DataFrame:
    return exclude(df, "clinical_subgroup", "Not CVD")


def admissions(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    found = {
        "lsoa": lambda: (b.lsoa_lookup(spark, d), "lsoa_2011"),
        "ethnicity": lambda: b.ethnicity_coding(spark),
        "clinical": lambda: b.clinical_groups(spark, d),
        "titles": lambda: titles(spark, d, r"I\d{2}"),
        "methods": lambda: b.admission_method_lookup(spark),
    }
    return prepare_admissions(b.admissions(spark, d), b.AREA_NAMES, **{w: found[w]() for w in wanted})


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """Two weighted death sources in different layouts, aligned."""
    base = b.deaths_register(spark, d).select(
        "record_id", "residence_la_code", UNDERLYING, "deaths_weight", "sex", "age", "lsoa", "reg_date"
    )
    odd = base.filter(F.col("record_id") % 2 == 1).withColumnsRenamed(
        {"residence_la_code": "LA CODE", UNDERLYING: "CAUSE", "deaths_weight": "No of Deaths", "sex": "SEX"}
    )
    even = base.filter(F.col("record_id") % 2 == 0).withColumnsRenamed(
        {UNDERLYING: "UNDERLYING_CAUSE_OF_DEATH", "deaths_weight": "CVD", "lsoa": "LSOA_OF_RESIDENCE_CODE"}
    )
    out = conform_sources(
        odd,
        even,
        {"LA CODE": "residence_la_code", "CAUSE": "underlying_cause", "No of Deaths": "deaths", "SEX": "sex"},
        {"UNDERLYING_CAUSE_OF_DEATH": "underlying_cause", "CVD": "deaths", "LSOA_OF_RESIDENCE_CODE": "lsoa"},
        ["reg_date"],
        ["reg_date"],
        b.AREA_CODES[0],
    )
    cause = F.col("underlying_cause")
    return out.withColumns(
        {
            "cvd_group": classify(cause, ICD10_GROUP_RULES),
            "icd_subgroup": code_match(cause, r"I\d{2}"),
            "local_authority": relabel("residence_la_code", b.AREA_NAMES),
            "age_group": age_group("age"),
            "sex": relabel("sex", SEX_LABELS),
        }
    )


# --- extracts and episodes ---------------------------------------------------------------------------------------


def _extract_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return b.episode_diagnosis(spark, d), b.episode_geography(spark, d), b.ethnicity_by_part(spark, d)


@query
def extract_admissions_rows(spark, d):
    rows = extract_admissions(*_extract_inputs(spark, d), b.AREA_CODES, START, END, keep=("episode_id",), salts=8)
    return adm_plans.in_person_order(rows)


@query
def admission_cohort(spark, d):
    return adm_plans.admission_cohort(*_extract_inputs(spark, d), b.AREA_CODES, START, END, gap_days=90)


@query
def admission_cohort_in_order(spark, d):
    cohort = adm_plans.admission_cohort(*_extract_inputs(spark, d), b.AREA_CODES, START, END, gap_days=30)
    return adm_plans.in_person_order(cohort)


@query
def extract_admissions_numbered(spark, d):
    return adm_plans.numbered_admissions(*_extract_inputs(spark, d), b.AREA_CODES, START, END, salts=8)


@query
def admission_episodes(spark, d):
    diagnosis, geography = b.episode_diagnosis(spark, d), b.episode_geography(spark, d)
    return adm_plans.admission_episodes(diagnosis, geography, b.AREA_CODES, START, END, gap_days=90)


@query
def elective_without_recent_emergency(spark, d):
    """Elective admissions of a person without an emergency admission on the day or in the 120 days before."""
    rows = b.admissions(spark, d).select("episode_id", "nhs_number", "admission_date", "admission_method_description")
    urgent = F.col("admission_method_description") == "1-URGENT"
    return without_earlier(rows.filter(~urgent), rows.filter(urgent), "nhs_number", "admission_date", "admission_date", 120)


@query
def ethnicity_numbered(spark, d):
    """The usable entries of the patient index, numbered in order of person and date."""
    usable = usable_ethnicity(b.mh_patient_index(spark, d))
    return number_rows(usable, ["pseudo_nhs_number", "recorded", "record_id"], "rn")


@query
def record_index(spark, d):
    """Every record with its place in the stored table."""
    return number_scan(b.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "index")


@query
def first_title_in_file_order(spark, d):
    """The first title of each code group, in the order of the stored listing."""
    listing = b.icd10_listing(spark, d).drop("position", "simplified_cause")
    groups = listing.withColumn("icd_subgroup", code_prefix("icd10_code", strict=True))
    return first_in_file_order(groups, "icd_subgroup")


@query
def first_admission_in_gap(spark, d):
    person = F.col("patient_id")
    rows = b.deaths_register(spark, d).select(
        F.when(person.cast("bigint") % 97 != 0, person).alias("person"),
        F.substring(UNDERLYING, 1, 1).alias("chapter"),
        F.col("reg_date").alias("admitted"),
        "record_id",
    )
    return first_in_gap(rows, ["person", "chapter"], "admitted", 90, tie="record_id")


@query
def latest_ethnicity(spark, d):
    usable = usable_ethnicity(b.mh_patient_index(spark, d))
    return latest_per_key(usable, "pseudo_nhs_number", ["recorded", "record_id"])


EIGHT_CAUSES = CAUSE_COLUMNS[:8]


def multi_cause(spark: SparkSession, d: str) -> DataFrame:
    """Two multi-cause sources in different layouts: one row per record and distinct cause."""
    base = b.deaths_register(spark, d).select(
        "record_id", "residence_la_code", "sex", "age", "lsoa", "reg_date", *EIGHT_CAUSES
    )
    odd = base.filter(F.col("record_id") % 2 == 1).withColumnsRenamed(
        {"residence_la_code": "LA CODE", "sex": "SEX", **{c: f"CAUSE {k}" for k, c in enumerate(EIGHT_CAUSES)}}
    )
    even = base.filter(F.col("record_id") % 2 == 0).withColumnsRenamed(
        {"lsoa": "LSOA_OF_RESIDENCE_CODE", **{c: f"MENTION_{k}" for k, c in enumerate(EIGHT_CAUSES)}}
    )
    return multi_cause_rows(
        odd,
        even,
        {"LA CODE": "residence_la_code", "SEX": "sex", **{f"CAUSE {k}": f"cause_{k + 1}" for k in range(8)}},
        {"LSOA_OF_RESIDENCE_CODE": "lsoa", **{f"MENTION_{k}": f"cause_{k + 1}" for k in range(8)}},
        ["reg_date", "record_id"],
        ["reg_date", "record_id"],
        b.AREA_CODES[0],
    )


@query
def deaths_multi_cause_by_area(spark, d):
    return count_rows(multi_cause(spark, d), ["residence_la_code", "icd_subgroup", "cvd_group"])


@query
def deaths_multi_cause_by_sex(spark, d):
    return count_rows(multi_cause(spark, d), ["sex", "cvd_group"])


@query
def schema_difference(spark, d):
    """The columns of two tables: types, rows, nulls and distinct values on either side."""
    register_ = b.deaths_register(spark, d).drop(*CAUSE_COLUMNS, "reg_date")
    return compare_columns(register_, b.admissions(spark, d).drop("admission_date"))


PLACE = ("marital_status", "place_of_death_code")


@query
def extract_deaths_rows(spark, d):
    people = b.ethnicity_by_customer(spark, d)
    register_ = b.deaths_register(spark, d).drop("ethnic_code", "deaths_weight", *PLACE)
    return extract_deaths(register_, people, b.AREA_CODES, START, END, salts=8, salt_by=["record_id"])


@query
def death_cohort_rows(spark, d):
    people = b.ethnicity_by_customer(spark, d)
    register_ = b.deaths_register(spark, d).drop("ethnic_code", "deaths_weight", *PLACE)
    return death_plans.death_cohort(register_, people, b.AREA_CODES, START, END, salts=8, salt_by=["record_id"])


@query
def any_code_filter_counts(spark, d):
    rows = any_code_filter(b.deaths_register(spark, d))
    return rows.groupBy("residence_la_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.startswith(F.col(UNDERLYING), F.lit("I"))).alias("n_underlying"),
    )


@query
def conform_union_counts(spark, d):
    return weighted(spark, d).groupBy("residence_la_code", "sex").agg(
        F.count(F.lit(1)).alias("n"), F.sum("deaths").alias("deaths")
    )


# --- reshape and classify ------------------------------------------------------------------------------------------


@query
def unpivot_causes(spark, d):
    long = explode_causes(b.deaths_register(spark, d).select("record_id", *CAUSE_COLUMNS))
    return long.groupBy("cause_number").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("icd10_code") < 3).alias("n_short")
    )


@query
def primary_cause_rows(spark, d):
    long = explode_causes(b.deaths_register(spark, d).select("residence_la_code", *CAUSE_COLUMNS))
    return count_rows(primary_cause(filter_codes(long, "icd10_code", "^I"), UNDERLYING), ["residence_la_code"])


@query
def icd_group_counts(spark, d):
    long = explode_causes(b.deaths_register(spark, d).select("record_id", *CAUSE_COLUMNS))
    return count_rows(long.withColumn("cvd_group", classify("icd10_code", ICD10_GROUP_RULES)), ["cvd_group"])


@query
def icd_subgroup_forms(spark, d):
    long = explode_causes(b.deaths_register(spark, d).select("record_id", *CAUSE_COLUMNS))
    return count_rows(
        long.select(
            code_prefix("icd10_code").alias("prefix"),
            code_prefix("icd10_code", strict=True).alias("strict"),
            code_match("icd10_code", r"I\d{2}").alias("matched"),
        ),
        ["prefix", "strict", "matched"],
    )


@query
def first_per_key_lookup(spark, d):
    return icd_titles(b.icd10_listing(spark, d), "position")


@query
def first_per_key_pattern(spark, d):
    return icd_titles(b.icd10_listing(spark, d), "position", r"I\d{2}")


@query
def distinct_causes_by_person(spark, d):
    return count_rows(all_cause(spark, d), ["icd_subgroup", "cvd_group"])


@query
def distinct_cause_rows(spark, d):
    """One row per person and three-character cause over all columns of the register, by hash before whole rows."""
    rows = b.deaths_register(spark, d).drop("record_id", "deaths_weight")
    long = explode_causes(rows, prefix="I").filter(F.length("icd10_code") >= 3)
    coded = long.withColumns(
        {"icd_subgroup": code_prefix("icd10_code"), "cvd_group": classify("icd10_code", ICD10_GROUP_RULES)}
    )
    return count_rows(distinct_causes(coded, wide=True), ["residence_la_code", "icd_subgroup", "cvd_group"])


@query
def distinct_causes_by_record(spark, d):
    rows = b.deaths_register(spark, d).select("record_id", *CAUSE_COLUMNS)
    return count_rows(distinct_causes_in_row(rows, CAUSE_COLUMNS, missing="NULL"), ["icd_subgroup", "cvd_group"])


@query
def age_group_counts(spark, d):
    rows = b.deaths_register(spark, d).select(
        age_group("age").alias("age_group"), age_group("age", order=True).alias("age_group_ord")
    )
    return count_rows(rows, ["age_group", "age_group_ord"]).orderBy("age_group_ord")


@query
def five_year_band_counts(spark, d):
    shifted = F.col("age") - 3
    rows = b.deaths_register(spark, d).select(
        five_year_band(shifted).alias("age_band"), five_year_band(shifted, order=True).alias("age_band_ord")
    )
    return count_rows(rows, ["age_band", "age_band_ord"])


@query
def two_age_categories(spark, d):
    rows = b.deaths_register(spark, d).select(two_bands("age", 75, "Under 75", "75 and over").alias("age_category"))
    return count_rows(rows, ["age_category"])


@query
def sex_factor_and_default(spark, d):
    rows = b.deaths_register(spark, d).select(
        relabel("sex", SEX_LABELS).alias("sex_factor"),
        relabel("sex", {1: "Male"}, default="Female").alias("sex_default"),
    )
    return count_rows(rows, ["sex_factor", "sex_default"])


@query
def ethnicity_split(spark, d):
    rows = add_lookups(b.deaths_register(spark, d).select("ethnic_code"), ethnicity=b.ethnicity_coding(spark))
    return count_rows(
        rows.select(
            "ethnicity",
            before_first("ethnicity", "-").alias("broad"),
            relabel(after_first("ethnicity", "-"), {" British": " White British"}, keep_other=True).alias("detail"),
        ),
        ["ethnicity", "broad", "detail"],
    )


@query
def ethnicity_levels(spark, d):
    """Ethnic categories as an ordered category: places among the levels found, by name and by mean age."""
    rows = add_lookups(b.deaths_register(spark, d).select("ethnic_code", "age"), ethnicity=b.ethnicity_coding(spark))
    by_name = with_level_code(rows, "ethnicity", out="by_name")
    by_age = with_level_code(by_name, "ethnicity", by="age", desc=True, out="by_age")
    return count_rows(by_age, ["ethnicity", "by_name", "by_age"])


@query
def census_label_map(spark, d):
    mapping = inline_table(spark, list(CENSUS_ETHNICITY.items()), "census string, health string")
    rows = map_labels(b.census(spark, d), "ethnic_group_20", mapping, "ethnicity")
    return population_totals(rows, ["ethnic_group_20", "ethnicity"])


@query
def quintiles_and_levels(spark, d):
    rows = enrich(b.admissions(spark, d).select("lsoa_2011"), b.lsoa_lookup(spark, d), {"lsoa_2011": "lsoa"})
    return count_rows(
        rows.select(
            "imd_decile",
            quintile_from_decile("imd_decile").alias("from_decile"),
            in_levels("imd_decile", 1, 5).alias("low_levels"),
        ),
        ["imd_decile", "from_decile", "low_levels"],
    )


# --- joins -----------------------------------------------------------------------------------------------------------


@query
def full_join_repeated_keys(spark, d):
    """Admissions by place and gender beside the population by place and sex: keys repeat on both sides."""
    counts = count_rows(b.admissions(spark, d), ["lsoa_2011", "gender"]).withColumnRenamed("lsoa_2011", "lsoa")
    place = F.when(F.col("lsoa") != "M07", F.translate("lsoa", "M", "L"))
    people = population_totals(b.census(spark, d).withColumn("lsoa", place), ["lsoa", "sex", "age_code"])
    return full_join(counts.filter(F.coalesce("lsoa", F.lit("")) != "L03"), people, "lsoa")


def _lookup_with_null(spark: SparkSession, d: str) -> DataFrame:
    extra = inline_table(
        spark,
        [(None, "No fixed place", None, None)],
        "lsoa string, locality string, imd_decile int, imd_quintile int",
    )
    return b.lsoa_lookup(spark, d).unionByName(extra)


@query
def lookup_join_null_safe(spark, d):
    rows = enrich(b.deaths_register(spark, d).select("lsoa", "sex"), _lookup_with_null(spark, d), {"lsoa": "lsoa"})
    return count_rows(rows, ["locality", "imd_quintile"])


@query
def lookup_join_sql_rule(spark, d):
    rows = b.deaths_register(spark, d).select("lsoa", "sex")
    return count_rows(enrich(rows, _lookup_with_null(spark, d), {"lsoa": "lsoa"}, null_safe=False), ["locality"])


@query
def lookup_join_salted(spark, d):
    rows = b.deaths_register(spark, d).select("patient_id", "record_id")
    people = b.ethnicity_by_customer(spark, d)
    joined = enrich(
        rows, people, {"patient_id": "pseudo_nhs_number"}, null_safe=False, salts=4, salt_by="record_id"
    )
    return count_rows(joined, ["ethnic_grouping", "is_deceased"])


@query
def lookup_duplicate_keys(spark, d):
    listing = b.icd10_listing(spark, d).withColumn("icd_subgroup", code_prefix("icd10_code", strict=True))
    return duplicate_keys(listing, "icd_subgroup")


@query
def counts_join_population(spark, d):
    counts = yearly_count(
        b.deaths_register(spark, d).withColumn("age_code", F.col("age")), ["age_code"], DEATH_YEARS, "n"
    )
    return join_population(counts, population_totals(b.census(spark, d), ["age_code"]), ["age_code"])


@query
def row_id_uniqueness(spark, d):
    rows = with_row_id(b.table(spark, d, "orders").select("o_orderkey"))
    return rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("ids"), F.sum("c").alias("rows")
    )


# --- deaths and years of life lost -----------------------------------------------------------------------------------


def _death_base(scope: str, grouping: str, *wanted: str) -> Query:
    base = primary if scope == "primary" else all_cause

    def build(spark: SparkSession, d: str) -> DataFrame:
        if grouping == "clinical":
            return cvd_only(base(spark, d, "clinical", *wanted))
        return base(spark, d, "titles", *wanted)

    return build


GROUPINGS = {"clinical": CLINICAL, "icd10": ICD10}
for _scope in ("primary", "all_cause"):
    for _grouping, _keys in GROUPINGS.items():

        def _area(spark, d, base=_death_base(_scope, _grouping), keys=_keys):
            return death_plans.deaths_by_area(base(spark, d), b.AREAS, keys, DEATH_YEARS)

        def _characteristic(spark, d, base=_death_base(_scope, _grouping, "lsoa", "ethnicity"), keys=_keys):
            return death_plans.deaths_by_characteristic(base(spark, d), keys, years=DEATH_YEARS)

        def _age(spark, d, base=_death_base(_scope, _grouping), keys=_keys):
            return death_plans.deaths_by_age(base(spark, d), keys, DEATH_YEARS)

        def _share(spark, d, base=_death_base(_scope, _grouping), key=_keys[0 if _grouping == "clinical" else 1]):
            return death_plans.share_of_deaths(base(spark, d), key)

        register(f"deaths_yll_by_area_{_scope}_{_grouping}", _area)
        register(f"deaths_yll_by_characteristic_{_scope}_{_grouping}", _characteristic)
        register(f"deaths_by_age_{_scope}_{_grouping}", _age)
        register(f"share_of_deaths_{_scope}_{_grouping}", _share)


@query
def deaths_yll_by_area_by_record(spark, d):
    """All-cause deaths where each record is a person of its own."""
    register_ = b.deaths_register(spark, d).drop("deaths_weight", "reg_date")
    rows = all_cause_deaths(
        register_,
        b.AREA_NAMES,
        person=("record_id", "age", "sex", "residence_la_code"),
        one_record_per_person=True,
        clinical=b.clinical_groups(spark, d),
    )
    return death_plans.deaths_by_area(cvd_only(rows), b.AREAS, CLINICAL, DEATH_YEARS)


def _weighted_titles(spark: SparkSession, d: str) -> DataFrame:
    return enrich(weighted(spark, d), titles(spark, d, r"I\d{2}"), "icd_subgroup")


@query
def deaths_yll_weighted_by_area(spark, d):
    return death_plans.deaths_by_area(_weighted_titles(spark, d), b.AREAS, ICD10, DEATH_YEARS, "deaths")


@query
def deaths_yll_weighted_by_characteristic(spark, d):
    rows = enrich(_weighted_titles(spark, d), b.lsoa_lookup(spark, d), "lsoa")
    return death_plans.deaths_by_characteristic(
        rows, ICD10, ["sex", "locality", "imd_quintile"], DEATH_YEARS, "deaths"
    )


@query
def deaths_weighted_by_age(spark, d):
    return death_plans.deaths_by_age(weighted(spark, d), ["cvd_group"], DEATH_YEARS, "deaths")


@query
def deaths_weighted_clinical_by_area(spark, d):
    rows = add_lookups(weighted(spark, d), clinical=b.clinical_groups(spark, d))
    return death_plans.deaths_by_area(rows, b.AREAS, CLINICAL, DEATH_YEARS, "deaths")


@query
def share_of_deaths_weighted(spark, d):
    return death_plans.share_of_deaths(weighted(spark, d), "cvd_group", "deaths")


@query
def yearly_yll_by_sex(spark, d):
    return yearly_yll(death_plans.with_yll(primary(spark, d)), ["sex", "age_group"], DEATH_YEARS)


@query
def max_group_total_deaths(spark, d):
    rows = cvd_only(primary(spark, d, "clinical"))
    cells = yearly_count(rows, [*CLINICAL, "sex"], DEATH_YEARS)
    return max_group_total(cells, CLINICAL, "deaths")


# --- admissions -----------------------------------------------------------------------------------------------------

for _grouping, _keys in GROUPINGS.items():
    _lookup = "clinical" if _grouping == "clinical" else "titles"

    def _hosp(spark, d, *wanted, lookup=_lookup, grouping=_grouping):
        rows = admissions(spark, d, lookup, *wanted)
        return cvd_only(rows) if grouping == "clinical" else rows

    def _hosp_area(spark, d, base=_hosp, keys=_keys):
        return adm_plans.admissions_by_area(base(spark, d), keys, b.AREAS, ADMISSION_YEARS)

    def _hosp_characteristic(spark, d, base=_hosp, keys=_keys):
        return adm_plans.admissions_by_characteristic(
            base(spark, d, "lsoa", "ethnicity"), keys, years=ADMISSION_YEARS
        )

    def _vs_long(spark, d, base=_hosp, grouping=_grouping, key=_keys[0 if _grouping == "clinical" else 1]):
        deaths = death_plans.share_of_deaths(_death_base("primary", grouping)(spark, d), key)
        return adm_plans.deaths_vs_admissions(adm_plans.share_of_admissions(base(spark, d), key), deaths, key)

    def _vs_yearly(spark, d, base=_hosp, grouping=_grouping, keys=_keys):
        both = {"Both areas": b.AREAS["Both areas"]}
        hosp = adm_plans.admissions_by_area(base(spark, d), keys, both, ADMISSION_YEARS).drop("area")
        deaths = death_plans.deaths_by_area(
            _death_base("primary", grouping)(spark, d), both, keys, DEATH_YEARS
        ).drop("area")
        return adm_plans.yearly_deaths_vs_admissions(hosp, deaths, keys[0], keys[1])

    register(f"hosp_by_area_{_grouping}", _hosp_area)
    register(f"hosp_by_characteristic_{_grouping}", _hosp_characteristic)
    register(f"deaths_vs_hosp_long_{_grouping}", _vs_long)
    register(f"deaths_vs_hosp_yearly_{_grouping}", _vs_yearly)


@query
def admission_methods(spark, d):
    return adm_plans.admission_methods(b.admissions(spark, d), ADMISSION_YEARS)


# --- emergency admissions -------------------------------------------------------------------------------------------


@query
def emergency_by_characteristic(spark, d):
    rows = admissions(spark, d, "lsoa", "ethnicity", "methods")
    return em_plans.emergency_by_characteristic(rows, area_code="E38000258")


@query
def emergency_by_characteristic_under_75(spark, d):
    rows = em_plans.under_75(admissions(spark, d, "lsoa", "ethnicity", "methods"))
    return em_plans.emergency_by_characteristic(rows)


@query
def emergency_ethnicity_age(spark, d):
    rows = em_plans.with_age_category(admissions(spark, d, "ethnicity", "methods"))
    return em_plans.emergency_by_pair(rows, ["ethnicity", "age_category"], "age_category")


@query
def emergency_imd_sex(spark, d):
    rows = admissions(spark, d, "lsoa", "methods")
    return em_plans.emergency_by_pair(rows, ["imd_quintile", "gender"], "gender", ["Not known"])


@query
def emergency_imd_sex_under_75(spark, d):
    rows = em_plans.under_75(admissions(spark, d, "lsoa", "methods"))
    return em_plans.emergency_by_pair(rows, ["imd_quintile", "gender"], "gender", ["Not known"])


def _imd_ethnicity(spark: SparkSession, d: str) -> DataFrame:
    rows = add_broad_ethnicity(admissions(spark, d, "lsoa", "ethnicity", "methods"))
    return em_plans.emergency_by_pair(rows, ["imd_decile", "ethnicity_broad"])


@query
def emergency_imd_ethnicity(spark, d):
    return _imd_ethnicity(spark, d)


@query
def emergency_imd_age(spark, d):
    return em_plans.emergency_by_pair(admissions(spark, d, "lsoa", "methods"), ["imd_quintile", "age_group"])


@query
def emergency_by_subgroup(spark, d):
    return em_plans.emergency_by_subgroup(admissions(spark, d, "clinical", "methods"))


@query
def emergency_mean_of_ethnicities(spark, d):
    cells = proportion(admissions(spark, d, "ethnicity", "methods"), ["ethnicity"], "emergency")
    return mean_of_groups(cells, "emergency_percentage", "mean_percentage")


# --- populations and rates ------------------------------------------------------------------------------------------


def _banded_census(spark: SparkSession, d: str) -> DataFrame:
    return rate_plans.with_band(b.census(spark, d), "age_code")


def _deprived_census(spark: SparkSession, d: str) -> DataFrame:
    return enrich(_banded_census(spark, d), b.lsoa_lookup(spark, d, "M"), "lsoa")


@query
def population_by_age(spark, d):
    return population_totals(_banded_census(spark, d), ["age_band"])


@query
def population_by_ethnicity(spark, d):
    return population_totals(rate_plans.with_health_ethnicity(_banded_census(spark, d)), ["ethnicity", "age_band"])


@query
def population_by_sex_ethnicity(spark, d):
    rows = rate_plans.with_health_ethnicity(_banded_census(spark, d))
    return population_totals(rows, ["ethnicity", "age_band", "sex"])


@query
def population_by_imd_decile(spark, d):
    return population_totals(_deprived_census(spark, d), ["imd_decile", "age_band"])


@query
def population_by_imd_quintile(spark, d):
    return population_totals(_deprived_census(spark, d), ["imd_quintile", "age_band"])


def _rate_events(outcome: str, spark: SparkSession, d: str, *wanted: str) -> tuple[DataFrame, float]:
    if outcome == "admissions":
        found = {
            "lsoa": lambda: (b.lsoa_lookup(spark, d), "lsoa_2011"),
            "ethnicity": lambda: b.ethnicity_coding(spark),
        }
        rows = rate_plans.with_band(b.admissions(spark, d), "age_on_admission")
        years = ADMISSION_YEARS
    else:
        found = {"lsoa": lambda: (b.lsoa_lookup(spark, d), "lsoa"), "ethnicity": lambda: b.ethnicity_coding(spark)}
        rows = rate_plans.with_band(filter_codes(b.deaths_register(spark, d), UNDERLYING, "^I"), "age")
        rows = rows.withColumn("sex", relabel("sex", {1: "Male"}, default="Female"))
        years = DEATH_YEARS
    return add_lookups(rows, unknown_ethnicity=None, **{w: found[w]() for w in wanted}), years


for _outcome in ("admissions", "deaths"):

    def _dsr_population(spark, d, outcome=_outcome):
        events, years = _rate_events(outcome, spark, d)
        return rate_plans.population_rate(events, _banded_census(spark, d), years)

    def _dsr_ethnicity(spark, d, outcome=_outcome):
        events, years = _rate_events(outcome, spark, d, "ethnicity")
        merged = None if outcome == "admissions" else rate_plans.MIXED_AND_OTHER
        return rate_plans.ethnicity_rate(events, _banded_census(spark, d), years, merged)

    def _dsr_known_ethnicity(spark, d, outcome=_outcome):
        events, years = _rate_events(outcome, spark, d, "ethnicity")
        return rate_plans.known_ethnicity_rate(events, _banded_census(spark, d), years)

    def _dsr_sex_ethnicity(spark, d, outcome=_outcome):
        events, years = _rate_events(outcome, spark, d, "ethnicity")
        census = _banded_census(spark, d)
        if outcome == "admissions":
            events = rate_plans.known_gender(events)
            return rate_plans.sex_ethnicity_rate(events, census, years, merged=rate_plans.MIXED)
        return rate_plans.sex_ethnicity_rate(events, census, years, broad=True)

    def _dsr_decile(spark, d, outcome=_outcome):
        events, years = _rate_events(outcome, spark, d, "lsoa")
        return rate_plans.deprivation_rate(events, _deprived_census(spark, d), years, "imd_decile", 10)

    def _dsr_quintile(spark, d, outcome=_outcome):
        events, years = _rate_events(outcome, spark, d, "lsoa")
        return rate_plans.deprivation_rate(events, _deprived_census(spark, d), years, "imd_quintile", 5)

    register(f"dsr_population_{_outcome}", _dsr_population)
    register(f"dsr_ethnicity_{_outcome}", _dsr_ethnicity)
    register(f"dsr_known_ethnicity_{_outcome}", _dsr_known_ethnicity)
    register(f"dsr_sex_ethnicity_{_outcome}", _dsr_sex_ethnicity)
    register(f"dsr_imd_decile_{_outcome}", _dsr_decile)
    register(f"dsr_imd_quintile_{_outcome}", _dsr_quintile)


@query
def dsr_input_gaps(spark, d):
    events, years = _rate_events("admissions", spark, d, "lsoa")
    cells = rate_inputs(events, _deprived_census(spark, d), ["imd_quintile", "age_band"], years)
    return rate_gaps(cells, ["imd_quintile"])


@query
def dsr_zero_population(spark, d):
    """Rates by decile on a census that lacks one cell and has no people in another; absent counts take no part."""
    events, years = _rate_events("admissions", spark, d, "lsoa")
    census = _deprived_census(spark, d)
    lacking = (F.col("imd_decile") == 2) & F.col("age_band").isin("10-14", "15-19")
    empty = (F.col("imd_decile") == 3) & (F.col("age_band") == "20-24")
    thin = census.filter(F.coalesce(~lacking, F.lit(True))).withColumn(
        "observation", F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col("observation"))
    )
    return rate_plans.deprivation_rate(events, thin, years, "imd_decile", 10, fill_missing_count=False)


# --- stored tables --------------------------------------------------------------------------------------------------


@query
def stored_partitions_replaced(spark, d):
    """Deaths stored by year, one year replaced by corrected rows, a span of years read back."""
    rows = b.deaths_register(spark, d).select("record_id", "sex", "deaths_weight", F.year("reg_date").alias("year"))
    path = new_path(spark, "deaths")
    save_table(rows, path, ["year"])
    corrected = rows.filter("year = 1996 AND sex != 0").withColumn("deaths_weight", F.col("deaths_weight") + 10)
    save_table(corrected, path, ["year"], replace="partitions")
    back = load_table(spark, path).filter(F.col("year").between(1995, 1997))
    return back.groupBy("year", "sex").agg(F.count(F.lit(1)).alias("n"), F.sum("deaths_weight").alias("deaths"))


@query
def csv_round_trip(spark, d):
    """The register written as text with a header and read back with its schema: nulls, dates and numbers stay."""
    rows = b.deaths_register(spark, d).select("record_id", "patient_id", "age", "reg_date", *CAUSE_COLUMNS[:4])
    path = new_path(spark, "register")
    save_table(rows, path, fmt="csv")
    back = load_table(spark, path, rows.schema, "csv")
    return back.groupBy("age").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("patient_id").alias("persons"),
        *[F.count(c).alias(c) for c in CAUSE_COLUMNS[:4]],
        F.min("reg_date").alias("first_date"),
        F.max("record_id").alias("last_record"),
    )


@query
def bucketed_cohort(spark, d):
    """The admission cohort from tables stored by person: gap rule and person join without an exchange."""
    diagnosis, geography, people = _extract_inputs(spark, d)
    return adm_plans.cohort_from_buckets(
        *adm_plans.bucketed_inputs(diagnosis, geography, people, b.AREA_CODES, START, END, buckets=8), gap_days=90
    )


# --- matrix ---------------------------------------------------------------------------------------------------------


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return em_plans.matrix_input(_imd_ethnicity(spark, d))


@query
def matrix_all_margins(spark, d):
    """Emergency share by quintile and gender with both margins and the total, straight from the admissions."""
    rows = admissions(spark, d, "lsoa", "methods").select(
        "imd_quintile",
        "gender",
        F.when(F.col("emergency"), 1).otherwise(0).cast("bigint").alias("emergency_admissions"),
        F.lit(1).cast("bigint").alias("total_admissions"),
    )
    return matrix_with_margins(rows, "imd_quintile", "gender", "emergency_admissions", "total_admissions")


@query
def matrix_long(spark, d):
    return _matrix(spark, d)


@query
def matrix_wide_percentage(spark, d):
    return matrix_wide(_matrix(spark, d), "imd_quintile", "ethnicity", "percentage", ETHNIC_LEVELS)


@query
def matrix_margin_ethnicity(spark, d):
    return em_plans.margins(_matrix(spark, d), "ethnicity")


@query
def matrix_margin_imd(spark, d):
    return em_plans.margins(_matrix(spark, d), "imd_quintile")


# --- ordering, totals, checks ---------------------------------------------------------------------------------------


@query
def rank_over_all(spark, d):
    cells = yearly_count(primary(spark, d, "ethnicity"), ["sex", "ethnicity"], DEATH_YEARS, "deaths")
    return order_by_measure(cells, "deaths", desc=True, rank_col="position", tie=["ethnicity", "sex"])


@query
def rank_within_facet(spark, d):
    cells = yearly_count(primary(spark, d, "ethnicity"), ["ethnicity", "sex"], DEATH_YEARS)
    return order_by_measure(cells, "deaths", within="sex", rank_col="position", tie="ethnicity")


@query
def grand_total(spark, d):
    return with_grand_total(count_rows(b.admissions(spark, d), ["gp_code"]), "n")


@query
def counts_by_characteristic(spark, d):
    rows = admissions(spark, d, "lsoa")
    return by_characteristic(rows, ["gender", "imd_quintile", "locality"], [F.count(F.lit(1)).alias("n")])


@query
def quality_nulls(spark, d):
    rows = admissions(spark, d, "lsoa", "clinical", "methods")
    return null_report(rows, ["locality", "clinical_subgroup", "admission_group", "cvd_group", "gp_code"])


@query
def quality_crosstab(spark, d):
    rows = admissions(spark, d, "methods")
    return crosstab_counts(rows, "admission_method_description", "admission_group")


@query
def quality_flag_counts(spark, d):
    return count_rows(admissions(spark, d, "methods"), ["emergency"])
