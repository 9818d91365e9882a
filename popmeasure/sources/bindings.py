"""Study-shaped views over the TPC-H-like test tables.

Pure projections and lookups of the given tables, so that every query reads them whole. The same shapes are written in
SQL in `catalog/oracles.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popmeasure.sources.constants import CENSUS_ETHNICITY
from popmeasure.sources.schemas import CAUSE_COLUMNS
from popmeasure.sources.tables import inline_table, load_table

AREA_CODES = ["E08000025", "E08000029"]
AREA_NAMES = {"E08000025": "Area A", "E08000029": "Area B"}
AREAS = {"Area A": ["Area A"], "Area B": ["Area B"], "Both areas": ["Area A", "Area B"]}

# National ethnic category codes.
ETHNICITY_CODES = [
    ("A", "White - British"),
    ("B", "White - Irish"),
    ("C", "White - Any other White background"),
    ("D", "Mixed - White and Black Caribbean"),
    ("E", "Mixed - White and Black African"),
    ("F", "Mixed - White and Asian"),
    ("G", "Mixed - Any other mixed background"),
    ("H", "Asian or Asian British - Indian"),
    ("J", "Asian or Asian British - Pakistani"),
    ("K", "Asian or Asian British - Bangladeshi"),
    ("L", "Asian or Asian British - Any other Asian background"),
    ("M", "Black or Black British - Caribbean"),
    ("N", "Black or Black British - African"),
    ("P", "Black or Black British - Any other Black background"),
    ("R", "Other Ethnic Groups - Chinese"),
    ("S", "Other Ethnic Groups - Any other ethnic group"),
]
CODE_LETTERS = "ABCDEFGHJKLMNPRSZX"

ADMISSION_METHODS = [
    ("1-URGENT", "Emergency"),
    ("2-HIGH", "Emergency"),
    ("3-MEDIUM", "Elective"),
    ("4-NOT SPECIFIED", "Elective"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a test table with the schema that its files have now."""
    return load_table(spark, f"{sf_dir}/{name}.parquet")


def _two_digits(number: str) -> str:
    return f"lpad(cast({number} AS string), 2, '0')"


def _area_code(nation: str) -> str:
    return f"CASE {nation} % 5 WHEN 0 THEN '{AREA_CODES[0]}' WHEN 1 THEN '{AREA_CODES[1]}' ELSE 'E99999999' END"


def _ethnic_code(person: str) -> str:
    return f"substring('{CODE_LETTERS}', cast(({person} * 7 + {person} div 100) % 18 + 1 AS int), 1)"


def _person(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS episode_id",
        "o_custkey AS person_id",
        "cast(o_orderdate AS date) AS event_date",
        "CASE WHEN o_custkey % 97 != 0 THEN cast(o_custkey % 100 AS int) END AS age",
        f"CASE WHEN o_custkey % 89 != 0 THEN 'L' || {_two_digits('c_nationkey')} END AS lsoa",
        f"{_area_code('c_nationkey')} AS la_code",
        f"{_ethnic_code('o_custkey')} AS ethnic_code",
        "o_orderpriority AS method",
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted admissions: one row per order."""
    return _person(spark, sf_dir).selectExpr(
        "episode_id",
        "cast(person_id AS string) AS nhs_number",
        f"'I' || {_two_digits('episode_id * 7 % 100')} AS diagnosis_group",
        "event_date AS admission_date",
        "age AS age_on_admission",
        "CASE person_id % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Not known' END AS gender",
        "lsoa AS lsoa_2011",
        "la_code AS local_authority",
        f"'GP' || {_two_digits('person_id % 40')} AS gp_code",
        "ethnic_code",
        "method AS admission_method_description",
    )


def _code_blocks(key: str) -> str:
    """Six codes of a letter and three digits, spread over all digits, as one text."""
    digits = f"cast(1000000000000000000 + ({key} * 982451653 % 1000000007) * 999999937 AS string)"
    blocks = [f"'{letter}' || substring({digits}, {2 + 3 * i}, 3)" for i, letter in enumerate("IJIIJI")]
    return " || ".join(blocks)


def _cause(k: int) -> str:
    """Cause k: one of the codes, cut short or the text NULL at times, null for every third one but the underlying."""
    at = f"(episode_id + {k})"
    code = f"substring(codes, 4 * ({at} % 6) + 1, if({at} % 17 = 0, 2, 4))"
    kept = f"if({at} % 11 = 0, 'NULL', {code})"
    return kept if k == 0 else f"if({at} % 3 != 0, {kept}, NULL)"


def deaths_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Death register: one row per order, sixteen cause columns, the text NULL and short codes among them."""
    return _person(spark, sf_dir).selectExpr("*", f"{_code_blocks('episode_id')} AS codes").selectExpr(
        "CASE WHEN person_id % 53 != 0 THEN cast(person_id AS string) END AS patient_id",
        "cast(person_id % 3 AS int) AS sex",
        "'M' || cast(episode_id div 2 % 2 AS string) AS marital_status",
        "'P' || cast(episode_id div 4 % 2 AS string) AS place_of_death_code",
        "age",
        "lsoa",
        "la_code AS residence_la_code",
        "ethnic_code",
        "event_date AS reg_date",
        "1 + episode_id % 3 AS deaths_weight",
        "episode_id AS record_id",
        *[f"{_cause(k)} AS {c}" for k, c in enumerate(CAUSE_COLUMNS)],
    )


def episode_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses of episodes: one row per line item."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS episode_id",
        "CASE WHEN l_partkey % 97 != 0 THEN 'P' || cast(l_partkey AS string) END AS nhs_number",
        f"if(l_orderkey % 10 = 0, 'J', 'I') || {_two_digits('l_partkey % 100')} || cast(l_orderkey % 10 AS string) "
        "AS diagnosis_code",
        "l_linenumber AS diagnosis_order",
        "cast(l_suppkey % 2 + 1 AS int) AS order_in_spell",
        "'S' || cast(l_suppkey AS string) AS provider_code",
        "'Provider ' || cast(l_suppkey AS string) AS provider_name",
        "if(l_partkey % 2 = 1, 'Male', 'Female') AS gender",
        "cast(l_partkey % 100 AS int) AS age_on_admission",
        "cast(l_shipdate AS date) AS admission_date",
        "l_linestatus AS admission_source_code",
        "'Source ' || l_linestatus AS admission_source_description",
        "l_returnflag AS admission_method_code",
        "'Method ' || l_returnflag AS admission_method_description",
    )


def episode_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS episode_id",
        f"{_area_code('c_nationkey')} AS local_authority",
        "'Constituency ' || cast(c_nationkey AS string) AS constituency",
        f"'L' || {_two_digits('c_nationkey')} AS lsoa_2011",
        f"'M' || {_two_digits('c_nationkey')} AS lsoa_2021",
        f"'GP' || {_two_digits('o_custkey % 40')} AS gp_code",
    )


def ethnicity_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ethnicity of the people of `episode_diagnosis`."""
    return table(spark, sf_dir, "part").selectExpr(
        "'P' || cast(p_partkey AS string) AS pseudo_nhs_number",
        f"substring('{CODE_LETTERS}', p_size % 18 + 1, 1) AS ethnic_code",
        "p_type AS ethnic_grouping",
    )


def ethnicity_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ethnicity of the people of `deaths_register`."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey AS string) AS pseudo_nhs_number",
        "c_mktsegment AS ethnic_grouping",
        "cast(c_custkey % 2 AS int) AS is_deceased",
        f"{_ethnic_code('c_custkey')} AS ethnic_code",
    )


def mh_patient_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient index with several rows per person and unusable categories."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_custkey % 97 != 0 THEN cast(o_custkey AS string) END AS pseudo_nhs_number",
        f"CASE WHEN o_orderkey % 13 != 0 THEN substring('{CODE_LETTERS}', cast(o_orderkey % 18 + 1 AS int), 1) END "
        "AS ethnic_code",
        "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 != 0 THEN o_orderpriority END "
        "AS ethnicity_category",
        "cast(o_orderdate AS date) AS recorded",
        "o_orderkey AS record_id",
    )


def lsoa_lookup(spark: SparkSession, sf_dir: str, prefix: str = "L") -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        f"'{prefix}' || {_two_digits('n_nationkey')} AS lsoa",
        "r_name AS locality",
        "n_nationkey % 10 + 1 AS imd_decile",
        "cast((n_nationkey % 10 + 2) div 2 AS int) AS imd_quintile",
    )


def ethnicity_coding(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ETHNICITY_CODES, "national_code string, national_code_definition string")


def admission_method_lookup(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ADMISSION_METHODS, "admission_method_description string, admission_group string")


def icd10_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code listing with several codes per subgroup, other chapters and short codes; `position` is the file order."""
    code = (
        f"if(p_partkey % 23 = 0, 'J', 'I') || {_two_digits('p_partkey % 100')} "
        "|| cast(p_partkey div 100 % 10 AS string)"
    )
    return table(spark, sf_dir, "part").selectExpr(
        f"left({code}, if(p_partkey % 50 = 49, 2, 4)) AS icd10_code",
        "p_name || ' ' || cast(p_partkey AS string) AS icd10_short_title",
        "p_type AS simplified_cause",
        "p_partkey AS position",
    )


def clinical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per three-character code; some codes are filed under another letter and so stay unmatched."""
    numbers = table(spark, sf_dir, "part").selectExpr("p_partkey % 100 AS number").distinct()
    return numbers.selectExpr(
        f"if(number % 23 = 5, 'K', 'I') || {_two_digits('number')} AS code",
        "'Group ' || cast(number div 50 AS string) AS clinical_group",
        "if(number % 17 = 0, 'Not CVD', 'Subgroup ' || cast(number div 10 AS string)) AS clinical_subgroup",
    )


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census cells: one per customer."""
    labels = ", ".join(f"'{v}'" for v in [*CENSUS_ETHNICITY, "Does not apply"])
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(least(c_custkey % 100, 90) AS int) AS age_code",
        f"get(array({labels}), cast((c_custkey * 7 + c_custkey div 100) % 20 AS int)) AS ethnic_group_20",
        "if(c_custkey % 2 = 0, 'Male', 'Female') AS sex",
        f"'M' || {_two_digits('c_nationkey')} AS lsoa",
        "1000 + c_custkey % 7 AS observation",
    )
