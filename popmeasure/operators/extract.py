"""Cohort extracts from episode and death-register tables. Filters come first so that they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions.codes import any_code_matches, code_prefix
from popmeasure.functions.dates import date_range
from popmeasure.operators.enrich import enrich
from popmeasure.sources.schemas import CAUSE_COLUMNS

EXTRACT_COLUMNS = [
    "nhs_number",
    "diagnosis_group",
    "provider_code",
    "provider_name",
    "local_authority",
    "constituency",
    "lsoa_2011",
    "lsoa_2021",
    "gp_code",
    "ethnic_code",
    "ethnic_grouping",
    "gender",
    "age_on_admission",
    "admission_date",
    "admission_source_code",
    "admission_source_description",
    "admission_method_code",
    "admission_method_description",
]


def resident_spells(
    diagnoses: DataFrame,
    geography: DataFrame,
    areas: Sequence[str],
    start: str = "2018-04-01",
    end: str = "2024-04-01",
    code: str = "I",
) -> DataFrame:
    """One row per spell with a primary diagnosis under `code`, admitted in [start, end) by an area's resident.

    The area test makes the geography join an inner one and reaches the geography scan. The key of the join is the
    episode, so no key is hot.
    """
    spells = diagnoses.filter(
        F.startswith(F.col("diagnosis_code"), F.lit(code))
        & (F.col("diagnosis_order") == 1)
        & (F.col("order_in_spell") == 1)
        & date_range("admission_date", start, end)
        & F.col("nhs_number").isNotNull()
    ).withColumn("diagnosis_group", code_prefix("diagnosis_code"))
    return enrich(spells, geography, "episode_id", null_safe=False).filter(
        F.col("local_authority").isin(list(areas))
    )


def with_person_ethnicity(
    spells: DataFrame, ethnicity: DataFrame, keep: Sequence[str] = (), salts: int = 1, salt_by: Sequence[str] = ()
) -> DataFrame:
    """Add the person's ethnicity and select the extract's columns, and those in `keep`."""
    people = ethnicity.select("pseudo_nhs_number", "ethnic_code", "ethnic_grouping")
    on = {"nhs_number": "pseudo_nhs_number"}
    joined = enrich(spells, people, on, null_safe=False, salts=salts, salt_by=salt_by)
    return joined.select(*EXTRACT_COLUMNS, *keep)


def extract_admissions(
    diagnoses: DataFrame,
    geography: DataFrame,
    ethnicity: DataFrame,
    areas: Sequence[str],
    start: str = "2018-04-01",
    end: str = "2024-04-01",
    code: str = "I",
    keep: Sequence[str] = (),
    salts: int = 1,
) -> DataFrame:
    """Residents' spells with ethnicity. A person listed twice in `ethnicity` doubles the rows.

    `keep` names further columns of the inputs, for instance the episode id as a tie-break. `salts` spreads the spells
    of one person over that many partitions of the person join.
    """
    spells = resident_spells(diagnoses, geography, areas, start, end, code)
    return with_person_ethnicity(spells, ethnicity, keep, salts, ["episode_id"])


def extract_deaths(
    register: DataFrame,
    ethnicity: DataFrame,
    areas: Sequence[str],
    start: str = "2014-01-01",
    end: str = "2023-12-31",
    salts: int = 1,
    salt_by: Sequence[str] = (),
) -> DataFrame:
    """Deaths registered from `start` to `end`, both included, of residents of the areas, with ethnicity.

    With `salts` and `salt_by` (see `enrich`) a repeated person id is spread over several partitions of the person join.
    """
    chosen = register.filter(
        date_range("reg_date", start, end, closed=True) & F.col("residence_la_code").isin(list(areas))
    ).drop("reg_date")
    people = ethnicity.select("pseudo_nhs_number", "ethnic_code", "ethnic_grouping", "is_deceased")
    on = {"patient_id": "pseudo_nhs_number"}
    return enrich(chosen, people, on, null_safe=False, salts=salts, salt_by=salt_by)


def any_code_filter(df: DataFrame, prefix: str = "I", columns: Sequence[str] = tuple(CAUSE_COLUMNS)) -> DataFrame:
    """Rows with a code under `prefix` in any of the columns."""
    return df.filter(any_code_matches(columns, prefix))


def usable_ethnicity(index: DataFrame) -> DataFrame:
    """Rows of a patient index with a stated ethnic category and a person id."""
    return index.filter(
        F.col("ethnicity_category").isNotNull()
        & (F.col("ethnicity_category") != "")
        & (F.col("ethnic_code") != "Z")
        & F.col("pseudo_nhs_number").isNotNull()
    )


def filter_codes(df: DataFrame, column: str, pattern: str = "^I") -> DataFrame:
    """Rows whose code fits the regular expression."""
    return df.filter(F.col(column).rlike(pattern))


def exclude(df: DataFrame, column: str, values: str | Sequence[str]) -> DataFrame:
    """Rows whose category is none of the values; a null category is dropped as well."""
    values = [values] if isinstance(values, str) else list(values)
    return df.filter(~F.col(column).isin(values))
