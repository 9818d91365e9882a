"""Hospital admissions: the cohort and its counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from popmeasure.operators.breakdown import by_area, by_characteristic
from popmeasure.operators.compare import shares_long, side_by_side
from popmeasure.operators.episodes import episodes, first_in_gap, first_per_key
from popmeasure.operators.extract import EXTRACT_COLUMNS, extract_admissions, resident_spells, with_person_ethnicity
from popmeasure.operators.measures import share_of_total, yearly, yearly_count
from popmeasure.operators.numbering import number_in_key
from popmeasure.sources.storage import save_bucketed

CHARACTERISTICS = ("locality", "imd_quintile", "age_group", "gender", "ethnicity")
YEARS = 6


def admission_cohort(
    diagnoses: DataFrame,
    geography: DataFrame,
    ethnicity: DataFrame,
    areas: Sequence[str],
    start: str = "2018-04-01",
    end: str = "2024-04-01",
    gap_days: int = 90,
) -> DataFrame:
    """Extract, then keep the first of each chain of admissions of a person for one diagnosis group.

    `rn` is the place of a kept admission among all of its person and diagnosis group.

    The gap rule runs before the person join. It leaves at most one row per person, diagnosis group and gap-long
    period, so a person with a large part of all rows no longer weighs on the join. Rows that a repeated person in
    `ethnicity` would have added fall on the same day and are repeats by that rule; hence one row per person is joined.
    """
    own = [c for c in EXTRACT_COLUMNS if c not in ("ethnic_code", "ethnic_grouping")]
    spells = resident_spells(diagnoses, geography, areas, start, end).select(*own, "episode_id")
    keys = ["nhs_number", "diagnosis_group"]
    firsts = first_in_gap(spells, keys, "admission_date", gap_days, tie="episode_id", number="rn")
    people = first_per_key(
        ethnicity.select("pseudo_nhs_number", "ethnic_code", "ethnic_grouping"),
        "pseudo_nhs_number",
        ["ethnic_code", "ethnic_grouping"],
    )
    return with_person_ethnicity(firsts, people, keep=("episode_id", "rn"))


def bucketed_inputs(
    diagnoses: DataFrame,
    geography: DataFrame,
    ethnicity: DataFrame,
    areas: Sequence[str],
    start: str = "2018-04-01",
    end: str = "2024-04-01",
    buckets: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Spells and people stored by person with the same buckets: studies that reread them shuffle neither again."""
    own = [c for c in EXTRACT_COLUMNS if c not in ("ethnic_code", "ethnic_grouping")]
    spells = resident_spells(diagnoses, geography, areas, start, end).select(*own, "episode_id")
    people = ethnicity.select("pseudo_nhs_number", "ethnic_code", "ethnic_grouping")
    return (
        save_bucketed(spells, "nhs_number", buckets, ["diagnosis_group", "admission_date"]),
        save_bucketed(people, "pseudo_nhs_number", buckets),
    )


def cohort_from_buckets(spells: DataFrame, people: DataFrame, gap_days: int = 90) -> DataFrame:
    """The cohort of `admission_cohort` from the tables of `bucketed_inputs`."""
    keys = ["nhs_number", "diagnosis_group"]
    firsts = first_in_gap(spells, keys, "admission_date", gap_days, tie="episode_id", number="rn")
    first_of = first_per_key(people, "pseudo_nhs_number", ["ethnic_code", "ethnic_grouping"])
    return with_person_ethnicity(firsts, first_of, keep=("episode_id", "rn"))


def numbered_admissions(
    diagnoses: DataFrame,
    geography: DataFrame,
    ethnicity: DataFrame,
    areas: Sequence[str],
    start: str = "2018-04-01",
    end: str = "2024-04-01",
    salts: int = 1,
) -> DataFrame:
    """The whole extract with `rn`: the place of an admission among those of its person and diagnosis group."""
    rows = extract_admissions(diagnoses, geography, ethnicity, areas, start, end, keep=("episode_id",), salts=salts)
    return number_in_key(rows, ["nhs_number", "diagnosis_group"], "admission_date", tie="episode_id", out="rn")


def admission_episodes(
    diagnoses: DataFrame,
    geography: DataFrame,
    areas: Sequence[str],
    start: str = "2018-04-01",
    end: str = "2024-04-01",
    gap_days: int = 90,
) -> DataFrame:
    """Each chain of admissions of a person for one diagnosis group: its first and last date and its length."""
    spells = resident_spells(diagnoses, geography, areas, start, end)
    return episodes(spells, ["nhs_number", "diagnosis_group"], "admission_date", gap_days)


def in_person_order(df: DataFrame) -> DataFrame:
    """Sort by person. Date and episode complete the sort key, so that the range partitions can split one person."""
    return df.orderBy("nhs_number", "admission_date", "episode_id")


def admissions_by_area(
    df: DataFrame, keys: Sequence[str], areas: Mapping[str, Sequence[str]], years: float = YEARS
) -> DataFrame:
    return by_area(df, keys, "local_authority", areas, years, "hospitalisations")


def admissions_by_characteristic(
    df: DataFrame,
    keys: Sequence[str],
    characteristics: Sequence[str] = CHARACTERISTICS,
    years: float = YEARS,
) -> DataFrame:
    return by_characteristic(df, characteristics, [yearly(years).alias("hospitalisations")], keys)


def admission_methods(df: DataFrame, years: float = YEARS) -> DataFrame:
    return yearly_count(df, ["admission_method_description"], years, "average_admissions")


def share_of_admissions(df: DataFrame, key: str) -> DataFrame:
    return share_of_total(df, key, None, "hospitalisations", "total_hospitalisations", "percentage_hospitalisations")


def deaths_vs_admissions(admission_shares: DataFrame, death_shares: DataFrame, key: str) -> DataFrame:
    """Share of admissions and share of deaths per category, one row per category and outcome."""
    names = {"percentage_hospitalisations": "Hospitalisations", "percentage_deaths": "Deaths"}
    return shares_long(
        admission_shares, death_shares, key, "percentage_hospitalisations", "percentage_deaths", names
    )


def yearly_deaths_vs_admissions(admissions: DataFrame, deaths: DataFrame, key: str, group: str) -> DataFrame:
    """Yearly admissions next to yearly deaths and years of life lost."""
    return side_by_side(admissions, deaths, key, drop=(group,))
