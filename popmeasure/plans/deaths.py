"""Deaths and years of life lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions import age_group, years_of_life_lost
from popmeasure.functions.stats import null_sum
from popmeasure.operators.breakdown import by_area, by_characteristic
from popmeasure.operators.extract import any_code_filter, extract_deaths
from popmeasure.operators.measures import share_of_total, yearly, yearly_count

CLINICAL = ("clinical_subgroup", "clinical_group")
ICD10 = ("icd10_short_title", "cvd_group")
CHARACTERISTICS = ("sex", "locality", "imd_quintile", "ethnicity")
YEARS = 10


def death_cohort(
    register: DataFrame,
    ethnicity: DataFrame,
    areas: Sequence[str],
    start: str = "2014-01-01",
    end: str = "2023-12-31",
    prefix: str = "I",
    salts: int = 1,
    salt_by: Sequence[str] = (),
) -> DataFrame:
    """Residents' deaths with a cause under `prefix` at any position, with ethnicity. All filters precede the join."""
    return extract_deaths(any_code_filter(register, prefix), ethnicity, areas, start, end, salts, salt_by)


def with_yll(df: DataFrame, age: str = "age", weight: str | None = None) -> DataFrame:
    return df.withColumn("yll", years_of_life_lost(age, weight=weight))


def deaths_by_area(
    df: DataFrame,
    areas: Mapping[str, Sequence[str]],
    keys: Sequence[str] = CLINICAL,
    years: float = YEARS,
    weight: str | None = None,
) -> DataFrame:
    """Yearly deaths and years of life lost by group, for areas and their unions."""
    return by_area(with_yll(df, weight=weight), keys, "local_authority", areas, years, "deaths", weight, "yll")


def deaths_by_characteristic(
    df: DataFrame,
    keys: Sequence[str] = CLINICAL,
    characteristics: Sequence[str] = CHARACTERISTICS,
    years: float = YEARS,
    weight: str | None = None,
) -> DataFrame:
    """Yearly deaths and years of life lost by group, for each level of each characteristic."""
    aggs = [
        yearly(years, weight).alias("deaths"),
        (null_sum("yll") / F.lit(float(years))).alias("yll"),
    ]
    return by_characteristic(with_yll(df, weight=weight), characteristics, aggs, keys)


def deaths_by_age(
    df: DataFrame, keys: Sequence[str] = CLINICAL, years: float = YEARS, weight: str | None = None
) -> DataFrame:
    """Yearly deaths by group and age group, in age order (an unknown age comes first)."""
    counted = yearly_count(
        df.withColumn("age_group_ord", age_group("age", order=True)),
        [*keys, "age_group", "age_group_ord"],
        years,
        weight=weight,
    )
    return counted.orderBy(*keys, "age_group_ord")


def share_of_deaths(df: DataFrame, key: str = "clinical_subgroup", weight: str | None = None) -> DataFrame:
    return share_of_total(df, key, weight, "deaths", "total_deaths", "percentage_deaths")
