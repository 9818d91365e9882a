"""Age-standardised rates for six strata.

Each plan stacks event rows on census rows and aggregates them once by stratum and age band; the rate is a second
aggregate over these few cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions import after_first, before_first, five_year_band, in_levels, null_if, relabel
from popmeasure.operators.standardise import dsr, rate_inputs, regroup
from popmeasure.sources.constants import CENSUS_ETHNICITY

MIXED = {"Mixed ": " Mixed"}
MIXED_AND_OTHER = {"Mixed ": " Mixed", "Other Ethnic Groups ": " Other Ethnic Groups"}


def with_band(df: DataFrame, age: str) -> DataFrame:
    return df.withColumn("age_band", five_year_band(age))


def with_health_ethnicity(census: DataFrame) -> DataFrame:
    """Census labels to health-record labels; rows without a counterpart are dropped."""
    return census.withColumn("ethnicity", relabel("ethnic_group_20", CENSUS_ETHNICITY)).dropna(subset=["ethnicity"])


def split_ethnicity(df: DataFrame) -> DataFrame:
    """`Broad - Detail` to ethnicity_broad and ethnicity (blanks kept); British becomes White British."""
    return df.withColumns(
        {
            "ethnicity_broad": before_first("ethnicity", "-"),
            "ethnicity": relabel(after_first("ethnicity", "-"), {" British": " White British"}, keep_other=True),
        }
    )


def merge_small(df: DataFrame, merged: dict[str, str]) -> DataFrame:
    """Use one detail label for all of a broad group."""
    detail = F.coalesce(relabel("ethnicity_broad", merged), F.col("ethnicity"))
    return df.withColumn("ethnicity", detail)


def population_rate(events: DataFrame, census: DataFrame, years: float) -> DataFrame:
    return dsr(rate_inputs(events, census, ["age_band"], years))


def ethnicity_inputs(events: DataFrame, census: DataFrame, years: float, extra: Sequence[str] = ()) -> DataFrame:
    """Counts and populations by ethnicity and band; events of unknown ethnicity are left out."""
    known = events.dropna(subset=["ethnicity"])
    keys = ["ethnicity", *extra, "age_band"]
    return split_ethnicity(rate_inputs(known, with_health_ethnicity(census), keys, years))


def ethnicity_rate(
    events: DataFrame, census: DataFrame, years: float, merged: dict[str, str] | None = None
) -> DataFrame:
    cells = ethnicity_inputs(events, census, years)
    if merged:
        cells = regroup(merge_small(cells, merged), ["ethnicity", "ethnicity_broad", "age_band"])
    return dsr(cells, ["ethnicity", "ethnicity_broad"])


def known_ethnicity_rate(events: DataFrame, census: DataFrame, years: float) -> DataFrame:
    """Whole-population rate of the events with a known ethnicity that the ethnicity strata count."""
    return dsr(rate_inputs(events.dropna(subset=["ethnicity"]), census, ["age_band"], years))


def sex_ethnicity_rate(
    events: DataFrame, census: DataFrame, years: float, broad: bool = False, merged: dict[str, str] | None = None
) -> DataFrame:
    """By sex and ethnicity, or by sex and broad ethnicity only."""
    cells = ethnicity_inputs(events, census, years, ["sex"])
    if broad:
        return dsr(regroup(cells, ["ethnicity_broad", "sex", "age_band"]), ["ethnicity_broad", "sex"])
    keys = ["ethnicity", "ethnicity_broad", "sex"]
    return dsr(regroup(merge_small(cells, merged or {}), [*keys, "age_band"]), keys)


def deprivation_rate(
    events: DataFrame, census: DataFrame, years: float, level: str, levels: int, fill_missing_count: bool = True
) -> DataFrame:
    """By deprivation decile or quintile, an ordered category 1..levels.

    With `fill_missing_count` off, an age band without events takes no part instead of counting as zero.
    """
    cells = rate_inputs(events, census, [level, "age_band"], years, fill_missing_count=fill_missing_count)
    cells = cells.withColumn(level, in_levels(level, 1, levels))
    return dsr(cells, [level], fill_missing_count=fill_missing_count)


def known_gender(df: DataFrame, column: str = "gender", out: str = "sex") -> DataFrame:
    """Admissions with a stated gender."""
    return df.withColumn(out, null_if(column, "Not known")).dropna(subset=[out])
