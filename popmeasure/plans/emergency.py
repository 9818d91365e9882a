"""Share of emergency admissions with Wilson intervals. The input carries the nullable flag `emergency`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from popmeasure.functions import Z95, two_bands
from popmeasure.functions.bands import quintile_from_decile
from popmeasure.operators.breakdown import proportion_by_characteristic, proportion_by_pair
from popmeasure.operators.extract import exclude
from popmeasure.operators.intervals import wilson_ci, with_constants
from popmeasure.operators.matrix import matrix_cells, matrix_margins
from popmeasure.operators.measures import proportion, with_group_mean
from popmeasure.operators.reshape import recode
from popmeasure.sources.constants import MATRIX_ETHNICITY

CHARACTERISTICS = ("locality", "imd_quintile", "age_group", "gender", "ethnicity", "gp_code")
UNDER, OVER = "Under 75", "75 and over"


def with_age_category(df: DataFrame, age: str = "age_on_admission") -> DataFrame:
    """Two age categories; an unknown age counts as 75 and over."""
    return df.withColumn("age_category", two_bands(age, 75, UNDER, OVER))


def under_75(df: DataFrame) -> DataFrame:
    return with_age_category(df).filter(f"age_category = '{UNDER}'")


def emergency_by_characteristic(
    df: DataFrame, characteristics: Sequence[str] = CHARACTERISTICS, area_code: str | None = None
) -> DataFrame:
    out = proportion_by_characteristic(df, characteristics, "emergency")
    return out if area_code is None else with_constants(out, area_code=area_code, z=Z95)


def emergency_by_pair(
    df: DataFrame, pair: Sequence[str], mean_by: str | None = None, excluded: Sequence[str] = ()
) -> DataFrame:
    """Cells of two characteristics.

    `mean_by` adds the mean percentage per panel, after the rows whose `mean_by` is in `excluded` are gone.
    """
    cells = proportion_by_pair(df, pair, "emergency")
    if mean_by is None:
        return cells
    if excluded:
        cells = exclude(cells, mean_by, excluded)
    return with_group_mean(cells, mean_by, "percentage")


def emergency_by_subgroup(df: DataFrame, key: str = "clinical_subgroup", dropped: str = "Not CVD") -> DataFrame:
    rows = proportion(exclude(df, key, dropped), [key], "emergency")
    return wilson_ci(rows.drop("emergency_percentage"), "emergency_admissions", "total_admissions")


def matrix_input(cells: DataFrame) -> DataFrame:
    """Decile x broad-ethnicity cells to quintile x short-label cells."""
    short = recode(cells.withColumnRenamed("ethnicity_broad", "ethnicity"), "ethnicity", MATRIX_ETHNICITY)
    coarse = short.withColumn("imd_quintile", quintile_from_decile("imd_decile"))
    return matrix_cells(coarse, "imd_quintile", "ethnicity", "emergency_admissions", "total_admissions")


def margins(cells: DataFrame, by: str) -> DataFrame:
    return matrix_margins(cells, by, "emergency_admissions", "total_admissions")
