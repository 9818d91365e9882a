"""Whole sets of result tables from one base.

The base (events with their lookups) is read by several breakdowns. `temp_table(..., materialise=True)` computes it
once into the cluster's checkpoint folder; the result tables are then written as long tables, partitioned by area or
characteristic, in place of one file per area and characteristic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from popmeasure.plans import admissions, deaths
from popmeasure.sources.tables import save_table, temp_table


def write_death_tables(
    base: DataFrame,
    path: str,
    areas: Mapping[str, Sequence[str]],
    keys: Sequence[str] = deaths.CLINICAL,
    share_key: str = "clinical_subgroup",
    characteristics: Sequence[str] = deaths.CHARACTERISTICS,
    years: float = deaths.YEARS,
    materialise: bool = True,
) -> None:
    """Deaths and years of life lost by area, characteristic and age, and shares, under `path`."""
    rows = temp_table(base, "death_base", materialise)
    save_table(deaths.deaths_by_area(rows, areas, keys, years), f"{path}/by_area", ["area"])
    save_table(
        deaths.deaths_by_characteristic(rows, keys, characteristics, years),
        f"{path}/by_characteristic",
        ["characteristic"],
    )
    save_table(deaths.deaths_by_age(rows, keys, years), f"{path}/by_age")
    save_table(deaths.share_of_deaths(rows, share_key), f"{path}/share")


def write_admission_tables(
    base: DataFrame,
    path: str,
    areas: Mapping[str, Sequence[str]],
    keys: Sequence[str],
    share_key: str,
    characteristics: Sequence[str] = admissions.CHARACTERISTICS,
    years: float = admissions.YEARS,
    materialise: bool = True,
) -> None:
    """Admissions by area and characteristic, shares and admission methods, under `path`."""
    rows = temp_table(base, "admission_base", materialise)
    save_table(admissions.admissions_by_area(rows, keys, areas, years), f"{path}/by_area", ["area"])
    save_table(
        admissions.admissions_by_characteristic(rows, keys, characteristics, years),
        f"{path}/by_characteristic",
        ["characteristic"],
    )
    save_table(admissions.share_of_admissions(rows, share_key), f"{path}/share")
    save_table(admissions.admission_methods(rows, years), f"{path}/methods")
