"""Canonical schemas of the logical tables, as DDL. `load_table(..., schema=schema_of(name))` enforces them."""

from __future__ import annotations

from pyspark.sql import types as T

CAUSE_COLUMNS = ["s_underlying_cod_icd10"] + [f"s_cod_code_{k}" for k in range(1, 16)]

_CAUSES = ", ".join(f"{c} string" for c in CAUSE_COLUMNS)
MULTI_CAUSE_COLUMNS = [f"cause_{k}" for k in range(1, 9)]
_CENSUS = "age_code int, observation bigint"

TABLES = {
    "episode_diagnosis": (
        "episode_id bigint, nhs_number string, diagnosis_code string, diagnosis_order int, order_in_spell int, "
        "provider_code string, provider_name string, gender string, age_on_admission int, admission_date date, "
        "admission_source_code string, admission_source_description string, "
        "admission_method_code string, admission_method_description string"
    ),
    "episode_geography": (
        "episode_id bigint, local_authority string, constituency string, lsoa_2011 string, lsoa_2021 string, "
        "gp_code string"
    ),
    "ethnicity": "pseudo_nhs_number string, ethnic_code string, ethnic_grouping string, is_deceased int",
    "mh_patient_index": "pseudo_nhs_number string, ethnic_code string, ethnicity_category string",
    "deaths_register": (
        "patient_id string, sex int, marital_status string, age int, underlying_chapter string, lsoa string, "
        "la_code string, place_of_death_code string, residence_la_code string, reg_date date, " + _CAUSES
    ),
    "weighted_deaths": (
        "residence_la_code string, underlying_cause string, deaths bigint, sex int, age int, lsoa string"
    ),
    "multi_cause_deaths": (
        "residence_la_code string, sex int, age int, lsoa string, "
        + ", ".join(f"{c} string" for c in MULTI_CAUSE_COLUMNS)
    ),
    "lsoa_lookup": "lsoa string, locality string, imd_decile int, imd_quintile int",
    "icd10_listing": "icd10_code string, icd10_short_title string, simplified_cause string",
    "clinical_group": "code string, icd10_short_title string, clinical_group string, clinical_subgroup string",
    "ethnicity_coding": "national_code string, national_code_definition string",
    "admission_method_lookup": "admission_method_description string, admission_group string",
    "census_age": _CENSUS,
    "census_ethnicity_age": _CENSUS + ", ethnic_group_20 string",
    "census_ethnicity_sex_age": _CENSUS + ", ethnic_group_20 string, sex string",
    "census_lsoa_age": _CENSUS + ", lsoa string",
    "standard_population": "age_band string, standard_population int",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
