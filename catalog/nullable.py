"""Result columns that hold nulls among whole numbers or booleans.

Data frames of other tools show such a column as floating point or as a nullable integer, depending on the tool. Both
sides of the comparison therefore return the numbers as DOUBLE and the flag as text.
"""

NUMBERS = {
    "csv_round_trip": ["age"],
    "full_join_repeated_keys": ["n", "age_code", "population_count"],
    "matrix_all_margins": ["imd_quintile"],
    "schema_difference": [f"{side}_{c}" for side in ("first", "second") for c in ("rows", "nulls", "distinct_values")],
    "extract_deaths_rows": ["age", "is_deceased"],
    "death_cohort_rows": ["age", "is_deceased"],
    "lookup_join_salted": ["is_deceased"],
    "age_group_counts": ["age_group_ord"],
    "five_year_band_counts": ["age_band_ord"],
    "quintiles_and_levels": ["imd_decile", "from_decile", "low_levels"],
    "lookup_join_null_safe": ["imd_quintile"],
    "counts_join_population": ["age_code", "population_count"],
    "deaths_weighted_by_age": ["age_group_ord"],
    "emergency_imd_sex": ["imd_quintile"],
    "emergency_imd_sex_under_75": ["imd_quintile"],
    "emergency_imd_ethnicity": ["imd_decile"],
    "emergency_imd_age": ["imd_quintile"],
    "dsr_input_gaps": ["imd_quintile"],
    **{f"deaths_by_age_{s}_{g}": ["age_group_ord"] for s in ("primary", "all_cause") for g in ("clinical", "icd10")},
    **{f"dsr_imd_{q}_{o}": [f"imd_{q}", "total_pop"] for q in ("decile", "quintile") for o in ("admissions", "deaths")},
    **{f"dsr_{s}_{o}": ["total_pop"] for s in ("ethnicity", "sex_ethnicity") for o in ("admissions", "deaths")},
    "dsr_zero_population": ["imd_decile", "total_pop"],
    **{f"deaths_vs_hosp_long_{g}": ["deaths", "total_deaths"] for g in ("clinical", "icd10")},
}
FLAGS = {"quality_flag_counts": ["emergency"]}
