from popmeasure.functions.bands import age_group, band, five_year_band, in_levels, quintile_from_decile, two_bands
from popmeasure.functions.codes import (
    any_code_matches,
    classify,
    code_match,
    code_prefix,
    label_of,
    numbered,
    span,
)
from popmeasure.functions.dates import date_range, within_days
from popmeasure.functions.stats import (
    Z95,
    byar_lower,
    byar_upper,
    null_max,
    null_sum,
    percentage,
    ratio,
    wilson_bounds,
    wilson_half_width,
    years_of_life_lost,
)
from popmeasure.functions.text import after_first, before_first, fill_null, null_if, relabel

__all__ = [
    "Z95",
    "after_first",
    "age_group",
    "any_code_matches",
    "band",
    "before_first",
    "byar_lower",
    "byar_upper",
    "classify",
    "code_match",
    "code_prefix",
    "date_range",
    "fill_null",
    "five_year_band",
    "in_levels",
    "label_of",
    "null_if",
    "null_max",
    "null_sum",
    "numbered",
    "percentage",
    "quintile_from_decile",
    "ratio",
    "relabel",
    "span",
    "two_bands",
    "wilson_bounds",
    "wilson_half_width",
    "within_days",
    "years_of_life_lost",
]
