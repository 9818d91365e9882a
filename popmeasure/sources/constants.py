"""Fixed values of the study. Every function that uses one of them also accepts another list."""

from __future__ import annotations

from popmeasure.functions.bands import AGE_GROUP_CUTS, AGE_GROUP_LABELS, FIVE_YEAR_BANDS
from popmeasure.functions.codes import span

__all__ = [
    "AGE_GROUP_CUTS",
    "AGE_GROUP_LABELS",
    "CENSUS_ETHNICITY",
    "FIVE_YEAR_BANDS",
    "ICD10_GROUP_RULES",
    "MATRIX_ETHNICITY",
    "SEX_LABELS",
    "STANDARD_POPULATION",
]

# European Standard Population 2013, one weight per five-year band, sum 100,000.
STANDARD_POPULATION = [
    5000, 5500, 5500, 5500, 6000, 6000, 6500, 7000, 7000, 7000,
    7000, 6500, 6000, 5500, 5000, 4000, 2500, 1500, 1000,
]

# Sex codes of the death register.
SEX_LABELS = {1: "Male", 2: "Female"}

# ICD-10 chapter I blocks, first match wins. Two peculiarities belong to the definition: I50 to I52
# count at any position of the code, and I95 to I99 carry the rheumatic label. Pass other rules to change that.
ICD10_GROUP_RULES = [
    (span(("I00", "I02")), "Acute rheumatic fever"),
    (span(("I05", "I09")), "Chronic rheumatic heart diseases"),
    (span(("I10", "I15")), "Hypertensive diseases"),
    (span(("I20", "I25")), "Ischaemic heart diseases"),
    (span(("I26", "I28")), "Pulmonary heart disease and diseases of pulmonary circulation"),
    (span(("I30", "I39"), ("I40", "I49"), anywhere=("I50", "I51", "I52")), "Other forms of heart disease"),
    (span(("I60", "I69")), "Cerebrovascular diseases"),
    (span(("I70", "I79")), "Diseases of arteries, arterioles and capillaries"),
    (span(("I80", "I89")), "Diseases of veins, lymphatic vessels and lymph nodes, not elsewhere classified"),
    (span(("I95", "I99")), "Chronic rheumatic heart diseases"),
]

# Census 2021 ethnic group -> ethnic category used in health records.
CENSUS_ETHNICITY = {
    "Asian, Asian British or Asian Welsh: Bangladeshi": "Asian or Asian British - Bangladeshi",
    "Asian, Asian British or Asian Welsh: Chinese": "Other Ethnic Groups - Chinese",
    "Asian, Asian British or Asian Welsh: Indian": "Asian or Asian British - Indian",
    "Asian, Asian British or Asian Welsh: Pakistani": "Asian or Asian British - Pakistani",
    "Asian, Asian British or Asian Welsh: Other Asian": "Asian or Asian British - Any other Asian background",
    "Black, Black British, Black Welsh, Caribbean or African: African": "Black or Black British - African",
    "Black, Black British, Black Welsh, Caribbean or African: Caribbean": "Black or Black British - Caribbean",
    "Black, Black British, Black Welsh, Caribbean or African: Other Black": (
        "Black or Black British - Any other Black background"
    ),
    "Mixed or Multiple ethnic groups: White and Asian": "Mixed - White and Asian",
    "Mixed or Multiple ethnic groups: White and Black African": "Mixed - White and Black African",
    "Mixed or Multiple ethnic groups: White and Black Caribbean": "Mixed - White and Black Caribbean",
    "Mixed or Multiple ethnic groups: Other Mixed or Multiple ethnic groups": "Mixed - Any other mixed background",
    "White: English, Welsh, Scottish, Northern Irish or British": "White - British",
    "White: Irish": "White - Irish",
    "White: Gypsy or Irish Traveller": "White - Any other White background",
    "White: Roma": "White - Any other White background",
    "White: Other White": "White - Any other White background",
    "Other ethnic group: Arab": "Other Ethnic Groups - Any other ethnic group",
    "Other ethnic group: Any other ethnic group": "Other Ethnic Groups - Any other ethnic group",
}

# Short names used in the deprivation x ethnicity matrix (the trailing blanks are part of the label).
MATRIX_ETHNICITY = {
    "Asian or Asian British ": "Asian",
    "Black or Black British ": "Black",
    "Other Ethnic Groups ": "Other",
}
