import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from popmeasure.functions import (
    Z95,
    after_first,
    age_group,
    any_code_matches,
    band,
    before_first,
    byar_lower,
    byar_upper,
    classify,
    code_match,
    code_prefix,
    date_range,
    fill_null,
    five_year_band,
    in_levels,
    null_if,
    null_sum,
    quintile_from_decile,
    relabel,
    span,
    two_bands,
    wilson_bounds,
    wilson_half_width,
    within_days,
    years_of_life_lost,
)
from popmeasure.sources.constants import ICD10_GROUP_RULES, SEX_LABELS, STANDARD_POPULATION


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


PATTERNS = [
    ("^I0[0-2]", "Acute rheumatic fever"),
    ("^I0[5-9]", "Chronic rheumatic heart diseases"),
    ("^I1[0-5]", "Hypertensive diseases"),
    ("^I2[0-5]", "Ischaemic heart diseases"),
    ("^I2[6-8]", "Pulmonary heart disease and diseases of pulmonary circulation"),
    ("^I[3-4]\\d|I5[0-2]", "Other forms of heart disease"),
    ("^I6[0-9]", "Cerebrovascular diseases"),
    ("^I7[0-9]", "Diseases of arteries, arterioles and capillaries"),
    ("^I8[0-9]", "Diseases of veins, lymphatic vessels and lymph nodes, not elsewhere classified"),
    ("^I9[5-9]", "Chronic rheumatic heart diseases"),
]


def test_icd_groups_equal_the_patterns_on_every_code(spark):
    codes = [f"{c}{n:02d}{t}" for c in "IJX" for n in range(100) for t in ("", "1", ".9")]
    codes += ["I", "I2", "i20", "XI50", "J99I52", "I3A", "I4:", "I0:", "I2/", "", "I29I51", None]
    want = [
        None if c is None else next((label for p, label in PATTERNS if re.search(p, c)), None) for c in codes
    ]
    assert column(spark, codes, classify("v", ICD10_GROUP_RULES)) == want
    assert column(spark, codes, classify("v", PATTERNS)) == want


def test_span_rejects_ranges_it_cannot_express():
    with pytest.raises(ValueError):
        span(("I10", "I25"))


def test_code_pieces(spark):
    codes = ["I251", "I25", "I2", "", "XI50", None]
    assert column(spark, codes, code_prefix("v")) == ["I25", "I25", "I2", "", "XI5", None]
    assert column(spark, codes, code_prefix("v", strict=True)) == ["I25", "I25", None, None, "XI5", None]
    assert column(spark, codes, code_match("v", r"I\d{2}")) == ["I25", "I25", None, None, "I50", None]


def test_any_code_ignores_nulls(spark):
    rows = [(None, "I20"), ("J10", None), (None, None), ("I10", "J10"), ("XI1", "J")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [tuple(r) for r in df.filter(any_code_matches(["a", "b"], "I")).collect()] == [rows[0], rows[3]]


def test_text_pieces(spark):
    values = ["White - British", "Unknown", "A - B - C", "Mixed-x", None]
    assert column(spark, values, before_first("v", "-")) == ["White ", "Unknown", "A ", "Mixed", None]
    assert column(spark, values, after_first("v", "-")) == [" British", "Unknown", " B - C", "x", None]


def test_relabel(spark):
    values = [1, 2, 0, None]
    assert column(spark, values, relabel("v", SEX_LABELS), "int") == ["Male", "Female", None, None]
    assert column(spark, values, relabel("v", {1: "Male"}, default="Female"), "int") == ["Male"] + ["Female"] * 3
    kept = relabel("v", {"a ": "A"}, keep_other=True)
    assert column(spark, ["a ", "a", None], kept) == ["A", "a", None]
    assert column(spark, ["x", None], fill_null("v", "Unknown")) == ["x", "Unknown"]
    assert column(spark, ["x", "NULL"], null_if("v", "NULL")) == ["x", None]


def test_age_bands(spark):
    ages = [-1, 0, 4, 5, 14, 15, 16, 30, 31, 74, 75, 89, 90, 91, 120, None]
    groups = ["0 - 15"] * 6 + ["16 - 30"] * 2 + ["31 - 45", "61 - 75", "61 - 75", "76 - 90", "76 - 90"]
    groups += [">= 91", ">= 91", None]
    assert column(spark, ages, age_group("v"), "int") == groups
    bands = [None, "0-4", "0-4", "5-9", "10-14", "15-19", "15-19", "30-34", "30-34", "70-74", "75-79", "85-89"]
    bands += ["90+", "90+", "90+", None]
    assert column(spark, ages, five_year_band("v"), "int") == bands
    order = [None, 1, 1, 2, 3, 4, 4, 7, 7, 15, 16, 18, 19, 19, 19, None]
    assert column(spark, ages, five_year_band("v", order=True), "int") == order
    two = column(spark, [74, 75, None], two_bands("v", 75, "Under 75", "75 and over"), "int")
    assert two == ["Under 75", "75 and over", "75 and over"]
    with pytest.raises(ValueError):
        band("v", [1, 2], ["a", "b"])


def test_deciles_and_levels(spark):
    assert column(spark, list(range(1, 11)), quintile_from_decile("v"), "int") == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert column(spark, [0, 1, 5, 6, None], in_levels("v", 1, 5), "int") == [None, 1, 5, None, None]


def test_years_of_life_lost(spark):
    assert column(spark, [0, 30, 74, 75, 99, None], years_of_life_lost("v"), "int") == [
        74.5, 44.5, 0.5, 0.0, 0.0, None,
    ]
    assert column(spark, [70, 80], years_of_life_lost("v", weight=F.lit(3)), "int") == [13.5, 0.0]


def test_dates(spark):
    days = ["2018-03-31", "2018-04-01", "2024-03-31", "2024-04-01", None]
    half_open = column(spark, days, date_range(F.to_date("v"), "2018-04-01", "2024-04-01"))
    assert half_open == [False, True, True, False, None]
    closed = column(spark, days, date_range(F.to_date("v"), "2018-04-01", "2024-04-01", closed=True))
    assert closed == [False, True, True, True, None]
    start = F.to_date(F.lit("2020-01-01"))
    later = ["2020-01-01", "2020-03-30", "2020-03-31", "2020-04-01"]
    assert column(spark, later, within_days(F.to_date("v"), start, 90)) == [True, True, True, False]


def test_null_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "k string, v double")
    assert dict(df.groupBy("k").agg(null_sum("v")).collect()) == {"a": 3.0, "b": None}


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (81, 263), (0, 0)], "x long, n long")
    lower, upper = wilson_bounds("x", "n")
    got = df.select(lower, upper, wilson_half_width(F.try_divide("x", "n"), F.col("n"))).collect()
    z = statistics.NormalDist().inv_cdf(0.975)
    assert math.isclose(z, Z95, rel_tol=1e-12)
    for (x, n), (low, high, half) in zip([(0, 10), (5, 10), (10, 10), (81, 263)], got[:4], strict=True):
        p = x / n
        mid, root = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        assert math.isclose(low, 100 * (mid - root) / (1 + z * z / n), abs_tol=1e-9)
        assert math.isclose(high, 100 * (mid + root) / (1 + z * z / n), abs_tol=1e-9)
        assert -1e-9 <= low <= 100 * p + 1e-9 and 100 * p - 1e-9 <= high <= 100 + 1e-9
        q = 1.64485
        assert math.isclose(half, q * math.sqrt(p * (1 - p) / n + q * q / (4 * n * n)) / (1 + q * q / n))
    assert tuple(got[4]) == (None, None, None)


def test_byar_is_close_to_the_exact_poisson_limits(spark):
    # exact 95% Poisson limits of 10, 25 and 100 events
    exact = {10: (4.795, 18.390), 25: (16.179, 36.905), 100: (81.364, 121.627)}
    df = spark.createDataFrame([(float(k),) for k in exact], "o double")
    for (low, high), got in zip(exact.values(), df.select(byar_lower("o"), byar_upper("o")).collect(), strict=True):
        assert math.isclose(got[0], low, rel_tol=0.01) and math.isclose(got[1], high, rel_tol=0.01)
    zero = spark.createDataFrame([(0.0,)], "o double").select(byar_lower("o"), byar_upper("o")).first()
    assert zero[0] is None and zero[1] > 3


def test_standard_population_sums_to_100000():
    assert len(STANDARD_POPULATION) == 19 and sum(STANDARD_POPULATION) == 100_000
