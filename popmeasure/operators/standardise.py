"""Directly age-standardised rates.

The formulas are the published direct method: Dobson et al. (1991) limits around Byar's approximation. Conventions
taken as given: a missing count is zero, and a rate on fewer than ten events is not shown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions.stats import Z95, byar_lower, byar_upper, null_sum
from popmeasure.sources.tables import standard_population


def join_population(
    counts: DataFrame,
    population: DataFrame,
    keys: Sequence[str],
    count: str = "n",
    pop: str = "population_count",
    fill_missing_count: bool = False,
) -> DataFrame:
    """Full outer join of two grouped tables on `keys`, null matching null.

    Both sides hold a key once, so stacking and regrouping gives the full join without joining: one shuffle, null keys
    included.
    """
    left = counts.select(*keys, F.col(count).cast("double").alias(count), F.lit(None).cast("bigint").alias(pop))
    right = population.select(*keys, F.lit(None).cast("double").alias(count), F.col(pop).cast("bigint").alias(pop))
    out = left.unionByName(right).groupBy(*keys).agg(F.sum(count).alias(count), F.sum(pop).alias(pop))
    return out.withColumn(count, F.coalesce(count, F.lit(0.0))) if fill_missing_count else out


def rate_inputs(
    events: DataFrame,
    census: DataFrame,
    keys: Sequence[str],
    years: float,
    observation: str = "observation",
    count: str = "n",
    pop: str = "population_count",
    fill_missing_count: bool = True,
) -> DataFrame:
    """Yearly events and population per key, straight from event rows and census rows.

    Same result as counting both sides and full-joining them, in a single aggregation.
    """
    rows = events.select(*keys, F.lit(True).alias("__event"), F.lit(None).cast("bigint").alias("__pop"))
    people = census.select(*keys, F.lit(None).cast("boolean").alias("__event"), F.col(observation).alias("__pop"))
    n_events = F.count("__event")
    unknown = F.count(F.lit(1)) - n_events - F.count("__pop")
    out = (
        rows.unionByName(people)
        .groupBy(*keys)
        .agg(
            F.when(n_events > 0, n_events / F.lit(float(years))).alias(count),
            F.when(unknown == 0, F.sum("__pop")).alias(pop),
        )
    )
    return out.withColumn(count, F.coalesce(count, F.lit(0.0))) if fill_missing_count else out


def regroup(df: DataFrame, keys: Sequence[str], count: str = "n", pop: str = "population_count") -> DataFrame:
    """Merge strata (after relabelling them): sums that are null as soon as one part is null."""
    return df.groupBy(*keys).agg(null_sum(count).alias(count), null_sum(pop).alias(pop))


def dsr(
    df: DataFrame,
    group_keys: Sequence[str] = (),
    x: str = "n",
    n: str = "population_count",
    band: str = "age_band",
    stdpop: DataFrame | None = None,
    multiplier: float = 100000.0,
    z: float = Z95,
    min_count: float = 10,
    fill_missing_count: bool = True,
) -> DataFrame:
    """Rate, limits and totals per group from one row per group and age band.

    A row without band or population takes no part; `rate_gaps` lists such rows. A missing count is zero, or, with
    `fill_missing_count` off, its row takes no part either. A zero population makes the rate null. `stdpop` has the columns age_band and standard_population.
    """
    weights = standard_population(df.sparkSession) if stdpop is None else stdpop
    weights = weights.select(F.col("age_band").alias("__band"), F.col("standard_population").alias("__w"))
    count = F.coalesce(F.col(x), F.lit(0.0)) if fill_missing_count else F.col(x)
    people = F.col(n).cast("double")
    taken = F.col("__w").isNotNull() & F.col(n).isNotNull() & count.isNotNull()
    weighted = F.try_divide(F.col("__w"), people)
    sums = (
        df.join(weights, F.col(band) == F.col("__band"), "left")
        .groupBy(*group_keys)
        .agg(
            *[
                F.sum(F.when(taken, value)).alias(name)
                for name, value in {
                    "total_count": count,
                    "total_pop": F.col(n),
                    "__w": F.col("__w").cast("double"),
                    "__rate": weighted * count,
                    "__var": weighted * weighted * count,
                    "__empty": F.when(F.col(n) == 0, 1).otherwise(0),
                }.items()
            ]
        )
    )
    total, w = F.col("total_count"), F.col("__w")
    shown = (total >= min_count) & (F.col("__empty") == 0)
    value = F.lit(multiplier) * F.try_divide(F.col("__rate"), w)
    scale = F.lit(multiplier) * F.sqrt(F.try_divide(F.try_divide(F.col("__var"), w * w), total))
    return sums.select(
        *group_keys,
        "total_count",
        "total_pop",
        F.when(shown, value).alias("value"),
        F.when(shown, value + scale * (byar_lower(total, z) - total)).alias("lowercl"),
        F.when(shown, value + scale * (byar_upper(total, z) - total)).alias("uppercl"),
        F.lit("95%" if z == Z95 else f"z = {z}").alias("confidence"),
        F.when(total < min_count, f"dsr NA for total count < {min_count:g}")
        .when(F.col("__empty") > 0, "dsr NA for zero population")
        .otherwise(f"dsr per {multiplier:.0f}")
        .alias("statistic"),
        F.lit("Dobson").alias("method"),
    )


def rate_gaps(
    df: DataFrame, group_keys: Sequence[str] = (), n: str = "population_count", band: str = "age_band"
) -> DataFrame:
    """Rows that cannot enter a rate: no band, no population, or a population of zero."""
    return df.groupBy(*group_keys).agg(
        F.count_if(F.col(band).isNull()).alias("no_band"),
        F.count_if(F.col(n).isNull()).alias("no_population"),
        F.count_if(F.col(n) == 0).alias("zero_population"),
    )
