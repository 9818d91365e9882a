"""Breakdowns by area, by each of several characteristics, and by pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popmeasure.functions.stats import null_sum
from popmeasure.operators.intervals import wilson_ci
from popmeasure.operators.measures import proportion, proportion_aggs


def by_area(
    df: DataFrame,
    keys: Sequence[str],
    area_col: str,
    areas: Mapping[str, Sequence[str]],
    years: float,
    count: str = "deaths",
    weight: str | None = None,
    yll: str | None = None,
) -> DataFrame:
    """Yearly counts, and years of life lost when `yll` names its column, for single areas and unions of areas.

    `areas` maps each reported label to its member areas; an area may belong to several labels. Rows of other areas,
    a null area included, count nowhere.

    The base is aggregated once per key and member area. Only these cells are copied to the labels they belong to, so
    a union costs no second pass over the rows.
    """
    labels_of: dict[str, list[str]] = {}
    for label, members in areas.items():
        for member in members:
            labels_of.setdefault(member, []).append(label)

    cell = [(F.count(F.lit(1)) if weight is None else null_sum(weight)).alias("__count")]
    measures = [(null_sum("__count") / F.lit(float(years))).alias(count)]
    if yll is not None:
        cell.append(null_sum(yll).alias("__yll"))
        measures.append((null_sum("__yll") / F.lit(float(years))).alias("yll"))

    labels: Column | None = None
    for member, names in labels_of.items():
        test, value = F.col("__member") == member, F.array(*[F.lit(n) for n in names])
        labels = F.when(test, value) if labels is None else labels.when(test, value)

    cells = (
        df.filter(F.col(area_col).isin(list(labels_of)))
        .groupBy(*keys, F.col(area_col).alias("__member"))
        .agg(*cell)
        .withColumn("area", F.explode(labels))
    )
    return cells.groupBy(*keys, "area").agg(*measures)


def by_characteristic(
    df: DataFrame, characteristics: Sequence[str], aggs: Sequence[Column], keys: Sequence[str] = ()
) -> DataFrame:
    """One long table (keys, characteristic, level, measures) with a block per characteristic.

    Each row is turned into one (characteristic number, level) pair per characteristic, within the scan's own stage,
    and each task combines its pairs to (keys x levels) cells before the only shuffle. The base is read once. A null
    level stays a level. Grouping sets give the same table, but hash every characteristic for every pair.
    """
    levels = F.array(*[F.col(c).cast("string") for c in characteristics])
    names = F.array(*[F.lit(c) for c in characteristics])
    cells = (
        df.select("*", F.posexplode(levels).alias("__at", "__level"))
        .groupBy(*keys, "__at", "__level")
        .agg(*aggs)
    )
    measures = [c for c in cells.columns if c not in (*keys, "__at", "__level")]
    return cells.select(
        *keys, F.get(names, F.col("__at")).alias("characteristic"), F.col("__level").alias("level"), *measures
    )


def proportion_by_characteristic(
    df: DataFrame,
    characteristics: Sequence[str],
    flag: str,
    keys: Sequence[str] = (),
    total: str = "total_admissions",
    positive: str = "emergency_admissions",
) -> DataFrame:
    """Proportion with Wilson limits for every level of every characteristic."""
    cells = by_characteristic(df, characteristics, proportion_aggs(flag, total, positive), keys)
    return wilson_ci(cells, positive, total)


def proportion_by_pair(
    df: DataFrame,
    pair: Sequence[str],
    flag: str,
    total: str = "total_admissions",
    positive: str = "emergency_admissions",
) -> DataFrame:
    """Proportion with Wilson limits for the combinations of two characteristics."""
    return wilson_ci(proportion(df, pair, flag, total, positive, "percentage"), positive, total)
