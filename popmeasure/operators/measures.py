"""Counts, years of life lost, totals, proportions and shares.

Every measure is an algebraic aggregate, so Spark combines it per task before the shuffle and a hot group costs one
row per task. Windows run on the aggregated result only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popmeasure.functions.stats import null_max, null_sum, percentage
from popmeasure.operators.numbering import number_rows


def yearly(years: float, weight: str | None = None) -> Column:
    """Aggregate: rows, or the sum of a weight, per year."""
    total = F.count(F.lit(1)) if weight is None else null_sum(weight)
    return total / F.lit(float(years))


def yearly_count(
    df: DataFrame, keys: Sequence[str], years: float, alias: str = "deaths", weight: str | None = None
) -> DataFrame:
    return df.groupBy(*keys).agg(yearly(years, weight).alias(alias))


def yearly_yll(df: DataFrame, keys: Sequence[str], years: float, yll: str = "yll", alias: str = "yll") -> DataFrame:
    """Yearly years of life lost; null for a group with an unknown age."""
    return df.groupBy(*keys).agg((null_sum(yll) / F.lit(float(years))).alias(alias))


def count_rows(df: DataFrame, keys: Sequence[str], alias: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def population_totals(
    df: DataFrame, keys: Sequence[str], value: str = "observation", alias: str = "population_count"
) -> DataFrame:
    return df.groupBy(*keys).agg(null_sum(value).alias(alias))


def proportion_aggs(flag: str, total: str, positive: str) -> list[Column]:
    return [F.count(F.lit(1)).alias(total), F.count_if(F.col(flag)).alias(positive)]


def proportion(
    df: DataFrame,
    keys: Sequence[str],
    flag: str,
    total: str = "total_admissions",
    positive: str = "emergency_admissions",
    percent: str = "emergency_percentage",
) -> DataFrame:
    """Rows, rows where the flag is true, and their percentage. A null flag counts in the total only."""
    out = df.groupBy(*keys).agg(*proportion_aggs(flag, total, positive))
    return out.withColumn(percent, percentage(positive, total))


def with_grand_total(df: DataFrame, measure: str, out: str = "total") -> DataFrame:
    """Add the sum of a measure over the whole (aggregated) table.

    The total is a scalar subquery over partial sums; an unpartitioned window would gather all rows in one task.
    """
    return df.withColumn(out, df.agg(F.sum(measure)).scalar())


def share_of_total(
    df: DataFrame, key: str, weight: str | None = None, count: str = "n", total: str = "total", share: str = "share"
) -> DataFrame:
    """Rows (or summed weight) per key, the grand total, and the percentage of it."""
    amount = F.count(F.lit(1)) if weight is None else null_sum(weight)
    counted = df.groupBy(key).agg(amount.alias(count))
    return with_grand_total(counted, count, total).withColumn(share, percentage(count, total))


def max_group_total(df: DataFrame, keys: Sequence[str], measure: str, alias: str = "max_total") -> DataFrame:
    """Largest sum of a measure over the groups: one row. Null as soon as one value is null."""
    totals = df.groupBy(*keys).agg(null_sum(measure).alias("__total"))
    return totals.agg(null_max("__total").alias(alias))


def with_group_mean(df: DataFrame, by: str | Sequence[str], measure: str, out: str = "group_mean") -> DataFrame:
    """Add the unweighted mean of a measure over the rows of each group.

    For tables of aggregated cells: a group holds one row per level of the other characteristics.
    """
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(out, F.avg(measure).over(Window.partitionBy(*by)))


def mean_of_groups(df: DataFrame, measure: str, alias: str = "mean") -> DataFrame:
    """Unweighted mean of a measure over an aggregated table: one row (a reference line)."""
    return df.agg(F.avg(measure).alias(alias))


def order_by_measure(
    df: DataFrame,
    measure: str,
    within: str | None = None,
    desc: bool = False,
    rank_col: str | None = None,
    tie: str | Sequence[str] = (),
) -> DataFrame:
    """Sort categories by a measure, over the whole table or within a facet.

    `rank_col` adds the position, within the facet or over the whole table; without a facet it is a distributed prefix
    sum (`number_rows`) and no window of one task. Nulls come first, or last in descending order. The input is an
    aggregated table, one row per category and facet.
    """
    order = F.col(measure).desc() if desc else F.col(measure).asc()
    ties = [tie] if isinstance(tie, str) else list(tie)
    if rank_col is not None:
        if within is None:
            return number_rows(df, [order, *ties], rank_col).orderBy(rank_col)
        df = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(within).orderBy(order, *ties)))
    return df.orderBy(*([within] if within else []), order, *ties)
