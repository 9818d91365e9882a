"""Two-way matrices of a percentage with margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions.stats import percentage, ratio, wilson_half_width
from popmeasure.operators.reshape import to_wide


def matrix_cells(df: DataFrame, row: str, column: str, num: str, den: str) -> DataFrame:
    """Sums and percentage per cell. Rows with a null row or column key are dropped."""
    out = (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column)
        .agg(F.sum(den).alias(den), F.sum(num).alias(num))
    )
    return out.withColumn("percentage", percentage(num, den))


def matrix_wide(
    cells: DataFrame, row: str, column: str, value: str, levels: Sequence | None = None
) -> DataFrame:
    """Cells as a table; a category without a level is an error, without levels each category has a column."""
    return to_wide(cells, row, column, value, levels)


def matrix_with_margins(
    df: DataFrame, row: str, column: str, num: str, den: str, z: float = 1.64485, digits: int = 1
) -> DataFrame:
    """Cells, both margins and the total in one table: row, column, margin, sums, percentage, half-width.

    `margin` is 0 for a cell, 1 for a row's total (its column is null), 2 for a column's total (its row is null) and 3
    for the grand total; a null key among the rows is a level of its own and told apart by it.

    The rows are aggregated to cells once, combined per task. The grouping sets expand these cells and not the rows,
    so the margins cost what the cells cost: four entries for each.
    """
    cells = df.groupBy(row, column).agg(F.sum(den).alias(den), F.sum(num).alias(num))
    r, c = F.col(row), F.col(column)
    sums = cells.groupingSets([[r, c], [r], [c], []], r, c).agg(
        F.grouping_id().cast("int").alias("margin"), F.sum(den).alias(den), F.sum(num).alias(num)
    )
    p = ratio(num, den)
    return sums.select(
        row,
        column,
        "margin",
        den,
        num,
        F.bround(F.lit(100.0) * p, digits).alias("percentage"),
        F.bround(F.lit(100.0) * wilson_half_width(p, F.col(den), z), digits).alias("half_width"),
    )


def matrix_margins(
    cells: DataFrame, by: str, num: str, den: str, z: float = 1.64485, digits: int = 1
) -> DataFrame:
    """Weighted percentage of one margin and the half-width of its Wilson interval, rounded half to even."""
    sums = cells.groupBy(by).agg(F.sum(den).alias(den), F.sum(num).alias(num))
    p = ratio(num, den)
    return sums.select(
        by,
        den,
        F.bround(F.lit(100.0) * p, digits).alias("percentage"),
        F.bround(F.lit(100.0) * wilson_half_width(p, F.col(den), z), digits).alias("half_width"),
    ).orderBy(F.col("percentage").desc())
