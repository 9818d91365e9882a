"""Ordered categories whose levels are found in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.operators.numbering import number_rows


def level_table(df: DataFrame, column: str, by: str | None = None, desc: bool = False, code: str = "code") -> DataFrame:
    """(column, code): the values of a column and their places 1..k, in their own order or by the mean of `by`.

    Nulls are no level. Levels with equal means follow in their own order; a level without a mean comes last. The
    values are combined per task, so this costs one small shuffle however large `df` is, and the numbering never
    gathers the levels in one task: a column may have as many levels as it has rows.
    """
    found = df.filter(F.col(column).isNotNull()).groupBy(column)
    if by is None:
        sort = F.col(column).desc() if desc else F.col(column).asc()
        return number_rows(found.agg(F.count(F.lit(1)).alias("__n")), [sort], code).select(column, code)
    mean = F.col("__by")
    sort = mean.desc_nulls_last() if desc else mean.asc_nulls_last()
    levels = found.agg(F.avg(by).alias("__by"))
    return number_rows(levels, [sort, F.col(column).asc()], code).select(column, code)


def with_level_code(
    df: DataFrame,
    column: str,
    by: str | None = None,
    desc: bool = False,
    out: str | None = None,
    max_broadcast: int = 100_000,
) -> DataFrame:
    """Add the place of a value among the levels of its column (see `level_table`); null stays null.

    Codes sort and compare as the category does, which a text does not. The dictionary is counted: up to
    `max_broadcast` levels are broadcast, more are joined by a shuffle that adaptive execution may split.
    """
    out = out or f"{column}_level"
    levels = level_table(df, column, by, desc, out).withColumnRenamed(column, "__level")
    if levels.count() <= max_broadcast:
        levels = F.broadcast(levels)
    return df.join(levels, F.col(f"`{column}`") == F.col("__level"), "left").drop("__level")
