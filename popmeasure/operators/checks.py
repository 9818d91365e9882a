"""Data-quality checks. Each returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.sources.tables import inline_table


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, null rows, and whether there is any null. One pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot(["rows"], list(columns), "column_name", "null_rows").withColumn(
        "any_null", F.col("null_rows") > 0
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: its type, rows, nulls and distinct values, all exact.

    A row becomes one (column number, value as text) pair per column in the scan's own stage. Pairs are combined per
    task, so a value that fills a third of a column is one entry a task, and no column's values meet in one task:
    values are counted first, columns after. Columns must be of types that can be cast to text.
    """
    values = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    cells = df.select(F.posexplode(values).alias("__at", "__value")).groupBy("__at", "__value").agg(
        F.count(F.lit(1)).alias("__n")
    )
    sums = cells.groupBy("__at").agg(
        F.sum("__n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__value").isNull(), F.col("__n"))), F.lit(0)).alias("nulls"),
        F.count("__value").alias("distinct_values"),
    )
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    names = inline_table(df.sparkSession, fields, "__no int, column_name string, type string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "nulls", "distinct_values")]
    return names.join(sums, F.col("__no") == F.col("__at"), "left").select("column_name", "type", *zero)


def compare_columns(first: DataFrame, second: DataFrame) -> DataFrame:
    """The columns of two sources next to each other: type, rows, nulls and distinct values of each.

    A column that one source lacks has nulls on its side. Names are compared exactly.
    """
    a, b = (
        column_profile(df).select(
            "column_name", *[F.col(c).alias(f"{side}_{c}") for c in ("type", "rows", "nulls", "distinct_values")]
        )
        for side, df in (("first", first), ("second", second))
    )
    return a.join(b, "column_name", "full")


def crosstab_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Row counts per combination of two columns, nulls included."""
    return df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
