"""Comparison of two outcomes by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.operators.enrich import enrich
from popmeasure.operators.reshape import recode, unpivot_measures


def shares_long(
    first: DataFrame, second: DataFrame, key: str, first_share: str, second_share: str, names: dict[str, str]
) -> DataFrame:
    """Two share tables, joined on the first one's categories, as one row per category and outcome.

    A category without a share in the second table has a share of zero there.
    """
    joined = enrich(first, second, key).withColumn(second_share, F.coalesce(second_share, F.lit(0.0)))
    return recode(unpivot_measures(joined, [first_share, second_share]), "outcome", names)


def side_by_side(first: DataFrame, second: DataFrame, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Yearly numbers of two outcomes per category of the first table."""
    return enrich(first, second.drop(*drop), key)
