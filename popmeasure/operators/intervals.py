"""Confidence intervals of proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.functions.stats import Z95, percentage, ratio, wilson_bounds


def wilson_ci(df: DataFrame, x: str, n: str, z: float = Z95, scale: float = 100.0) -> DataFrame:
    """Add p_hat, percentage and the Wilson score limits lower_ci and upper_ci of x / n."""
    lower, upper = wilson_bounds(x, n, z, scale)
    return df.withColumns(
        {"p_hat": ratio(x, n), "percentage": percentage(x, n), "lower_ci": lower, "upper_ci": upper}
    )


def with_constants(df: DataFrame, **values: object) -> DataFrame:
    """Add constant columns, for instance the area code and the quantile used."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})
