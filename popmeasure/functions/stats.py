"""Statistical expressions on counts. Divisions by zero give null (`try_divide`), never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: standard normal quantile at 0.975
Z95 = 1.959963984540054


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def percentage(part: Column | str, whole: Column | str) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def null_sum(value: Column | str) -> Column:
    """Aggregate: sum that is null as soon as one value of the group is null."""
    value = _col(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def null_max(value: Column | str) -> Column:
    """Aggregate: maximum that is null as soon as one value of the group is null."""
    value = _col(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.max(value))


def years_of_life_lost(
    age: Column | str, limit: float = 75, reference: float = 74.5, weight: Column | str | None = None
) -> Column:
    """`reference - age` below the age limit, zero from the limit on, null for an unknown age."""
    age = _col(age)
    lost = F.lit(float(reference)) - age
    if weight is not None:
        lost = lost * _col(weight)
    return F.when(age < limit, lost).when(age >= limit, F.lit(0.0))


def _wilson_parts(p: Column, n: Column, z: float) -> tuple[Column, Column, Column]:
    n = n.cast("double")
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    spread = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return centre, spread, 1 + F.try_divide(F.lit(z * z), n)


def wilson_bounds(
    count: Column | str, total: Column | str, z: float = Z95, scale: float = 100.0
) -> tuple[Column, Column]:
    """Lower and upper Wilson score limit of count / total."""
    centre, spread, scaler = _wilson_parts(ratio(count, total), _col(total), z)
    return F.lit(scale) * (centre - spread) / scaler, F.lit(scale) * (centre + spread) / scaler


def wilson_half_width(p: Column | str, n: Column | str, z: float = 1.64485) -> Column:
    """Half the width of the Wilson score interval of the proportion `p` observed on `n`."""
    _, spread, scaler = _wilson_parts(_col(p), _col(n), z)
    return spread / scaler


def byar_lower(count: Column | str, z: float = Z95) -> Column:
    """Byar's approximation of the lower Poisson limit; null for a zero count."""
    o = F.nullif(_col(count).cast("double"), F.lit(0.0))
    return o * F.pow(1 - F.try_divide(F.lit(1.0), 9 * o) - F.try_divide(F.lit(z), 3 * F.sqrt(o)), F.lit(3.0))


def byar_upper(count: Column | str, z: float = Z95) -> Column:
    """Byar's approximation of the upper Poisson limit."""
    o = _col(count).cast("double") + 1
    return o * F.pow(1 - F.try_divide(F.lit(1.0), 9 * o) + F.try_divide(F.lit(z), 3 * F.sqrt(o)), F.lit(3.0))
