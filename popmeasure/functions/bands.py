"""Age bands and ordered categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nineteen five-year bands, the last one open.
FIVE_YEAR_BANDS = [f"{start}-{start + 4}" for start in range(0, 90, 5)] + ["90+"]

# Seven age groups; a cut is the first age of the next group.
AGE_GROUP_CUTS = [16, 31, 46, 61, 76, 91]
AGE_GROUP_LABELS = ["0 - 15", "16 - 30", "31 - 45", "46 - 60", "61 - 75", "76 - 90", ">= 91"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(value: Column | str, cuts: Sequence[float], labels: Sequence) -> Column:
    """Label of the first cut the value lies below; the last label from the last cut on; null stays null.

    `labels` has one entry more than `cuts`. Use integers as labels to get a sort order.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("labels must have one entry more than cuts")
    value = _col(value)
    out = F.when(value < F.lit(cuts[0]), F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:-1], strict=True):
        out = out.when(value < F.lit(cut), F.lit(label))
    return out.when(value >= F.lit(cuts[-1]), F.lit(labels[-1]))


def age_group(age: Column | str, order: bool = False) -> Column:
    """Seven age groups as labels, or as 1..7 for sorting."""
    labels = list(range(1, len(AGE_GROUP_LABELS) + 1)) if order else AGE_GROUP_LABELS
    return band(age, AGE_GROUP_CUTS, labels)


def five_year_band(age: Column | str, order: bool = False) -> Column:
    """Nineteen five-year bands, closed on the left, the last one open; null below zero."""
    age = _col(age)
    last = len(FIVE_YEAR_BANDS)
    number = F.when(age >= 5 * (last - 1), F.lit(last)).when(age >= 0, F.floor(age / 5).cast("int") + 1)
    if order:
        return number
    # `get` and not `element_at`: the latter ignores a null index when the array literal holds no null
    return F.get(F.array(*[F.lit(b) for b in FIVE_YEAR_BANDS]), number - 1)


def two_bands(age: Column | str, limit: int, below: str, otherwise: str) -> Column:
    """Two categories; a null age falls in the second one."""
    return F.when(_col(age) < limit, F.lit(below)).otherwise(F.lit(otherwise))


def quintile_from_decile(decile: Column | str) -> Column:
    return F.floor(F.floor(_col(decile) + 1) / 2).cast("int")


def in_levels(value: Column | str, low: int, high: int) -> Column:
    """Ordered category with the levels `low`..`high`; anything else becomes null."""
    value = _col(value)
    return F.when(value.between(low, high), value)
