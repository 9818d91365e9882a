"""Two differently laid out death sources as one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.operators.episodes import with_row_id
from popmeasure.operators.reshape import distinct_causes_in_row
from popmeasure.sources.schemas import MULTI_CAUSE_COLUMNS, schema_of
from popmeasure.sources.tables import conform, conform_union


def conform_sources(
    first: DataFrame,
    second: DataFrame,
    first_rename: Mapping[str, str],
    second_rename: Mapping[str, str],
    first_drop: Sequence[str] = (),
    second_drop: Sequence[str] = (),
    first_area: str | None = None,
    table: str = "weighted_deaths",
) -> DataFrame:
    """Align both sources with one canonical table and append them.

    `first_area` keeps only that residence area in the first source, whose file overlaps the second one's area.
    """
    schema = schema_of(table)
    a = conform(first, first_rename, first_drop, schema)
    if first_area is not None:
        a = a.filter(F.col("residence_la_code") == first_area)
    return conform_union(a, conform(second, second_rename, second_drop, schema))


def multi_cause_rows(
    first: DataFrame,
    second: DataFrame,
    first_rename: Mapping[str, str],
    second_rename: Mapping[str, str],
    first_drop: Sequence[str] = (),
    second_drop: Sequence[str] = (),
    first_area: str | None = None,
    prefix: str = "I",
    missing: str | None = "NULL",
) -> DataFrame:
    """Two sources with eight causes each as one row per record and distinct cause under `prefix`.

    The sources have no record id in common, so every appended row gets one (`record_index`). Repeated causes of a
    record are removed inside its row; nothing is shuffled.
    """
    rows = conform_sources(
        first, second, first_rename, second_rename, first_drop, second_drop, first_area, "multi_cause_deaths"
    )
    return distinct_causes_in_row(with_row_id(rows, "record_index"), MULTI_CAUSE_COLUMNS, prefix, missing)
