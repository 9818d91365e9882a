"""Wide to long, long to wide, and distinct causes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popmeasure.functions.codes import classify, code_prefix, label_of, numbered
from popmeasure.functions.text import relabel
from popmeasure.sources.constants import ICD10_GROUP_RULES
from popmeasure.sources.storage import stored


def columns_containing(df: DataFrame, part: str) -> list[str]:
    """Column names that hold `part`, upper and lower case alike."""
    return [c for c in df.columns if part.lower() in c.lower()]


def explode_causes(
    df: DataFrame,
    contains: str = "_cod_",
    name: str = "cause_number",
    value: str = "icd10_code",
    missing: str | None = "NULL",
    prefix: str | None = None,
) -> DataFrame:
    """One row per cause: unpivot the columns whose name holds `contains`, without nulls and `missing` markers.

    With `prefix` only codes under it are kept. The test sits right on top of the unpivot, so the other rows are never
    materialised.
    """
    causes = columns_containing(df, contains)
    ids = [c for c in df.columns if c not in causes]
    out = df.unpivot(ids, causes, name, value).filter(F.col(value).isNotNull())
    if missing is not None:
        out = out.filter(F.col(value) != missing)
    return out if prefix is None else out.filter(F.startswith(F.col(value), F.lit(prefix)))


def primary_cause(df: DataFrame, cause_name: str, name: str = "cause_number") -> DataFrame:
    """Long-form rows of one cause column."""
    return df.filter(F.col(name) == cause_name)


def distinct_causes(
    df: DataFrame, drop: Sequence[str] = ("cause_number", "icd10_code"), wide: bool = False
) -> DataFrame:
    """Distinct rows over all columns but `drop`: one row per person and derived code.

    Project to the columns that matter before; every remaining column is shuffled, or with `wide` those of rows whose
    hash repeats (see `distinct_wide`).
    """
    rows = df.drop(*drop)
    return distinct_wide(rows) if wide else rows.distinct()


def distinct_wide(df: DataFrame, max_repeated: int = 1_000_000) -> DataFrame:
    """`df.distinct()` for wide rows that seldom repeat: only rows whose hash repeats are shuffled whole.

    First pass: two 64-bit hashes of each row are counted, which shuffles 16 bytes and a count a row; hashes that occur
    more than once are stored. Second pass: a row whose hash is not among them is unique and goes straight on, the
    others are compared whole. Hashes only sort out what cannot be equal, so a collision costs a comparison and no row.

    The repeated hashes are counted before they are broadcast. Beyond `max_repeated` of them (24 MB) rows repeat too
    often for this to pay, and the plain distinct is returned. The input is read twice and must be the same each time.
    """
    hashes = {"__h1": F.xxhash64(*df.columns), "__h2": F.xxhash64(F.lit(1), *df.columns)}
    counts = df.select(*[h.alias(name) for name, h in hashes.items()]).groupBy(*hashes).agg(F.count(F.lit(1)).alias("__n"))
    repeated = stored(counts.filter(F.col("__n") > 1).select(*hashes))
    if repeated.count() > max_repeated:
        return df.distinct()
    repeated = F.broadcast(repeated)
    hashed = df.withColumns(hashes)
    alone = hashed.join(repeated, list(hashes), "left_anti").select(*df.columns)
    return alone.unionByName(hashed.join(repeated, list(hashes), "left_semi").select(*df.columns).distinct())


def codes_in_row(causes: Sequence[str], prefix: str = "I", missing: str | None = None, min_length: int = 3) -> Column:
    """Array of the distinct codes under `prefix` among the cause columns of a row; one null stands for all others."""

    def kept(c: str) -> Column:
        wanted = F.startswith(F.col(c), F.lit(prefix)) & (F.length(c) >= min_length)
        return F.when(wanted if missing is None else wanted & (F.col(c) != missing), F.col(c))

    return F.array_distinct(F.array(*[kept(c) for c in causes]))


def distinct_causes_in_row(
    df: DataFrame, causes: Sequence[str], prefix: str = "I", missing: str | None = None
) -> DataFrame:
    """One row per record and distinct (icd_subgroup, cvd_group) among its causes: each record is its own person.

    The repeats sit in one row, so they are removed there: no row id, no shuffle. Codes are made distinct first and the
    classifier runs in one lambda over them: a copy of it for each column is a method too large to be compiled.
    """

    rules, labels = numbered(ICD10_GROUP_RULES)

    def entry(code: Column) -> Column:
        """Subgroup and number of the group as one text, so that the row's array is compared as texts."""
        group = F.coalesce(classify(code, rules), F.lit(len(labels)))
        return F.when(code.isNotNull(), F.concat(code_prefix(code), F.lpad(group.cast("string"), 3, "0")))

    found = F.array_distinct(F.transform(codes_in_row(causes, prefix, missing), entry))
    rows = df.select(*[c for c in df.columns if c not in causes], F.explode(found).alias("__entry"))
    rows = rows.filter(F.col("__entry").isNotNull()).withColumns(
        {
            "icd_subgroup": F.substring("__entry", 1, 3),
            "cvd_group": label_of(F.substring("__entry", 4, 3).cast("int"), labels),
        }
    )
    return rows.drop("__entry")


def unpivot_measures(
    df: DataFrame, measures: Sequence[str], name: str = "outcome", value: str = "percentage"
) -> DataFrame:
    """Named measure columns to rows."""
    ids = [c for c in df.columns if c not in measures]
    return df.unpivot(ids, list(measures), name, value)


def recode(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Replace exact values of a column; other values stay."""
    return df.withColumn(column, relabel(column, mapping, keep_other=True))


def to_wide(
    df: DataFrame, row: str, column: str, value: str, levels: Sequence | None = None, max_levels: int = 1000
) -> DataFrame:
    """One row per `row` value and one column per level; a missing cell is null.

    A category that is not among the given levels is an error when the result is computed: it would be lost without a
    word. Without levels every category gets a column, in order; that reads the categories once, `max_levels` at most.
    """
    if levels is None:
        found = df.select(column).dropna().distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"over {max_levels} categories in {column}")
        return df.groupBy(row).pivot(column, sorted(r[0] for r in found)).agg(F.avg(value))
    unlisted = F.concat(F.lit(f"category of {column} without a column: "), F.col(column).cast("string"))
    known = F.col(column).isNull() | F.col(column).isin(list(levels))
    checked = F.when(known, F.col(value).cast("double")).otherwise(F.raise_error(unlisted).cast("double"))
    return df.withColumn(value, checked).groupBy(row).pivot(column, list(levels)).agg(F.avg(value))
