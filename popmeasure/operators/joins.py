"""Joins that Spark has no splittable form for: full join with repeated keys, range joins in time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_list(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def full_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Full outer join on columns of the same names; every pair of rows with equal keys is a row of the result.

    A null key matches a null key (data-frame rule), or nothing with `null_safe` off (SQL rule). Other columns that
    both sides have get the suffixes.

    Built of a left join and of the right rows without a partner. Adaptive execution splits a hot key of a left join
    and of an anti join, but never of a full outer join. The anti join meets each key of the left side once.
    """
    on = _as_list(on)
    both = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: f"{c}{suffixes[0]}" for c in both})
    right = right.withColumnsRenamed({c: f"{c}{suffixes[1]}" for c in both})

    own = {c: f"__key_{i}" for i, c in enumerate(on)}

    def equal(a: str, b: str) -> Column:
        return F.col(f"`{a}`").eqNullSafe(F.col(b)) if null_safe else F.col(f"`{a}`") == F.col(b)

    met = reduce(and_, [equal(a, b) for a, b in own.items()])
    pairs = left.join(right.withColumnsRenamed(own), met, "left").drop(*own.values())
    seen = left.select(*[F.col(f"`{a}`").alias(b) for a, b in own.items()]).distinct()
    return pairs.unionByName(right.join(seen, met, "left_anti"), allowMissingColumns=True)


def _bucket(ts: str, days: int) -> Column:
    return F.floor(F.unix_date(F.col(ts).cast("date")) / F.lit(max(days, 1)))


def _cells_before(other: DataFrame, keys: Sequence[str], ts: str, days: int, own: Sequence[str]) -> DataFrame:
    """Per key and bucket: first instant in the bucket and last instant in the bucket before."""
    bucket = _bucket(ts, days)
    known = reduce(and_, [F.col(c).isNotNull() for c in [*keys, ts]])
    cells = (
        other.filter(known)
        .select(*[F.col(a).alias(b) for a, b in zip(keys, own, strict=True)], bucket.alias("__b"), F.col(ts).alias("__t"))
        .groupBy(*own, "__b")
        .agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"))
    )
    # each cell serves its own bucket with its first instant, and the next bucket with its last one
    served = cells.select(*own, F.posexplode(F.array("__first", "__last")).alias("__next", "__t"), "__b")
    return served.groupBy(*own, (F.col("__b") + F.col("__next")).alias("__bucket")).agg(
        F.min(F.when(F.col("__next") == 0, F.col("__t"))).alias("__own"),
        F.max(F.when(F.col("__next") == 1, F.col("__t"))).alias("__before"),
    )


def _preceded(
    df: DataFrame, other: DataFrame, keys: str | Sequence[str], ts: str, other_ts: str, days: int, how: str
) -> DataFrame:
    keys = _as_list(keys)
    dates = {d.schema[c].dataType.typeName() for d, c in ((df, ts), (other, other_ts))} == {"date"}
    if days < 0 or (days == 0 and not dates):
        raise ValueError("days must be positive, or zero between dates")
    own = [f"__key_{i}" for i, _ in enumerate(keys)]
    cells = _cells_before(other, keys, other_ts, days, own)
    same = reduce(and_, [F.col(f"`{a}`") == F.col(b) for a, b in zip(keys, own, strict=True)])
    earliest = F.col(ts) - F.expr(f"INTERVAL '{int(days)}' DAY")
    near = (F.col("__own").between(earliest, F.col(ts))) | (F.col("__before") >= earliest)
    return df.join(cells, same & (_bucket(ts, days) == F.col("__bucket")) & near, how)


def without_earlier(
    df: DataFrame, other: DataFrame, keys: str | Sequence[str], ts: str, other_ts: str, days: int = 90
) -> DataFrame:
    """Rows of `df` for which `other` has no row of the same keys on that instant or in the `days` days before it.

    The last day counts. Rows with a null key or instant are kept; those of `other` precede nothing.

    A range condition alone would pair all rows of a key. Here time is cut into buckets as long as the range, so a
    predecessor lies in the row's own bucket or in the one before, and of `other` only two instants per key and bucket
    matter: its first one in the own bucket and its last one in the bucket before. They are aggregated first, hence
    the join is one of equal keys with at most one partner a row, and adaptive execution can split it.
    """
    return _preceded(df, other, keys, ts, other_ts, days, "left_anti")


def with_earlier(
    df: DataFrame, other: DataFrame, keys: str | Sequence[str], ts: str, other_ts: str, days: int = 90
) -> DataFrame:
    """The other rows of `without_earlier`: those that a row of `other` precedes by at most `days` days."""
    return _preceded(df, other, keys, ts, other_ts, days, "left_semi")
