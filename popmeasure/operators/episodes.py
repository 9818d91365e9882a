"""Episode rules: repeat admissions, latest and first row per key.

Each rule is a partial aggregate, combined on the map side before anything is shuffled. A key that owns a large part
of all rows therefore reaches a reducer as a handful of rows per map task, never as one unbounded group. Taking the
minimum of a struct (order columns first, then every other column) is also deterministic: a recomputed task yields the
same row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popmeasure.functions.dates import within_days


def _as_list(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _row(df: DataFrame, order: Sequence[str], skip: Sequence[str] = ()) -> F.Column:
    rest = [c for c in df.columns if c not in order and c not in skip]
    return F.struct(*order, *rest)


def first_in_gap(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    gap_days: int = 90,
    tie: str | Sequence[str] = (),
    number: str | None = None,
) -> DataFrame:
    """Keep a row when its key has no earlier row in the `gap_days` days before it (the last day counts).

    The comparison is with the row just before, kept or not, so a chain of close rows yields its first row only.
    Rows on the same instant count as repeats of the first of them in `tie` order. Rows with a null key or a null
    instant have no predecessor and are all kept.

    Time is cut into buckets as long as the gap. Two rows of one key and bucket are always within the gap, so only the
    first row of a bucket can be kept, and what precedes it can only be the last instant of an earlier bucket. The
    window therefore sees one row per key and bucket: its group size is bounded by the calendar, not by the data.

    `number` names a column for the place of a kept row among all rows of its key, in order of `ts` and `tie`. A kept
    row is the first of its bucket, so its number follows from the counts of the buckets before: no further shuffle.
    Rows without a key or instant have no number.
    """
    keys, tie = _as_list(keys), _as_list(tie)
    if gap_days < 0:
        raise ValueError("gap_days must not be negative")
    no_key = reduce(or_, [F.col(c).isNull() for c in [*keys, ts]])
    day = F.unix_date(F.col(ts).cast("date"))
    bucket = F.floor(day / F.lit(gap_days)) if gap_days else F.col(ts)

    # A row without a key is a group of its own, so the same single pass keeps it. Equal ones are counted per input
    # partition, which bounds the count and spreads them.
    alone = F.when(no_key, F.struct(F.spark_partition_id().alias("__part"), *df.columns))
    firsts = (
        df.withColumns({"__bucket": bucket, "__alone": alone})
        .groupBy(*keys, "__alone", "__bucket")
        .agg(
            F.min(_row(df, [ts, *tie], skip=keys)).alias("__row"),
            F.max(ts).alias("__last"),
            F.count("__alone").alias("__copies"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    w = Window.partitionBy(*keys, "__alone").orderBy("__bucket")
    copies = F.array_repeat(F.lit(0), F.greatest("__copies", F.lit(1)).cast("int"))
    added = []
    if number is not None:
        earlier = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))
        firsts = firsts.withColumn("__number", F.when(F.col("__copies") == 0, F.coalesce(earlier, F.lit(0)) + 1))
        added = [F.col("__number").alias(number)]
    return (
        firsts.withColumn("__before", F.lag("__last").over(w))
        .filter(F.col("__before").isNull() | ~within_days(F.col("__row")[ts], F.col("__before"), gap_days))
        .select(*keys, "__row.*", *added, F.explode(copies).alias("__copy"))
        .select(*df.columns, *([number] if added else []))
    )


def episodes(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    gap_days: int = 90,
    start: str = "start",
    end: str = "end",
    count: str = "admissions",
) -> DataFrame:
    """One row per chain of close rows of a key: its first and last instant and its number of rows.

    Two rows belong together when the later one is at most `gap_days` days after the one before. Rows with a null key
    or instant take no part. The starts are the instants of the rows that `first_in_gap` keeps.

    Rows are first combined per key and bucket of gap length, on the map side: all rows of a bucket are one chain. The
    session window then merges these pieces, each of which reaches from its first to `gap_days` after its last instant,
    so it holds one piece per key and bucket however many rows a key has.
    """
    keys = _as_list(keys)
    if gap_days < 1:
        raise ValueError("gap_days must be positive")
    known = reduce(and_, [F.col(c).isNotNull() for c in [*keys, ts]])
    day = F.unix_date(F.col(ts).cast("date"))
    pieces = (
        df.filter(known)
        .groupBy(*keys, F.floor(day / F.lit(gap_days)).alias("__bucket"))
        .agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.count(F.lit(1)).alias("__n"))
    )
    first, last = F.col("__first").cast("timestamp_ntz"), F.col("__last").cast("timestamp_ntz")
    day, hour, minute, second = (F.extract(F.lit(part), last - first) for part in ("DAY", "HOUR", "MINUTE", "SECOND"))
    # sessions merge when the next one starts no later than the end of the one before
    length = F.make_interval(
        days=day.cast("int") + gap_days, hours=hour.cast("int"), mins=minute.cast("int"), secs=second
    )
    return (
        pieces.withColumn("__at", first)
        .groupBy(*keys, F.session_window("__at", length))
        .agg(F.min("__first").alias(start), F.max("__last").alias(end), F.sum("__n").alias(count))
        .select(*keys, start, end, count)
    )


def latest_per_key(df: DataFrame, key: str | Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """The last row of each key in `order_by` order (nulls come first), with all its columns."""
    key, order = _as_list(key), _as_list(order_by)
    picked = df.groupBy(*key).agg(F.max(_row(df, order, skip=key)).alias("__row"))
    return picked.select(*key, "__row.*").select(*df.columns)


def first_per_key(df: DataFrame, key: str | Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """The first row of each key in `order_by` order, with all its columns. Rows with a null key form one group."""
    key, order = _as_list(key), _as_list(order_by)
    picked = df.groupBy(*key).agg(F.min(_row(df, order, skip=key)).alias("__row"))
    return picked.select(*key, "__row.*").select(*df.columns)


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Add a unique row number without a shuffle.

    Use it on a scan, where a recomputed task reads the same rows in the same order. The numbers have gaps.
    """
    return df.withColumn(out, F.monotonically_increasing_id())
