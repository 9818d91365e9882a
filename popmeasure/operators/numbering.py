"""Consecutive numbers: over a whole table in a sort order, in file order, and within a key.

A window without partitions sends all rows to one task, and a window over a hot key sends that key's rows there. The
numbers here are distributed prefix sums: rows are numbered inside small pieces, the pieces are counted, and the
running total of the counts is the offset of a piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popmeasure.operators.episodes import first_per_key
from popmeasure.sources.storage import stored
from popmeasure.sources.tables import inline_table

_PART_BITS = 33  # `monotonically_increasing_id` keeps the position in a partition in its lower 33 bits


def _as_list(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _unused(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _offsets(spark: SparkSession, counts: Sequence[tuple], piece: str, kind: str, before: str) -> DataFrame:
    """Constant table (piece, rows in all pieces before it) from counts in piece order."""
    totals = accumulate((n for _, n in counts), initial=0)
    rows = [(key, total) for (key, _), total in zip(counts, totals)]
    return inline_table(spark, rows or [(None, 0)], f"`{piece}` {kind}, `{before}` bigint")


def number_rows(df: DataFrame, order: Sequence[str | Column], out: str = "row_number") -> DataFrame:
    """Number all rows 1..n in `order` (nulls first unless a sort expression says otherwise).

    Rows are range-partitioned and sorted on `order`, numbered by their position in the partition and stored; storing
    fixes the partitions, whose sampled borders another run would not repeat. One count per range partition, at most
    `spark.sql.shuffle.partitions` of them, comes to the driver and returns as offsets. One shuffle of the rows, no
    window. Sort columns should identify a row: rows equal in all of them lie in one range, in any order.
    """
    spark = df.sparkSession
    at, piece, before = _unused(df, "at", "piece", "before")
    sort = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = stored(ranged.withColumn(at, F.monotonically_increasing_id())).withColumn(piece, F.shiftright(at, _PART_BITS))
    counts = sorted(tuple(r) for r in rows.groupBy(piece).agg(F.count(F.lit(1))).collect())
    numbered = rows.join(_offsets(spark, counts, piece, "bigint", before), piece)
    position = F.col(at).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return numbered.select(*df.columns, (F.col(before) + position + 1).alias(out))


def in_file_order(scan: DataFrame, file: str = "file", position: str = "position") -> DataFrame:
    """Add where a row lies: the path of its file and its position in it. `scan` reads Parquet files.

    The two are facts of the stored files: they cost no shuffle and are the same in every run and in every retry.
    """
    return scan.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(position))


def number_scan(scan: DataFrame, out: str = "row_number") -> DataFrame:
    """Number the rows of a Parquet table 1..n in file order (files by path), without a shuffle of the rows.

    One count per file comes to the driver, which holds the list of files anyway. Number before filtering: the numbers
    are positions in the stored table.
    """
    file, at, before = _unused(scan, "file", "at", "before")
    placed = in_file_order(scan, file, at)
    counts = placed.groupBy(file).agg((F.max(at) + 1).alias("n")).collect()
    offsets = _offsets(scan.sparkSession, sorted(tuple(r) for r in counts), file, "string", before)
    return placed.join(offsets, file).select(*scan.columns, (F.col(before) + F.col(at) + 1).alias(out))


def first_in_file_order(scan: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The row of each key that comes first in the stored table; rows with a null key form one group.

    For a table without a column that says its order. The minimum is combined per task before the only shuffle.
    """
    file, at = _unused(scan, "file", "at")
    return first_per_key(in_file_order(scan, file, at), key, [file, at]).select(*scan.columns)


def number_in_key(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    tie: str | Sequence[str] = (),
    bucket_days: int = 30,
    out: str = "row_number",
) -> DataFrame:
    """Number the rows of each key 1..n by `ts`, then `tie`; a null key is one key, a null `ts` comes first.

    Time is cut into buckets of `bucket_days`. Rows are counted per key and bucket (combined per task), a window over
    these counts gives the rows before each bucket, and only rows of one key and bucket are numbered together: a key
    that owns a third of all rows is spread over as many tasks as it has buckets. A bucket's offset travels to its rows
    as one more row of the same shuffle, so the rows move once and no join is needed. A plain window is cheaper where
    no key is hot; the result is the same.
    """
    keys, tie = _as_list(keys), _as_list(tie)
    bucket, before, n = _unused(df, "bucket", "before", "n")
    rows = df.withColumn(bucket, F.floor(F.unix_date(F.col(ts).cast("date")) / F.lit(bucket_days)))
    earlier = Window.partitionBy(*keys).orderBy(F.col(bucket).asc_nulls_first())
    total = F.sum(n).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias(n))
    offsets = counts.select(*keys, bucket, F.coalesce(total, F.lit(0)).alias(before))
    stacked = rows.unionByName(offsets, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, bucket).orderBy(F.col(before).asc_nulls_last(), ts, *tie)
    numbered = stacked.select(
        *df.columns,
        before,
        # the offset row is the first of its group
        (F.first(before).over(inside) + F.row_number().over(inside) - 1).alias(out),
    )
    return numbered.filter(F.col(before).isNull()).drop(before)
