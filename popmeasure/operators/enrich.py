"""Left joins to lookups and fact tables.

No join here carries a broadcast hint. Spark broadcasts a lookup when its size statistic, taken from the files or from
a finished shuffle stage, is under `spark.sql.autoBroadcastJoinThreshold`. A larger lookup is sort-merge joined, and
adaptive execution splits the partitions of a hot key. A salted lookup is always sort-merge joined: Spark sizes its
copies like the files of one, and would send them all through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(lookup: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once and would multiply rows in a join."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def enrich(
    df: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    null_safe: bool = True,
    require_unique: bool = False,
    salts: int = 1,
    salt_by: str | Sequence[str] = (),
) -> DataFrame:
    """Left join that adds the lookup's other columns.

    on              column names, or a mapping from the column in `df` to the column in `lookup`
    null_safe       a null key matches a null key (data-frame rule) or never matches (SQL rule)
    require_unique  raise when the lookup holds a key twice; this runs a small job
    salts, salt_by  spread each key over `salts` partitions by a hash of the `salt_by` columns of `df` (a row id), at
                    the price of `salts` copies of the lookup, which are shuffled and never broadcast. For hot keys
                    when adaptive execution is off.
    """
    if isinstance(on, str):
        on = {on: on}
    elif not isinstance(on, Mapping):
        on = {c: c for c in on}
    keys = list(on.values())
    clash = [c for c in lookup.columns if c not in keys and c in df.columns]
    if clash:
        raise ValueError(f"columns exist on both sides: {clash}")
    if require_unique and not duplicate_keys(lookup, keys).isEmpty():
        raise ValueError(f"lookup keys are not unique: {keys}")

    own = {right: f"__key_{i}" for i, right in enumerate(keys)}
    right = lookup.withColumnsRenamed(own)
    tests = [
        F.col(f"`{a}`").eqNullSafe(F.col(own[b])) if null_safe else F.col(f"`{a}`") == F.col(own[b])
        for a, b in on.items()
    ]
    added = list(own.values())
    if salts > 1:
        by = [salt_by] if isinstance(salt_by, str) else list(salt_by)
        if not by:
            raise ValueError("salting needs salt_by columns that tell rows of one key apart")
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        right = right.withColumn("__copy", copies).hint("merge")
        tests.append(F.col("__salt") == F.col("__copy"))
        added += ["__salt", "__copy"]
    return df.join(right, reduce(and_, tests), "left").drop(*added)


def map_labels(df: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Replace labels by a two-column table (old, new); a label the table lacks becomes null."""
    old, new = mapping.columns
    right = mapping.select(F.col(old).alias("__old"), F.col(new).alias(out))
    return enrich(df, right, {column: "__old"}, null_safe=False)
