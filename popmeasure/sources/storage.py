"""Tables kept in the shared folder: intermediate results, replaced partitions, co-partitioned tables.

Everything lies under the folder that `spark.checkpoint.dir` names, which the driver and all executors share. A result
that is written there is complete or absent, so a lost executor costs the recomputation of its own tasks only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only a local session that lacks the setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="popmeasure-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet and read back. What depends on partition numbers or task order is fixed by it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(
    df: DataFrame, keys: str | Sequence[str], buckets: int, sort: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Store `df` hashed on `keys` into `buckets` files, each sorted on `keys` and `sort`, as a table of the session.

    Tables stored with the same keys and number of buckets join, group and number by these keys without an exchange:
    the shuffle is paid once, when the table is written. The rows are hashed before the write, so each bucket is one
    file; Spark trusts the stored order only then (and only with `spark.sql.legacy.bucketedTableScan.outputOrdering`).
    A bucket is read by one task: a key that owns a large part of all rows belongs into a plain table instead, where
    partial aggregates and adaptive joins split it.
    """
    spark = df.sparkSession
    keys = [keys] if isinstance(keys, str) else list(keys)
    name = name or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *[F.col(k) for k in keys]).write.bucketBy(buckets, *keys)
    writer.sortBy(*keys, *sort).option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)
