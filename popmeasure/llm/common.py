"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Only a local session without the setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df` stored once as Parquet in the shared folder and read back: later jobs reread it, nothing is recomputed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 100
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, as `--py-files` would; once per application.

    Also lowers the rows of an Arrow batch to BATCH_ROWS: whole texts travel, and a batch of long ones must fit.
    """
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    folder = tempfile.mkdtemp(prefix="popmeasure-")  # the driver serves the file as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"popmeasure-{uuid.uuid4().hex}.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores put in front until no column of `df` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column | str) -> Column:
    """A-Z lowered, every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(id_column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    text = F.coalesce((F.col(id_column) if isinstance(id_column, str) else id_column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus


def one_label(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """(id, label) with one row per id. Rows without id or label go; of contradicting labels the smaller counts."""
    kept = labels.select(F.col(id_column), F.col(label).cast("int").alias(label)).dropna()
    return kept.groupBy(id_column).agg(F.min(label).alias(label))


class LiteralTable:
    """A small lookup table as one constant of the plan: a hash-addressed array of buckets.

    Spark's map type searches its entries one after the other, and a join would need a row id to gather what it finds.
    Reading an array element takes constant time, so a lookup stays inside the row and nothing is shuffled. The table
    is built by Spark, travels as one JSON string, is parsed once when the plan is optimised and reaches the executors
    with the task's broadcast code. `max_rows` is the proven bound; `fits` tells whether the rows respect it.
    """

    def __init__(self, rows: DataFrame, key: str, max_rows: int):
        """`rows` has a long column `key`; several rows may share one."""
        self.n_rows = rows.limit(max_rows + 1).count()
        self.fits = self.n_rows <= max_rows
        if not self.fits:
            return
        self.slots = 1 << max(4, (8 * self.n_rows).bit_length())
        self.key = key
        held = F.struct(*[F.col(c) for c in rows.columns])
        buckets = rows.groupBy(F.pmod(F.col(key), F.lit(self.slots)).cast("int").alias("slot")).agg(
            F.sort_array(F.collect_list(held)).alias("bucket")
        )
        filled = rows.sparkSession.range(self.slots).select(F.col("id").cast("int").alias("slot"))
        filled = filled.join(F.broadcast(buckets), "slot", "left")
        one = filled.agg(F.sort_array(F.collect_list(F.struct("slot", "bucket"))).alias("all")).select(
            F.to_json(F.col("all.bucket"), {"ignoreNullFields": "true"}).alias("json")
        )
        item = rows.select(held.alias("x")).schema["x"].dataType.simpleString()
        self.constant = F.from_json(F.lit(one.first()["json"]), f"array<array<{item}>>")

    def bucket(self, key: Column) -> Column:
        """Rows whose key shares the slot of `key`, or null."""
        return F.get(self.constant, F.pmod(key, F.lit(self.slots)).cast("int"))
