"""Reading, aligning and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popmeasure.sources.constants import FIVE_YEAR_BANDS, STANDARD_POPULATION


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Scan a Parquet or CSV table.

    With a schema, a column that the files lack is an error: Parquet would otherwise read it as nulls. Nothing is
    inferred for CSV, so a schema is required there; its header is checked against the schema by name and order.
    """
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if fmt != "parquet":
        raise ValueError(f"unsupported format: {fmt}")
    df = spark.read.parquet(path)
    if schema is None:
        return df
    _require(df.columns, schema.names, path)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def save_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), replace: str = "table", fmt: str = "parquet"
) -> None:
    """Overwrite a Parquet or CSV table, or only those of its partitions that `df` has rows of.

    With partition columns the rows are rebalanced on them first: small partitions share a file and a partition
    that holds a large part of all rows is split over several tasks.

    `replace="partitions"` leaves the other partitions as they are. New files become visible when the job commits, so
    a lost executor or a failed job leaves the old partitions in place. `df` must not read the table it replaces.
    A CSV table gets a header; `load_table` reads an empty text back as null.
    """
    if replace not in ("table", "partitions"):
        raise ValueError(f"replace what? {replace}")
    if replace == "partitions" and not partition_by:
        raise ValueError("only a partitioned table can have partitions replaced")
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.mode("overwrite").partitionBy(*partition_by)
    writer = writer.option("partitionOverwriteMode", "dynamic" if replace == "partitions" else "static")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def temp_table(df: DataFrame, name: str, materialise: bool = False) -> DataFrame:
    """Register a session temp view.

    `materialise` first cuts the lineage with a reliable checkpoint in the shared folder of `spark.checkpoint.dir`,
    worth it when many measures read the same expensive base.
    """
    if materialise:
        spark = df.sparkSession
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a shared folder first")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        df = df.checkpoint()
    df.createOrReplaceTempView(name)
    return df


def _require(have: Sequence[str], want: Sequence[str], where: str) -> None:
    missing = [c for c in want if c not in have]
    if missing:
        raise ValueError(f"missing columns in {where}: {missing}")


def conform(
    df: DataFrame,
    rename: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Align a source with the canonical schema: drop and rename columns, then select and cast the schema's columns.

    A column that is named here but absent is an error.
    """
    rename = rename or {}
    _require(df.columns, [*drop, *rename], "source")
    out = df.drop(*drop).withColumnsRenamed(dict(rename))
    if schema is None:
        return out
    _require(out.columns, schema.names, "renamed source")
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def conform_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append two sources by column name. Both must have exactly the same columns."""
    return first.unionByName(second)


def schema_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Columns of either source with their types; a null type marks a column the other source lacks."""
    a = {f.name: f.dataType.simpleString() for f in first.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in second.schema.fields}
    rows = [(name, a.get(name), b.get(name)) for name in sorted(a.keys() | b.keys())]
    return inline_table(first.sparkSession, rows, "column_name string, first_type string, second_type string")


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small constant table written as SQL VALUES, so that Spark knows its exact size and needs no Python worker."""
    fields = T.StructType.fromDDL(schema).fields

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"`c{i}`" for i in range(len(fields)))
    casts = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`" for i, f in enumerate(fields))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def standard_population(spark: SparkSession) -> DataFrame:
    """Nineteen rows: age_band, standard_population."""
    rows = list(zip(FIVE_YEAR_BANDS, STANDARD_POPULATION, strict=True))
    return inline_table(spark, rows, "age_band string, standard_population int")
