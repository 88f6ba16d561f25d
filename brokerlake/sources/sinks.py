"""Parquet tables partitioned by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlake.operators.ingestion import insert_new
from brokerlake.scale import durable


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def append(df: DataFrame, root: str, table: str, partition: str | None = "snapshot_id") -> None:
    """Add rows; evidence tables are only ever appended to."""
    writer = df.write.mode("append")
    if partition is not None:
        writer = writer.partitionBy(partition)
    writer.parquet(table_path(root, table))


def replace_snapshot(df: DataFrame, root: str, table: str, partition: str = "snapshot_id") -> None:
    """Replace only the snapshots the frame holds. The frame may read the table it replaces:
    it is fixed first."""
    (
        durable(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(table_path(root, table))
    )


def load(spark: SparkSession, root: str, table: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(root, table))


def upsert(df: DataFrame, root: str, table: str, keys: list[str], schema: str) -> None:
    """Insert rows whose natural key is new; existing rows are never changed.

    The new rows are fixed before the write, so a retried write adds the same ones.
    """
    spark = df.sparkSession
    try:
        target = load(spark, root, table, schema)
        target.schema  # noqa: B018  (resolves the path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        target = spark.createDataFrame([], schema)
    fresh = durable(insert_new(target, df.select(*target.columns), keys))
    append(fresh, root, table)


def activate(snapshots: DataFrame, snapshot_id: str) -> DataFrame:
    """The snapshot table with exactly one active version."""
    return snapshots.withColumn("is_active", F.col("snapshot_id") == snapshot_id)
