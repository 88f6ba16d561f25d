"""Shared by the operators: session settings, stored tables and Arrow columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brokerlake.scale import stored, tune, work_folder

__all__ = ["BATCH_ROWS", "prepare", "stored", "table", "texts", "work_folder"]

#: Rows handed to Python at a time; with texts of a few kB this keeps a batch at some MB.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the operators: small Arrow batches, adaptive plans."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole input table."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(column) -> list[str]:
    """An Arrow string column as a list in which NULL is the empty text."""
    return [value or "" for value in column.to_pylist()]
