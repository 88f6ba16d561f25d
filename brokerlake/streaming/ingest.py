"""Exactly-once effect over at-least-once delivery: insert if the content is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlake.functions.text import email_fingerprint
from brokerlake.operators.ingestion import dedupe_submissions, with_fingerprint
from brokerlake.scale import durable
from brokerlake.streaming.job_state import use_rocksdb

_KEYS = "content_fingerprint string, event_id string, batch bigint"


def _stored_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys of everything taken in so far; a narrow table, so the check never reads bodies."""
    try:
        keys = spark.read.schema(_KEYS).parquet(f"{root}/keys")
        keys.schema  # noqa: B018
        return keys
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _KEYS)


def ingest_batch(root: str):
    """A function that adds the new events of one delivery under ``root``, outside of a stream.

    It compares with a table of all keys; ``start_ingest`` keeps them as state instead. Each batch owns its partition and a replayed batch overwrites it, comparing itself with
    other batches only. Uniqueness is global, so no watermark may forget a key.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn(
            "content_fingerprint",
            email_fingerprint(F.col("sender_email_raw"), F.col("subject"), F.col("body_text")),
        )
        earlier = _stored_keys(spark, root).where(F.col("batch") != number)
        outcome = dedupe_submissions(marked, earlier)
        # one delivery may hold the same event twice
        created = outcome.where("outcome = 'created'").dropDuplicates(["event_id"]).withColumn(
            "batch", F.lit(number).cast("bigint")
        )
        fixed = durable(created.drop("outcome", "result_event_id"))

        def store(rows: DataFrame, name: str) -> None:
            (
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch").parquet(f"{root}/{name}")
            )

        # content first: keys name an event only once its content is stored
        store(fixed, "events")
        store(fixed.select("content_fingerprint", "event_id", "batch"), "keys")

    return handle


def first_of_each(stream: DataFrame) -> DataFrame:
    """The submissions of a stream whose content no earlier one had.

    Spark keeps one value per fingerprint in its state store, spread over the partitions and
    never expired, as uniqueness is global: a batch looks its own fingerprints up and reads
    nothing else of what came before. Of copies that arrive in one batch one is kept.
    """
    use_rocksdb(stream.sparkSession)
    return with_fingerprint(stream).dropDuplicates(["content_fingerprint"])


def start_ingest(stream: DataFrame, root: str, checkpoint: str):
    """Start the ingestion of a submission stream until its source is drained.

    Each batch owns its partition of ``events``; a replayed batch starts from the state before it
    and overwrites its partition. The checkpoint holds what has been seen and belongs to ``root``.
    """

    def store(batch: DataFrame, number: int) -> None:
        (
            batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch")
            .parquet(f"{root}/events")
        )

    return (
        first_of_each(stream).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
