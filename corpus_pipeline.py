"""The training-data pipeline: score, deduplicate, redact, mix and pack the documents table.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, reread from Parquet. All
but the last return the columns of ``docs`` as they came, extra ones included.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlake.llm import mixing, packing, pii, quality, simhash
from brokerlake.llm.common import stored, table

#: Names that no column of documents has.
_SCORE, _ROW, _NAME = "__pipeline_score", "__pipeline_row", "__pipeline_doc_id"
_KEY, _GROUP = "__pipeline_key", "__pipeline_group"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; a NULL text is judged as the empty text."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, _SCORE)
    return scored.where(F.col(_SCORE) >= quality.THRESHOLD).drop(_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, NULL last, then by hash of text.

    Rows are told apart by id and text together, so unlike texts under one id are documents of their
    own, and rows without id join groups like any other. Rows equal in both are one document.
    """
    key = F.xxhash64("doc_id", "text")
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).select(
        F.col("doc_id").alias(_ROW), F.col("component_id").alias(_GROUP)
    )
    ids = docs.select(key.alias(_NAME), F.col("doc_id").isNull().alias("_last"), "doc_id")
    first = F.min(F.struct("_last", "doc_id", _NAME))
    chosen = stored(
        ids.join(found.distinct(), F.col(_NAME) == F.col(_ROW))
        .groupBy(_GROUP).agg(first.alias("_first")).select(F.col(f"_first.{_NAME}").alias(_NAME)),
        "chosen",
    )
    named = docs.withColumn(_KEY, key)
    kept = named.join(chosen, F.col(_KEY) == F.col(_NAME), "left_semi")
    # the join has brought equal keys together, so this needs no further shuffle
    one = kept.groupBy(F.col(_KEY)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(_ROW))
    return one.select(f"{_ROW}.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, n_chars following; a NULL text stays NULL."""
    model = pii.fit(docs)

    def redact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [
                None if text is None else pii.redact(text, model)
                for text in batch.column("text").to_pylist()
            ]
            at = batch.schema.names.index("text")
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(found, field.type))

    redacted = docs.mapInArrow(redact, docs.schema)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in rows of their own."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document (a repeated one each time) in the sequences."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.tokenized_pieces(docs, vocabulary))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mix sources", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the trees and the tokenizer are beyond SQL; tests hold each stage to a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
