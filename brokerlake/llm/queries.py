"""The operators as registered queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlake.llm import (
    alignment, chat, embeddings, fingerprints, html_extraction, lexical, mixing, packing, pii, quality,
    simhash, token_files, warc,
)
from brokerlake.llm.common import table


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def pii_detection(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.detect(docs, pii.fit(docs))


def simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def token_output(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.read_tokens(token_files.write_tokens(docs, vocabulary))


def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, folder, "pages")))


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.tokenized_pieces(docs, vocabulary))


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(chat.PLANTED, given.schema)
    return chat.digests(chat.format_conversations(given.unionByName(planted)))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_corpus(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


QUERIES = {
    "op1_quality_classifier": quality_classifier,
    "op2_html_extraction": html_main_text,
    "op3_embedding_dedup": embedding_dedup,
    "op4_pii_detection": pii_detection,
    "op5_simhash_dedup": simhash_dedup,
    "op6_mix_sources": mix_sources,
    "op7_token_output": token_output,
    "op8_document_fingerprints": document_fingerprints,
    "op9_warc_archives": warc_archives,
    "op10_best_fit_packing": best_fit_packing,
    "op11_chat_formatting": chat_formatting,
    "op12_lexical_search": lexical_search,
    "op13_token_alignment": token_alignment,
}

ORACLES = {
    "op3_embedding_dedup": embeddings.ALL_PAIRS_SQL,
    "op6_mix_sources": mixing.MIX_SQL,
    "op9_warc_archives": warc.RECORDS_SQL,
    "op11_chat_formatting": chat.CHAT_SQL,
    "op12_lexical_search": lexical.SEARCH_SQL,
}
