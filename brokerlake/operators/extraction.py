"""Strict contract for extracted JSON, and its typed, exploded form.

The contract (``contract``) is compiled once and walks each document once, a batch at a time:
unknown keys, missing versus null keys, kinds, enumerations and ranges, at every level. Numbers may
arrive as numeric strings. Only the JSON column travels to Python; typed rows come from Spark.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions.text import casefold, strip, strip_nul
from brokerlake.operators import contract
from brokerlake.scale import durable

_EVIDENCE = (
    "struct<source_part:string,excerpt:string,occurrence:string,segment_sequence:string>"
)
SCHEMA = (
    "struct<inquiries:array<struct<"
    f"carrier_name:string,carrier_name_evidence:{_EVIDENCE},"
    f"mc_number:string,mc_number_evidence:{_EVIDENCE},"
    "dot_number:string,contact_email:string,contact_phone:string,"
    f"load_reference:string,load_reference_evidence:{_EVIDENCE},"
    f"equipment:string,equipment_evidence:{_EVIDENCE},"
    f"availability:string,availability_evidence:{_EVIDENCE},"
    "intents:array<string>,"
    f"rates:array<struct<amount:string,currency:string,role:string,basis:string,evidence:{_EVIDENCE}>>,"
    f"questions:array<struct<category:string,text:string,evidence:{_EVIDENCE}>>,"
    f"conditions:string,conditions_evidence:{_EVIDENCE},summary:string>>>"
)

# --- fixed values: the contract's keys ---
_EVIDENCE_KEYS = ("source_part", "excerpt", "occurrence", "segment_sequence")
_RATE_KEYS = ("amount", "currency", "role", "basis", "evidence")
_QUESTION_KEYS = ("category", "text", "evidence")
_NULLABLE_REQUIRED = ("carrier_name", "mc_number", "load_reference", "equipment")
_NULLABLE_OPTIONAL = ("dot_number", "contact_email", "contact_phone", "conditions")
_INQUIRY_EVIDENCE = (
    "carrier_name_evidence", "mc_number_evidence", "load_reference_evidence",
    "equipment_evidence", "availability_evidence", "conditions_evidence",
)
_INQUIRY_KEYS = (
    *_NULLABLE_REQUIRED, *_NULLABLE_OPTIONAL, *_INQUIRY_EVIDENCE,
    "availability", "intents", "rates", "questions", "summary",
)

def _inquiry_contract() -> contract.Check:
    evidence = contract.optional(contract.record(
        _EVIDENCE_KEYS, ("source_part", "excerpt"),
        ("source_part", contract.choice(vocab.SOURCE_PARTS)),
        ("excerpt", contract.text(non_empty=True)),
        ("occurrence", contract.whole("not_a_positive_integer", least=1)),
        ("segment_sequence", contract.whole("not_an_integer", nullable=True)),
    ))
    rate = contract.record(
        _RATE_KEYS, ("amount", "role", "basis"),
        ("amount", contract.amount()), ("currency", contract.text()),
        ("role", contract.choice(vocab.QUOTE_TYPES)), ("basis", contract.choice(vocab.RATE_BASES)),
        ("evidence", evidence),
    )
    question = contract.record(
        _QUESTION_KEYS, ("category", "text"),
        ("category", contract.choice(vocab.QUESTION_CATEGORIES)),
        ("text", contract.text(non_empty=True)), ("evidence", evidence),
    )
    nullable = contract.text(nullable=True)
    return contract.record(
        _INQUIRY_KEYS,
        (*_NULLABLE_REQUIRED, "availability", "intents", "rates", "questions", "summary"),
        *((key, nullable) for key in (*_NULLABLE_REQUIRED, *_NULLABLE_OPTIONAL)),
        ("summary", contract.text()),
        ("availability", contract.choice(vocab.EXTRACTED_AVAILABILITY)),
        ("intents", contract.not_empty_list),
        *((key, evidence) for key in _INQUIRY_EVIDENCE),
        ("intents", contract.each(contract.choice(vocab.INTENTS))),
        ("rates", contract.each(rate)), ("questions", contract.each(question)),
    )


_errors_of = contract.document("inquiries", _inquiry_contract())


def _errors_of_batch(documents: pa.Array) -> pa.Array:
    return pa.array(map(_errors_of, documents.to_pylist()), pa.list_(pa.string()))


def check_extractions(raw: DataFrame, column: str = "raw_json") -> DataFrame:
    """Add ``errors`` (``path: kind``; the first ten) and ``validation_status``.

    A NULL or empty document is malformed; repeated rows are checked each for itself.
    """
    errors = F.arrow_udf(_errors_of_batch, "array<string>")
    checked = raw.withColumn(column, strip_nul(F.col(column)))
    return checked.withColumn("errors", errors(F.col(column))).withColumn(
        "validation_status", F.when(F.size("errors") == 0, "valid").otherwise("invalid")
    )


def validate_extractions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): valid rows carry the typed ``proposal``.

    The verdicts are stored once: several consumers read them, and each would otherwise check
    every document again.
    """
    checked = durable(check_extractions(raw))
    valid = checked.where("validation_status = 'valid'").withColumn(
        "proposal", F.from_json("raw_json", SCHEMA)
    )
    return valid.drop("errors"), checked.where("validation_status = 'invalid'")


def explode_inquiries(valid: DataFrame) -> DataFrame:
    """One row per proposed inquiry, numbered from 1; intents keep their order."""
    exploded = valid.select("event_id", F.posexplode("proposal.inquiries").alias("_i", "item"))
    return exploded.select(
        F.concat_ws("#", "event_id", (F.col("_i") + 1).cast("string")).alias("inquiry_id"),
        "event_id",
        (F.col("_i") + 1).alias("sequence_number"),
        "item.*",
    ).withColumn("intents", F.array_distinct("intents")).withColumn(
        "primary_intent", F.element_at("intents", 1)
    )


def inquiry_intents(inquiries: DataFrame) -> DataFrame:
    return inquiries.select(
        "inquiry_id", F.posexplode("intents").alias("_i", "intent")
    ).select("inquiry_id", "intent", (F.col("_i") == 0).alias("is_primary"))


def inquiry_questions(inquiries: DataFrame) -> DataFrame:
    return inquiries.select("inquiry_id", F.inline("questions")).drop("evidence")


def resolve_equipment(
    df: DataFrame, raw: str, aliases: DataFrame, types: DataFrame, source: str | None = None
) -> DataFrame:
    """Add ``equipment_code``: alias label first, then code or display name of an active type.

    Aliases and types are the equipment vocabulary; the lookup is one map built from it per
    label, joined by equality. It goes to every task, as rows with one label are many.
    """
    by_alias = aliases if source is None else aliases.where(F.col("source") == source)
    labels = by_alias.select(
        F.col("normalized_label").alias("_label"), F.col("equipment_code").alias("_code"),
        F.lit(0).alias("_tier"),
    )
    if source is None:
        active = types.where("is_active")
        for column in ("code", "display_name"):
            labels = labels.unionByName(
                active.select(
                    casefold(F.col(column)).alias("_label"), F.col("code").alias("_code"),
                    F.lit(1).alias("_tier"),
                )
            )
    lookup = labels.groupBy("_label").agg(
        F.min(F.struct("_tier", "_code"))["_code"].alias("equipment_code")
    )
    return (
        df.withColumn("_label", casefold(strip(F.col(raw))))
        .join(F.broadcast(lookup), "_label", "left")
        .drop("_label")
    )
