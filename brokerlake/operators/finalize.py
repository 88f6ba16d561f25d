"""From extraction results to resolved inquiries, reasons, candidates and job states in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.functions.text import canonical_address
from brokerlake.operators import candidates as cand, extraction, grounding, jobs, matching
from brokerlake.scale import durable


@dataclass(frozen=True)
class Finalized:
    """Tables of one run, keyed as in the rest of the package."""

    invalid: DataFrame
    inquiries: DataFrame
    intents: DataFrame
    questions: DataFrame
    spans: DataFrame
    assessments: DataFrame
    quotes: DataFrame
    weak_matches: DataFrame
    reasons: DataFrame
    candidates: DataFrame
    jobs: DataFrame


def finalize_communications(
    raw: DataFrame,
    events: DataFrame,
    emails: DataFrame,
    segments: DataFrame,
    carriers: DataFrame,
    contacts: DataFrame,
    loads: DataFrame,
    job_rows: DataFrame,
    aliases: DataFrame,
    equipment_types: DataFrame,
) -> Finalized:
    """The same plan for a batch of communications and for a micro-batch.

    ``raw``: event_id, raw_json. ``events``: event_id, snapshot_id, occurred_at, received_at.
    ``emails``: event_id, sender_email_raw, subject, body_text, noted_equipment, noted_mc,
    noted_load. ``job_rows``: event_id, status, load_hint, carrier_hint.
    """
    valid, invalid = extraction.validate_extractions(raw)
    proposed = extraction.explode_inquiries(valid)
    grounded = durable(grounding.ground(grounding.field_mentions(proposed), emails, segments))
    grounded_rates = grounding.ground(grounding.rate_mentions(proposed), emails, segments)
    grounded_rates = durable(grounded_rates)
    quotes = grounding.quote_supersession(grounded_rates)
    assessments = grounding.field_assessments(grounded).drop("span_id").unionByName(
        grounding.rate_assessment(proposed, quotes)
    )

    envelope = emails.select(
        "event_id",
        canonical_address(F.col("sender_email_raw")).alias("sender_email_normalized"),
        "noted_equipment", "noted_mc", "noted_load",
    )
    hints = job_rows.select(
        "event_id", "load_hint", F.col("carrier_hint").alias("manual_hint")
    )
    known = (
        proposed.drop("rates", "questions")
        .join(events.select("event_id", "snapshot_id", "occurred_at", "received_at"), "event_id")
        .join(envelope, "event_id", "left")
        .join(hints, "event_id", "left")
    )
    typed = durable(extraction.resolve_equipment(known, "equipment", aliases, equipment_types))
    exact = durable(
        matching.match_carrier_exact(typed, matching.carrier_index(carriers, contacts))
    )
    undecided = typed.join(exact.where("identity = 'none'"), "inquiry_id", "left_semi")
    weak = durable(matching.match_carrier_weak(undecided, carriers))
    placed = matching.match_load(typed, loads)
    unsure = grounding.low_confidence(grounded).withColumn("_unsure", F.lit(True))
    proposals = weak.select("inquiry_id").distinct().withColumn("_weak", F.lit(True))
    resolved = (
        matching.metadata_conflicts(typed)
        .join(exact, "inquiry_id")
        .join(
            placed.select("inquiry_id", "load_id", "load_resolution_status",
                          F.col("reason_code").alias("load_reason")),
            "inquiry_id",
        )
        .join(proposals, "inquiry_id", "left")
        .join(unsure, "inquiry_id", "left")
        .withColumn("weak_found", F.coalesce("_weak", F.lit(False)))
        .withColumn("low_confidence", F.coalesce("_unsure", F.lit(False)))
        .drop("_weak", "_unsure")
    )
    resolved = durable(resolved)
    reasons = matching.review_reasons(resolved).withColumn(
        "resolved_at", F.lit(None).cast("timestamp")
    )
    needs_review = (F.col("identity") == "conflicting") | (
        (F.col("identity") == "none") & F.col("weak_found")
    )
    carrier_status = (
        F.when(F.col("identity") == "verified", "verified")
        .when(needs_review, "needs_review").otherwise("unmatched")
    )
    inquiries = matching.review_status_derive(
        resolved.select(
            "inquiry_id", "event_id", "sequence_number", "primary_intent",
            F.col("availability").alias("availability_status"), "equipment_code",
            F.col("equipment").alias("equipment_raw"), "summary",
            F.coalesce("conditions", F.lit("")).alias("conditions_text"), "carrier_id", "load_id",
            carrier_status.alias("carrier_resolution_status"), "load_resolution_status",
            "occurred_at", "received_at",
        ),
        reasons,
    )
    # a processing job ends as its inquiries say, or fails when its extraction broke the contract
    verdicts = valid.select("event_id", F.lit(True).alias("_ok")).unionByName(
        invalid.select("event_id", F.lit(False).alias("_ok"))
    ).groupBy("event_id").agg(F.bool_or("_ok").alias("_ok"))
    running = F.col("status") == "processing"
    ended = (
        job_rows.join(verdicts, "event_id", "left")
        .withColumn(
            "last_error_code", F.when(running & ~F.col("_ok"), "extraction_schema_failure")
        )
        .withColumn(
            "status",
            F.when(running & F.col("_ok"), "completed").when(running & ~F.col("_ok"), "failed")
            .otherwise(F.col("status")),
        )
        .drop("_ok")
    )
    return Finalized(
        invalid=invalid,
        inquiries=inquiries,
        intents=extraction.inquiry_intents(proposed),
        questions=extraction.inquiry_questions(proposed),
        spans=grounding.evidence_spans(
            grounded.select(*_SPAN).unionByName(grounded_rates.select(*_SPAN))
        ),
        assessments=assessments,
        quotes=quotes,
        weak_matches=weak,
        reasons=reasons,
        candidates=cand.candidate_build(inquiries),
        jobs=jobs.job_review_rollup(ended, inquiries),
    )


_SPAN = [
    "event_id", "span_id", "source_part", "excerpt", "start_offset", "end_offset",
    "start_seconds", "end_seconds", "segment_sequence",
]
