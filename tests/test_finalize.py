"""One email and one call through the whole chain."""

import json

from brokerlake.operators import candidates as cand
from brokerlake.operators.finalize import finalize_communications


def test_email_and_call(spark):
    body = "Blue Ridge can take load 1001 with a box truck. You said 240, we need 280."
    ref = lambda text, **more: {"source_part": "body", "excerpt": text, **more}
    email = {"inquiries": [{
        "carrier_name": "Blue Ridge", "carrier_name_evidence": ref("Blue Ridge"),
        "mc_number": "MC 77", "load_reference": "load 1001",
        "load_reference_evidence": ref("load 1001"), "equipment": " box TRUCK ",
        "equipment_evidence": ref("box truck"), "availability": "confirmed",
        "availability_evidence": ref("never said"), "intents": ["rate_negotiation", "availability"],
        "rates": [{"amount": 240, "role": "broker_rate_reference", "basis": "all_in",
                   "evidence": ref("240")},
                  {"amount": 280, "role": "carrier_counteroffer", "basis": "all_in",
                   "evidence": ref("280")}],
        "questions": [{"category": "weight", "text": "heavy?"}], "summary": "offer"}]}
    call = {"inquiries": [{
        "carrier_name": "blue rigde", "mc_number": None, "load_reference": None, "equipment": None,
        "carrier_name_evidence": {"source_part": "transcript", "excerpt": "hello",
                                  "segment_sequence": 0},
        "availability": "not_stated", "intents": ["other"], "rates": [], "questions": [],
        "summary": "call"}]}
    frame = spark.createDataFrame
    raw = frame([("email:1", json.dumps(email)), ("call:1", json.dumps(call)), ("email:2", "{}")],
                "event_id string, raw_json string")
    events = frame([("email:1", "s"), ("call:1", "s"), ("email:2", "s")],
                   "event_id string, snapshot_id string").selectExpr(
        "*", "if(event_id = 'email:1', timestamp'2026-05-01', null) occurred_at",
        "timestamp'2026-05-02' received_at")
    emails = frame([("email:1", "a@b.example", "offer", body, "Flatbed", None, None),
                    ("email:2", "a@b.example", "x", "y", None, None, None)],
                   "event_id string, sender_email_raw string, subject string, body_text string,"
                   " noted_equipment string, noted_mc string, noted_load string")
    segments = frame([("call:1", 0, "hello there", 0.5)],
                     "event_id string, sequence int, text string, c double").selectExpr(
        "event_id", "sequence", "text", "cast(0 as decimal(8,2)) start_seconds",
        "cast(2 as decimal(8,2)) end_seconds", "cast(c as decimal(5,4)) confidence")
    carriers = frame([("k1", "s", "Blue Ridge Transport", "77", None, "ACTIVE", "Satisfactory", True)],
                     "carrier_id string, snapshot_id string, company_name string,"
                     " mc_number_normalized string, dot_number_normalized string,"
                     " authority_status string, safety_rating string, onboarded boolean").selectExpr(
        "*", "date'2027-01-01' insurance_expiry", "cast(4.5 as decimal(3,1)) reliability_score",
        "3 loads_completed", "cast(1 as decimal(6,2)) avg_response_time_hours")
    contacts = frame([], "carrier_id string, email_normalized string, phone_normalized string")
    loads = frame([("s", "1001", "box_truck", 115)],
                  "snapshot_id string, load_id string, equipment_code string, distance_miles int"
                  ).selectExpr("*", "date'2026-05-10' pickup_date")
    job_rows = frame([("email:1", "processing", None, None), ("call:1", "processing", None, None),
                      ("email:2", "processing", None, None)],
                     "event_id string, status string, load_hint string, carrier_hint string")
    aliases = frame([("dataset", "box truck", "box_truck")],
                    "source string, normalized_label string, equipment_code string")
    types = frame([("box_truck", "Box Truck", True)],
                  "code string, display_name string, is_active boolean")
    done = finalize_communications(raw, events, emails, segments, carriers, contacts, loads,
                                   job_rows, aliases, types)
    rows = {r.inquiry_id: r for r in done.inquiries.collect()}
    offer, spoken = rows["email:1#1"], rows["call:1#1"]
    assert (offer.carrier_id, offer.load_id, offer.equipment_code) == ("k1", "1001", "box_truck")
    assert offer.review_status == "unreviewed" and spoken.review_status == "needs_review"
    assert spoken.carrier_resolution_status == "needs_review"
    reasons = {(r.inquiry_id, r.code, r.severity) for r in done.reasons.collect()}
    assert reasons == {
        ("email:1#1", "metadata_content_conflict", "informational"),
        ("call:1#1", "weak_carrier_match", "review"),
        ("call:1#1", "low_confidence_transcript_evidence", "review")}
    fields = {(r.inquiry_id, r.field_name): r.evidence_status for r in done.assessments.collect()}
    assert fields["email:1#1", "availability"] == "inferred"
    assert fields["email:1#1", "rate"] == "explicit" and fields["call:1#1", "rate"] == "missing"
    assert fields["call:1#1", "carrier_identity"] == "explicit"
    spans = {r.span_id for r in done.spans.collect()}
    assert "email:1#body:0-10" in spans and "call:1#0.00-2.00" in spans
    assert {r.event_id: r.rolled_status for r in done.jobs.collect()} == {
        "email:1": "completed", "call:1": "needs_review", "email:2": "failed"}
    assert [r.event_id for r in done.invalid.collect()] == ["email:2"]
    facts = cand.current_facts(done.inquiries, done.quotes)
    assessed = cand.eligibility(facts, carriers, loads).first()
    assert assessed.final_status == "eligible" and assessed.current_quote.amount == 280
