"""Explicit schemas of the typed tables (no inference on import)."""

from __future__ import annotations

# --- fixed values: required columns of the source package ---
LOAD_COLUMNS = (
    "load_id", "origin_city", "origin_state", "origin_zip", "destination_city",
    "destination_state", "destination_zip", "distance_miles", "equipment_type", "weight_lbs",
    "pickup_date", "pickup_window", "delivery_date", "offered_rate_usd", "status",
    "shipper_name", "internal_notes",
)
RATE_COLUMNS = (
    "week_start", "origin_state", "destination_state", "equipment_type", "avg_rate_per_mile",
    "min_rate_per_mile", "max_rate_per_mile", "load_volume",
)
EMAIL_KEYS = ("email_id", "timestamp", "from_email", "to_email", "subject", "body")

LOAD = (
    "snapshot_id string, load_id string, status string, origin_city string, origin_state string,"
    " origin_zip string, destination_city string, destination_state string,"
    " destination_zip string, distance_miles int, equipment_code string, equipment_raw string,"
    " weight_lbs int, pickup_date date, pickup_window_raw string, pickup_window_status string,"
    " pickup_start_at timestamp, pickup_end_at timestamp, delivery_date date,"
    " offered_rate_usd decimal(10,2), shipper_name string, internal_notes string"
)
MARKET_RATE = (
    "snapshot_id string, week_start date, origin_state string, destination_state string,"
    " equipment_code string, average_rate_per_mile decimal(8,2),"
    " minimum_rate_per_mile decimal(8,2), maximum_rate_per_mile decimal(8,2), load_volume int"
)
CARRIER = (
    "mc_number string, dot_number string, company_name string, primary_contact string,"
    " email string, phone string, address string, equipment_types array<string>,"
    " preferred_lanes array<string>, home_base_zip string, factoring_company string,"
    " payment_terms_preference string, reliability_score string, loads_completed string,"
    " avg_response_time_hours string, insurance_expiry string, authority_status string,"
    " safety_rating string, notes string, onboarded boolean"
)
EMAIL = (
    "email_id string, timestamp string, from_name string, from_email string, to_email string,"
    " subject string, body string, mc_number string, load_reference string,"
    " equipment_mentioned string, rate_quoted_usd string, intent string"
)
SUBMISSION = (
    "event_id string, sender_email_raw string, subject string, body_text string,"
    " submitted_at timestamp"
)
JOB_TRANSITION = "job_id string, transition string, at_time timestamp, seq_key bigint"
