"""Vocabularies, limits and thresholds that results depend on."""

# --- fixed values: states and controlled vocabularies ---
LOAD_STATUS = ("open", "covered", "delivered", "cancelled")
WINDOW_STATUS = ("range", "single_time", "qualitative", "missing", "invalid")
AVAILABILITY = ("confirmed", "conditional", "unavailable", "not_stated", "conflicting")
EXTRACTED_AVAILABILITY = ("confirmed", "conditional", "unavailable", "not_stated")
RESOLUTION = ("verified", "needs_review", "unmatched")
REVIEW_STATUS = ("unreviewed", "needs_review", "approved", "rejected")
INTENTS = (
    "availability", "rate_quote", "rate_negotiation", "load_detail_question", "compliance",
    "confirmation", "decline", "factoring_or_payment", "problem_or_exception",
    "general_inquiry", "other",
)
QUESTION_CATEGORIES = (
    "rate", "weight", "pickup_window", "delivery", "equipment", "load_details", "compliance",
    "next_steps", "other",
)
EVIDENCE_STATUS = ("explicit", "inferred", "missing", "conflicting")
MATCH_TIERS = ("exact", "strong", "weak", "conflicting")
QUOTE_TYPES = (
    "carrier_quote", "carrier_counteroffer", "broker_rate_reference", "accepted_broker_rate",
    "ambiguous",
)
CARRIER_ROLES = ("carrier_quote", "carrier_counteroffer")
RATE_BASES = ("all_in", "per_mile", "hourly", "unknown")
SOURCE_PARTS = ("subject", "body", "transcript")
JOB_STATUS = ("queued", "processing", "completed", "needs_review", "failed")
BATCH_STATUS = ("queued", "processing", "completed", "partially_failed", "failed")
COMPONENT_RESULTS = ("pass", "fail", "unknown", "not_applicable")
FINAL_STATUS = (
    "blocked", "needs_compliance_review", "needs_clarification", "needs_onboarding", "eligible",
)
REASON_SEVERITIES = ("blocker", "review", "warning", "information")
REVIEW_SEVERITIES = ("review", "informational")
REVIEW_ACTIONS = (
    "approve_extraction", "reject_extraction", "reopen_review", "correct_carrier", "correct_load",
)
CARRIER_REASON_CODES = (
    "missing_mc", "garbled_mc", "weak_carrier_match", "conflicting_carrier_identity",
)
LOAD_REASON_CODES = ("ambiguous_load_reference", "conflicting_load_reference")
USAGE_CATEGORIES = ("ingestion", "assistant", "drafting", "evaluation")

# --- fixed values: equipment labels of the source package, and the wider synonym list ---
EQUIPMENT_LABELS = {
    "Box Truck": "box_truck",
    "Sprinter Van": "sprinter_van",
    "Flatbed": "flatbed",
    "Refrigerated": "refrigerated",
}
EQUIPMENT_SYNONYMS = {
    "box_truck": ("box truck", "box_truck", "straight truck", "26ft box", "box"),
    "sprinter_van": ("sprinter", "cargo van", "sprinter_van", "van"),
    "flatbed": ("flatbed", "flat bed"),
    "refrigerated": ("reefer", "refrigerated", "refer truck"),
}

# --- fixed values: compliance policy v1 ---
POLICY_VERSION = "carrier_eligibility_v1"
AUTHORITY_PASS = ("ACTIVE",)
AUTHORITY_FAIL = ("INACTIVE", "REVOKED", "SUSPENDED")
SAFETY_PASS = ("Satisfactory",)
SAFETY_FAIL = ("Unsatisfactory",)

# --- fixed values: board ranks and labels ---
LOAD_STATUS_RANK = {"open": 0, "covered": 1, "delivered": 2}
CANDIDATE_STATUS_RANK = {
    "eligible": 0, "needs_clarification": 1, "needs_compliance_review": 2,
    "needs_onboarding": 3, "blocked": 4,
}
BAND_LABELS = {
    "below_minimum": "Below market min",
    "within_band": "In market band",
    "above_maximum": "Above market max",
}
INTENT_LABELS = {
    "availability": "Availability",
    "rate_quote": "Rate inquiry",
    "rate_negotiation": "Rate counteroffer",
    "load_detail_question": "Load details",
    "compliance": "Compliance info",
    "confirmation": "Confirmation",
    "decline": "Decline",
    "factoring_or_payment": "Factoring / payment",
    "problem_or_exception": "Problem / exception",
    "general_inquiry": "General inquiry",
    "other": "Other",
}

# --- fixed values: limits ---
MAX_WAV_BYTES = 25 * 1024 * 1024
MAX_WAV_SECONDS = 600
MAX_JOB_RETRIES = 3
NAME_SIMILARITY_THRESHOLD = 0.6
CONTAINMENT_SCORE = 0.75
LOW_CONFIDENCE = 0.7
STALE_PROCESSING_SECONDS = 1800
STALE_QUEUED_SECONDS = 900
MAX_SENDER_NAME = 255
MAX_SENDER_EMAIL = 320
MAX_SUBJECT = 998
MAX_BODY = 50_000
MAX_LOAD_HINT = 64
MAX_CARRIER_HINT = 255
PERMANENT_ERROR_CODES = ("unsupported_media", "invalid_source")
SEARCH_LIMIT = 10
HISTORY_LIMIT = 15
CONVERSATION_LIMIT = 12
GROUNDING_PASS = 0.75

# --- fixed values: evaluation categories and the advice shown for each ---
METRIC_CATEGORY = {
    "intent": "intent_classification",
    "availability": "availability",
    "equipment": "equipment_normalization",
    "load_reference": "identifier_extraction",
    "mc_number": "identifier_extraction",
    "rate_value": "rate_extraction",
    "rate_role": "rate_role_confusion",
    "grounding_rate": "evidence_grounding",
    "carrier_resolution": "entity_resolution",
    "load_resolution": "entity_resolution",
}
IMPROVEMENTS = {
    "identifier_extraction": "Tighten identifier examples in the prompt or normalization.",
    "rate_role_confusion": "Add contrastive rate-role examples to the prompt.",
    "rate_extraction": "Check rate mention coverage in the prompt rules.",
    "equipment_normalization": "Extend equipment synonyms (aliases or prompt).",
    "availability": "Sharpen explicit-vs-conditional availability definitions.",
    "intent_classification": "Add intent definitions/examples to the prompt.",
    "evidence_grounding": "Strengthen the exact-excerpt requirement in the prompt.",
    "entity_resolution": "Inspect matcher signals; the identifier may have been missed upstream.",
}

# --- fixed values: price list (per million tokens, or per audio minute) ---
PRICING_VERSION = "pricing-2026-08"
TOKEN_PRICES = {"gpt-5.6-luna": ("0.20", "1.20")}
AUDIO_PRICES = {"nova-3": "0.0043"}
