"""SQL fragments shared by the oracles. They restate the rules independently of the DataFrame
code: ASOF joins, windows and integer arithmetic in cents."""

from __future__ import annotations


def half_up(a: str, b: str) -> str:
    """Half-up rounded quotient of non-negative integers."""
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


def half_even(a: str, b: str) -> str:
    """Half-even rounded quotient of non-negative integers."""
    return (
        f"(({a}) // ({b}) + CASE WHEN 2 * (({a}) % ({b})) > ({b}) OR (2 * (({a}) % ({b})) = ({b})"
        f" AND (({a}) // ({b})) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def band(value: str, low: str, high: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL OR {low} IS NULL THEN NULL WHEN {value} < {low}"
        f" THEN 'below_minimum' WHEN {value} > {high} THEN 'above_maximum' ELSE 'within_band' END"
    )


MARKET = f""", market AS (
  SELECT l.*, r.week_start, r.min_cents, r.avg_cents, r.max_cents, r.load_volume,
    CASE WHEN l.distance_miles > 0 THEN {half_up('l.offered_cents', 'l.distance_miles')} END
      AS pm_cents
  FROM loads l ASOF LEFT JOIN market_rates r
    ON l.snapshot_id = r.snapshot_id AND l.origin_state = r.origin_state
   AND l.destination_state = r.destination_state AND l.equipment_code = r.equipment_code
   AND l.pickup_date >= r.week_start
), banded AS (
  SELECT *, {band('pm_cents', 'min_cents', 'max_cents')} AS band_position FROM market)
"""


def latest(name: str, source: str, key: str, time: str, value: str) -> str:
    """CTE with (key, value, conflict) by the conflict-aware latest rule."""
    return f""", {name}_t AS (
  SELECT {key} AS k, {time} AS t, {value} AS v, max({time}) OVER (PARTITION BY {key}) AS mt
  FROM {source} WHERE {value} IS NOT NULL
), {name} AS (
  SELECT k, CASE WHEN count(DISTINCT v) = 1 THEN min(v) WHEN bool_or(t IS NULL) THEN NULL
      WHEN count(DISTINCT v) FILTER (WHERE t = mt) > 1 THEN NULL
      ELSE min(v) FILTER (WHERE t = mt) END AS value,
    CASE WHEN count(DISTINCT v) = 1 THEN false WHEN bool_or(t IS NULL) THEN true
      ELSE count(DISTINCT v) FILTER (WHERE t = mt) > 1 END AS conflict
  FROM {name}_t GROUP BY k)
"""


FACTS = (
    """, linked AS (
  SELECT *, load_id || '|' || carrier_id AS candidate_id FROM inquiries
  WHERE load_id IS NOT NULL AND carrier_id IS NOT NULL
), live AS (SELECT * FROM linked WHERE review_status <> 'rejected'
), said AS (SELECT * FROM live WHERE availability_status <> 'not_stated'
), offered AS (
  SELECT l.candidate_id, l.occurred_at, q.quote_id FROM live l JOIN quotes q USING (inquiry_id)
  WHERE q.is_current AND q.evidence_status = 'explicit'
    AND q.quote_type IN ('carrier_quote', 'carrier_counteroffer'))
"""
    + latest("av", "said", "candidate_id", "occurred_at", "availability_status")
    + latest("eq", "live", "candidate_id", "occurred_at", "equipment_code")
    + latest("qu", "offered", "candidate_id", "occurred_at", "quote_id")
    + """, idv AS (
  SELECT candidate_id, load_id, carrier_id, bool_or(review_status <> 'rejected' AND
    carrier_resolution_status = 'verified' AND load_resolution_status = 'verified')
    AS identity_verified
  FROM linked GROUP BY ALL
), facts AS (
  SELECT i.candidate_id, i.load_id, i.carrier_id, i.identity_verified,
    av.value AS current_availability, coalesce(av.conflict, false) AS availability_conflict,
    eq.value AS current_equipment, coalesce(eq.conflict, false) AS equipment_conflict,
    qu.value AS quote_id, coalesce(qu.conflict, false) AS quote_conflict
  FROM idv i LEFT JOIN av ON av.k = i.candidate_id LEFT JOIN eq ON eq.k = i.candidate_id
  LEFT JOIN qu ON qu.k = i.candidate_id)
"""
)

POLICY = """, policy AS (
  SELECT f.*, c.authority_status, c.safety_rating, c.insurance_expiry, c.onboarded,
    c.company_name, c.reliability_tenths, c.loads_completed, c.response_hundredths,
    l.pickup_date, l.distance_miles, l.equipment_code AS load_equipment,
    CASE WHEN authority_status = 'ACTIVE' THEN 'pass'
      WHEN authority_status IN ('INACTIVE', 'REVOKED', 'SUSPENDED') THEN 'fail'
      ELSE 'unknown' END AS authority_result,
    CASE WHEN safety_rating = 'Satisfactory' THEN 'pass'
      WHEN safety_rating = 'Unsatisfactory' THEN 'fail' ELSE 'unknown' END AS safety_result,
    CASE WHEN insurance_expiry IS NULL THEN 'unknown' WHEN insurance_expiry >= l.pickup_date
      THEN 'pass' ELSE 'fail' END AS insurance_result
  FROM facts f JOIN carriers c USING (carrier_id) JOIN loads l USING (load_id)
), complied AS (
  SELECT *, CASE WHEN 'fail' IN (authority_result, safety_result, insurance_result) THEN 'fail'
    WHEN 'unknown' IN (authority_result, safety_result, insurance_result) THEN 'needs_review'
    ELSE 'pass' END AS compliance_result FROM policy)
"""

ASSESSED = (
    FACTS
    + POLICY
    + """, parts AS (
  SELECT *, CASE WHEN identity_verified THEN 'pass' ELSE 'unknown' END AS identity_result,
    CASE WHEN load_equipment IS NULL OR current_equipment IS NULL THEN 'unknown'
      WHEN load_equipment = current_equipment THEN 'pass' ELSE 'fail' END AS equipment_result,
    CASE WHEN current_availability = 'confirmed' THEN 'pass'
      WHEN current_availability = 'unavailable' THEN 'fail' ELSE 'unknown' END
      AS availability_result,
    CASE WHEN onboarded IS NULL THEN 'unknown' WHEN onboarded THEN 'pass' ELSE 'fail' END
      AS onboarding_result
  FROM complied
), assessed AS (
  SELECT *, CASE
    WHEN 'fail' IN (compliance_result, equipment_result, availability_result) THEN 'blocked'
    WHEN compliance_result = 'needs_review' THEN 'needs_compliance_review'
    WHEN equipment_result <> 'pass' OR availability_result <> 'pass' OR identity_result <> 'pass'
      OR quote_conflict OR onboarding_result = 'unknown' THEN 'needs_clarification'
    WHEN onboarding_result = 'fail' THEN 'needs_onboarding' ELSE 'eligible' END AS final_status
  FROM parts)
"""
)

REASONS = """, raised AS (
  SELECT candidate_id, 1 AS ord, 'authority' AS component, 'authority_inactive' AS code,
    'blocker' AS severity, authority_status AS observed, 'ACTIVE' AS required
  FROM assessed WHERE authority_result = 'fail'
  UNION ALL SELECT candidate_id, 2, 'authority', 'authority_unknown', 'review', authority_status,
    'ACTIVE' FROM assessed WHERE authority_result = 'unknown'
  UNION ALL SELECT candidate_id, 3, 'safety', 'safety_unacceptable', 'blocker', safety_rating,
    'Satisfactory' FROM assessed WHERE safety_result = 'fail'
  UNION ALL SELECT candidate_id, 4, 'safety', 'safety_unknown', 'review', safety_rating,
    'Satisfactory' FROM assessed WHERE safety_result = 'unknown'
  UNION ALL SELECT candidate_id, 5, 'insurance', 'insurance_expired', 'blocker',
    cast(insurance_expiry AS varchar), '>= ' || cast(pickup_date AS varchar)
  FROM assessed WHERE insurance_result = 'fail'
  UNION ALL SELECT candidate_id, 6, 'insurance', 'insurance_expiry_unknown', 'review', '',
    '>= ' || cast(pickup_date AS varchar) FROM assessed WHERE insurance_result = 'unknown'
  UNION ALL SELECT candidate_id, 7, 'onboarding', 'carrier_not_onboarded', 'review', 'False',
    'true' FROM assessed WHERE onboarding_result = 'fail'
  UNION ALL SELECT candidate_id, 8, 'equipment', 'equipment_mismatch', 'blocker',
    current_equipment, load_equipment FROM assessed WHERE equipment_result = 'fail'
  UNION ALL SELECT candidate_id, 9, 'equipment',
    CASE WHEN equipment_conflict THEN 'equipment_conflicting' ELSE 'equipment_unknown' END,
    'review', NULL, NULL FROM assessed WHERE equipment_result = 'unknown'
  UNION ALL SELECT candidate_id, 10, 'availability',
    CASE WHEN availability_result = 'fail' THEN 'carrier_unavailable'
      WHEN availability_conflict THEN 'availability_conflicting'
      WHEN current_availability = 'conditional' THEN 'availability_conditional'
      ELSE 'availability_unknown' END,
    CASE WHEN availability_result = 'fail' THEN 'blocker' ELSE 'review' END, NULL, NULL
  FROM assessed WHERE availability_result <> 'pass'
  UNION ALL SELECT candidate_id, 11, 'quote',
    CASE WHEN quote_conflict THEN 'quote_ambiguous' ELSE 'quote_missing' END,
    CASE WHEN quote_conflict THEN 'warning' ELSE 'information' END, NULL, NULL
  FROM assessed WHERE quote_conflict OR quote_id IS NULL
), shown AS (
  SELECT candidate_id, string_agg(code, ',' ORDER BY ord) AS open_reasons FROM raised
  WHERE severity IN ('blocker', 'review') GROUP BY candidate_id)
"""

PRICED = f""", priced AS (
  SELECT a.*, q.amount_cents, q.rate_basis, q.quote_type,
    CASE WHEN q.currency <> 'USD' THEN NULL WHEN q.rate_basis = 'all_in' THEN q.amount_cents
      WHEN q.rate_basis = 'per_mile' AND a.distance_miles > 0
      THEN q.amount_cents * a.distance_miles END AS all_in,
    CASE WHEN q.currency <> 'USD' THEN NULL WHEN q.rate_basis = 'per_mile' THEN q.amount_cents
      WHEN q.rate_basis = 'all_in' AND a.distance_miles > 0
      THEN {half_up('q.amount_cents', 'a.distance_miles')} END AS per_mile
  FROM assessed a LEFT JOIN quotes q USING (quote_id))
"""
