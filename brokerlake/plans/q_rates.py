"""Queries: rate intelligence, candidates, policy, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions import money
from brokerlake.operators import boards, candidates as cand, rates
from brokerlake.plans.oracles import (
    ASSESSED, FACTS, MARKET, POLICY, PRICED, REASONS, band, half_up, latest,
)
from brokerlake.plans.registry import joined, query
from brokerlake.plans.tables import Tables, as_cents
from brokerlake.scale import stored

_MARKET_ROLES = ("loads", "market_rates")
_FACT_ROLES = ("loads", "carriers", "inquiries", "quotes")
_ALL = ("loads", "market_rates", "carriers", "inquiries", "quotes")
day = lambda c: F.col(c).cast("string").alias(c)


def context(t: Tables, loads: DataFrame | None = None) -> DataFrame:
    """The bound loads are derived once: their days and they themselves are read."""
    return rates.market_context(stored(t.loads, "loads") if loads is None else loads, t.market_rates)


def facts(t: Tables) -> DataFrame:
    return cand.current_facts(t.inquiries, t.quotes)


def assessed(t: Tables, loads: DataFrame | None = None) -> DataFrame:
    return cand.assess(t.inquiries, t.quotes, t.carriers, t.loads if loads is None else loads)


def linked(t: Tables) -> DataFrame:
    return t.inquiries.where("load_id IS NOT NULL AND carrier_id IS NOT NULL")


def priced(t: Tables, loads: DataFrame | None = None) -> DataFrame:
    return cand.with_comparable_quote(assessed(t, loads))


def quoted(t: Tables, loads: DataFrame | None = None) -> DataFrame:
    """``priced`` for best rates, which ask of a status only whether it is eligible."""
    loads = t.loads if loads is None else loads
    return cand.with_comparable_quote(cand.assess_quoted(t.inquiries, t.quotes, t.carriers, loads))


@query("market_context", MARKET + """
SELECT load_id, cast(week_start AS varchar) AS week_start, min_cents, avg_cents, max_cents,
  pm_cents, band_position FROM banded""", _MARKET_ROLES)
def market_context(t: Tables) -> DataFrame:
    return context(t).select(
        "load_id", day("week_start"), as_cents(F.col("minimum_rate_per_mile")).alias("min_cents"),
        as_cents(F.col("average_rate_per_mile")).alias("avg_cents"),
        as_cents(F.col("maximum_rate_per_mile")).alias("max_cents"),
        as_cents(F.col("offered_per_mile")).alias("pm_cents"), "band_position",
    )


@query("fn_offered_per_mile", f"""
SELECT load_id, CASE WHEN distance_miles > 0
  THEN {half_up('offered_cents', 'distance_miles')} END AS pm_cents FROM loads""", ("loads",))
def fn_offered_per_mile(t: Tables) -> DataFrame:
    return rates.with_offered_per_mile(t.loads).select(
        "load_id", as_cents(F.col("offered_per_mile")).alias("pm_cents")
    )


def _quotes_on_loads(t: Tables) -> DataFrame:
    return t.quotes.join(t.inquiries.select("inquiry_id", "load_id"), "inquiry_id").join(
        t.loads.select("load_id", "distance_miles"), "load_id"
    )


_QUOTED = """, quoted AS (
  SELECT q.*, l.distance_miles FROM quotes q JOIN inquiries i USING (inquiry_id)
  JOIN loads l USING (load_id))"""
_QUOTED_ROLES = ("quotes", "inquiries", "loads")


@query("fn_quote_all_in", _QUOTED + """
SELECT quote_id, CASE WHEN rate_basis = 'all_in' THEN amount_cents
  WHEN rate_basis = 'per_mile' AND distance_miles > 0 THEN amount_cents * distance_miles END
  AS all_in_cents FROM quoted""", _QUOTED_ROLES)
def fn_quote_all_in(t: Tables) -> DataFrame:
    value = money.quote_as_all_in(F.col("amount"), F.col("rate_basis"), F.col("distance_miles"))
    return _quotes_on_loads(t).select("quote_id", as_cents(value).alias("all_in_cents"))


@query("fn_quote_per_mile", _QUOTED + f"""
SELECT quote_id, CASE WHEN rate_basis = 'per_mile' THEN amount_cents
  WHEN rate_basis = 'all_in' AND distance_miles > 0
  THEN {half_up('amount_cents', 'distance_miles')} END AS per_mile_cents FROM quoted""",
       _QUOTED_ROLES)
def fn_quote_per_mile(t: Tables) -> DataFrame:
    value = money.quote_as_per_mile(F.col("amount"), F.col("rate_basis"), F.col("distance_miles"))
    return _quotes_on_loads(t).select("quote_id", as_cents(value).alias("per_mile_cents"))


@query("fn_band_position", MARKET + """
SELECT band_position, count(*) AS loads FROM banded GROUP BY 1""", _MARKET_ROLES)
def fn_band_position(t: Tables) -> DataFrame:
    return context(t).groupBy("band_position").agg(F.count("*").alias("loads"))


_PM = (f"CASE WHEN q.rate_basis = 'per_mile' THEN q.amount_cents WHEN q.rate_basis = 'all_in' AND"
       f" b.distance_miles > 0 THEN {half_up('q.amount_cents', 'b.distance_miles')} END")


@query("quote_vs_market", MARKET + f""", priced AS (
  SELECT q.quote_id, b.min_cents, b.max_cents, {_PM} AS quote_pm_cents
  FROM quotes q JOIN inquiries i USING (inquiry_id) JOIN banded b USING (load_id))
SELECT quote_id, quote_pm_cents, {band('quote_pm_cents', 'min_cents', 'max_cents')} AS quote_band
FROM priced""", ("loads", "market_rates", "inquiries", "quotes"))
def quote_vs_market(t: Tables) -> DataFrame:
    return rates.quote_vs_market(t.quotes, t.inquiries, context(t)).select(
        "quote_id", as_cents(F.col("quote_per_mile")).alias("quote_pm_cents"), "quote_band"
    )


@query("candidate_build", """
SELECT load_id, carrier_id, epoch_us(min(coalesce(occurred_at, received_at))) AS first_seen_us,
  epoch_us(max(coalesce(occurred_at, received_at))) AS last_activity_us,
  count(*) AS inquiry_count
FROM inquiries WHERE load_id IS NOT NULL AND carrier_id IS NOT NULL GROUP BY 1, 2""",
       ("inquiries",))
def candidate_build(t: Tables) -> DataFrame:
    return cand.candidate_build(t.inquiries).select(
        "load_id", "carrier_id", F.unix_micros("first_seen_at").alias("first_seen_us"),
        F.unix_micros("last_activity_at").alias("last_activity_us"), "inquiry_count",
    )


@query("latest_explicit", latest("x", "inquiries", "load_id", "occurred_at", "equipment_code") + """
, every AS (SELECT DISTINCT load_id FROM inquiries)
SELECT e.load_id, x.value AS equipment_code, coalesce(x.conflict, false) AS conflict
FROM every e LEFT JOIN x ON e.load_id = x.k WHERE e.load_id IS NOT NULL""", ("inquiries",))
def latest_explicit(t: Tables) -> DataFrame:
    rows = t.inquiries.where("load_id IS NOT NULL")
    return cand.latest_explicit(rows, ["load_id"], "occurred_at", "equipment_code")


@query("current_facts", FACTS + """
SELECT candidate_id, identity_verified, current_availability, availability_conflict,
  current_equipment, equipment_conflict, quote_id, quote_conflict FROM facts""",
       ("inquiries", "quotes"))
def current_facts(t: Tables) -> DataFrame:
    return facts(t).select(
        "candidate_id", "identity_verified", "current_availability", "availability_conflict",
        "current_equipment", "equipment_conflict",
        F.col("current_quote.quote_id").alias("quote_id"), "quote_conflict",
    )


@query("policy_compliance", FACTS + POLICY + f"""
SELECT candidate_id, authority_result, safety_result, insurance_result, compliance_result,
  '{vocab.POLICY_VERSION}' AS policy_version FROM complied""", _FACT_ROLES)
def policy_compliance(t: Tables) -> DataFrame:
    pairs = cand.candidate_build(t.inquiries).select(
        cand.candidate_id().alias("candidate_id"), *cand.CANDIDATE
    )
    rows = pairs.join(
        t.carriers.select("carrier_id", "authority_status", "safety_rating", "insurance_expiry"),
        "carrier_id",
    ).join(t.loads.select("load_id", "pickup_date"), "load_id")
    return cand.policy_compliance(rows).select(
        "candidate_id", "authority_result", "safety_result", "insurance_result",
        "compliance_result", "policy_version",
    )


@query("eligibility", ASSESSED + """
SELECT candidate_id, identity_result, equipment_result, availability_result, onboarding_result,
  compliance_result, final_status FROM assessed""", _FACT_ROLES)
def eligibility(t: Tables) -> DataFrame:
    return assessed(t).select(
        "candidate_id", "identity_result", "equipment_result", "availability_result",
        "onboarding_result", "compliance_result", "final_status",
    )


@query("assessment_reasons", ASSESSED + REASONS + """
SELECT candidate_id, component, code, severity, observed, required FROM raised""", _FACT_ROLES)
def assessment_reasons(t: Tables) -> DataFrame:
    return cand.assessment_reasons(assessed(t)).drop("load_id", "carrier_id")


@query("best_rates", ASSESSED + PRICED + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY all_in, candidate_id) AS n,
    row_number() OVER (PARTITION BY load_id, final_status = 'eligible'
      ORDER BY all_in, candidate_id) AS ne
  FROM priced WHERE all_in IS NOT NULL)
SELECT load_id, max(all_in) FILTER (WHERE n = 1) AS overall_cents,
  max(candidate_id) FILTER (WHERE n = 1) AS overall_candidate,
  max(per_mile) FILTER (WHERE n = 1) AS overall_per_mile,
  max(all_in) FILTER (WHERE ne = 1 AND final_status = 'eligible') AS eligible_cents,
  max(candidate_id) FILTER (WHERE ne = 1 AND final_status = 'eligible') AS eligible_candidate
FROM ranked GROUP BY load_id""", _FACT_ROLES)
def best_rates(t: Tables) -> DataFrame:
    best = rates.best_rates(quoted(t))
    return best.select(
        "load_id", as_cents(F.col("lowest_overall.all_in")).alias("overall_cents"),
        F.col("lowest_overall.candidate_id").alias("overall_candidate"),
        as_cents(F.col("lowest_overall.per_mile")).alias("overall_per_mile"),
        as_cents(F.col("lowest_eligible.all_in")).alias("eligible_cents"),
        F.col("lowest_eligible.candidate_id").alias("eligible_candidate"),
    )


_STRENGTH = ("all_in IS NULL, all_in, reliability_tenths IS NULL, reliability_tenths DESC,"
             " loads_completed IS NULL, loads_completed DESC, response_hundredths IS NULL,"
             " response_hundredths, carrier_id")


@query("strongest_candidates", ASSESSED + PRICED + f"""
SELECT load_id, carrier_id, all_in AS all_in_cents,
  row_number() OVER (PARTITION BY load_id ORDER BY {_STRENGTH}) AS position
FROM priced WHERE final_status = 'eligible'""", _FACT_ROLES)
def strongest_candidates(t: Tables) -> DataFrame:
    return cand.strongest_candidates(priced(t), linked(t)).select(
        "load_id", "carrier_id", as_cents(F.col("all_in")).alias("all_in_cents"), "position"
    )


@query("workspace_candidates", ASSESSED + PRICED + REASONS + f""", strong AS (
  SELECT candidate_id, row_number() OVER (PARTITION BY load_id ORDER BY {_STRENGTH}) AS s
  FROM priced WHERE final_status = 'eligible'
), last_heard AS (
  SELECT candidate_id, inquiry_id AS latest_inquiry_id, row_number() OVER (
    PARTITION BY candidate_id ORDER BY coalesce(occurred_at, received_at, created_at) DESC,
    inquiry_id DESC) AS r FROM linked)
SELECT p.load_id, p.carrier_id, p.final_status, coalesce(s.open_reasons, '') AS open_reasons,
  h.latest_inquiry_id, row_number() OVER (PARTITION BY p.load_id ORDER BY
    CASE p.final_status WHEN 'eligible' THEN 0 WHEN 'needs_clarification' THEN 1
      WHEN 'needs_compliance_review' THEN 2 WHEN 'needs_onboarding' THEN 3
      WHEN 'blocked' THEN 4 ELSE 5 END,
    coalesce(t.s, 1000000), p.quote_id IS NULL, p.carrier_id) AS position
FROM priced p LEFT JOIN strong t USING (candidate_id) LEFT JOIN shown s USING (candidate_id)
LEFT JOIN last_heard h ON h.candidate_id = p.candidate_id AND h.r = 1""", _FACT_ROLES)
def workspace_candidates(t: Tables) -> DataFrame:
    rows = cand.workspace_candidates(priced(t), linked(t))
    return rows.select(
        "load_id", "carrier_id", "final_status", joined("open_reasons").alias("open_reasons"),
        "latest_inquiry_id", "position",
    )


@query("carrier_candidacies", ASSESSED + REASONS + """
SELECT carrier_id, load_id, cast(pickup_date AS varchar) AS pickup_date, final_status,
  coalesce(open_reasons, '') AS open_reasons, quote_id
FROM assessed LEFT JOIN shown USING (candidate_id)""", _FACT_ROLES)
def carrier_candidacies(t: Tables) -> DataFrame:
    return boards.carrier_candidacies(assessed(t)).select(
        "carrier_id", "load_id", day("pickup_date"), "final_status",
        joined("open_reasons").alias("open_reasons"), "quote_id",
    )


@query("candidate_assessment", ASSESSED + REASONS + """, asked AS (
  SELECT DISTINCT load_id, cast(cast(carrier_id AS bigint) + 4 AS varchar) AS carrier_id
  FROM inquiries WHERE load_id IS NOT NULL AND carrier_id IS NOT NULL
  UNION SELECT load_id, carrier_id FROM inquiries
  WHERE load_id IS NOT NULL AND carrier_id IS NOT NULL
), counted AS (SELECT candidate_id, count(*) AS n FROM raised GROUP BY 1)
SELECT q.load_id, q.carrier_id, a.final_status, a.quote_id,
  CASE WHEN a.candidate_id IS NULL THEN NULL ELSE coalesce(s.open_reasons, '') END AS open_reasons,
  CASE WHEN a.candidate_id IS NULL THEN NULL ELSE coalesce(c.n, 0) END AS reason_count,
  CASE WHEN a.candidate_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome
FROM asked q LEFT JOIN assessed a ON a.load_id = q.load_id AND a.carrier_id = q.carrier_id
LEFT JOIN shown s ON s.candidate_id = a.candidate_id
LEFT JOIN counted c ON c.candidate_id = a.candidate_id""", _FACT_ROLES)
def candidate_assessment(t: Tables) -> DataFrame:
    shifted = (F.col("carrier_id").cast("bigint") + 4).cast("string")
    # dealt by load like the assessments, so that asking for them needs no further shuffle
    known = linked(t).select("load_id", "carrier_id").repartition("load_id").distinct()
    asked = known.select(
        "load_id", F.explode(F.array("carrier_id", shifted)).alias("carrier_id")
    ).distinct()
    return cand.candidate_assessment(asked, assessed(t)).withColumn(
        "open_reasons", joined("open_reasons")
    ).withColumn("reason_count", F.col("reason_count").cast("bigint"))


@query("assessment_history", ASSESSED + """
SELECT candidate_id, final_status FROM assessed
WHERE cast(load_id AS bigint) % 3 <> 0 OR final_status = 'blocked'""", _FACT_ROLES)
def assessment_history(t: Tables) -> DataFrame:
    """A third of the loads were assessed before; their blocked candidates have changed since."""
    now = assessed(t)
    old = now.where(F.col("load_id").cast("bigint") % 3 == 0).withColumn(
        "fact_hash",
        F.when(F.col("final_status") == "blocked", F.lit("stale")).otherwise(cand.fact_hash()),
    ).select("load_id", "carrier_id", "fact_hash", F.lit("2024-01-01").cast("timestamp").alias("evaluated_at"))
    added = cand.assessment_history(old, now, F.lit("2024-02-01").cast("timestamp"))
    return added.select("candidate_id", "final_status")


@query("load_facts", ASSESSED + PRICED + MARKET + """, best AS (
  SELECT load_id, min(all_in) AS lowest,
    min(all_in) FILTER (WHERE final_status = 'eligible') AS lowest_eligible
  FROM priced GROUP BY load_id)
SELECT b.load_id, b.status, coalesce(CASE b.equipment_code WHEN 'box_truck' THEN 'Box Truck'
    WHEN 'sprinter_van' THEN 'Sprinter Van' WHEN 'flatbed' THEN 'Flatbed'
    WHEN 'refrigerated' THEN 'Refrigerated' END, b.equipment_raw) AS equipment,
  nullif(b.distance_miles, 0) AS distance_miles, nullif(b.offered_cents, 0) AS offered_cents,
  nullif(b.pm_cents, 0) AS pm_cents, b.band_position, r.lowest AS lowest_overall_cents,
  r.lowest_eligible AS lowest_eligible_cents
FROM banded b LEFT JOIN best r USING (load_id)""", _ALL)
def load_facts(t: Tables) -> DataFrame:
    loads = stored(t.loads, "loads")
    rows = boards.load_facts(context(t, loads), rates.best_rates(quoted(t, loads)))
    return rows.select(
        "load_id", "status", "equipment", "distance_miles",
        as_cents(F.col("offered_rate_usd")).alias("offered_cents"),
        as_cents(F.col("offered_per_mile")).alias("pm_cents"),
        F.col("market_band_position").alias("band_position"),
        as_cents(F.col("lowest_overall_quote")).alias("lowest_overall_cents"),
        as_cents(F.col("lowest_eligible_quote")).alias("lowest_eligible_cents"),
    )


@query("dashboard_counts", ASSESSED + """
SELECT (SELECT count(*) FROM inquiries WHERE review_status = 'needs_review') AS review_count,
  (SELECT count(*) FROM assessed WHERE final_status IN ('blocked', 'needs_compliance_review'))
    AS compliance_warnings""", _FACT_ROLES)
def dashboard_counts(t: Tables) -> DataFrame:
    return boards.dashboard_counts(t.inquiries, assessed(t))


def draft_rows(t: Tables) -> DataFrame:
    return boards.draft_context(
        t.inquiries, t.carriers, t.carrier_contacts, t.quotes, context(t), words=False
    )


_DRAFT = MARKET + ASSESSED + REASONS + f""", current_quote AS (
  SELECT inquiry_id, min(quote_id) AS current_quote_id FROM quotes WHERE is_current GROUP BY 1
), contact AS (
  SELECT carrier_id, min(name) AS contact_name FROM carrier_contacts WHERE is_primary GROUP BY 1
), drafted AS (
  SELECT i.inquiry_id, b.load_id AS found_load, b.band_position, c.carrier_id AS found_carrier,
    c.company_name, k.contact_name, a.candidate_id, a.final_status,
    CASE WHEN a.candidate_id IS NOT NULL THEN coalesce(s.open_reasons, '') END AS open_reasons,
    q.current_quote_id, CASE WHEN x.rate_basis = 'per_mile' THEN x.amount_cents
      WHEN x.rate_basis = 'all_in' AND b.distance_miles > 0
      THEN {half_up('x.amount_cents', 'b.distance_miles')} END AS quote_pm_cents
  FROM inquiries i LEFT JOIN banded b ON b.load_id = i.load_id
  LEFT JOIN carriers c ON c.carrier_id = i.carrier_id
  LEFT JOIN contact k ON k.carrier_id = i.carrier_id
  LEFT JOIN assessed a ON a.load_id = i.load_id AND a.carrier_id = i.carrier_id
  LEFT JOIN shown s ON s.candidate_id = a.candidate_id
  LEFT JOIN current_quote q ON q.inquiry_id = i.inquiry_id
  LEFT JOIN quotes x ON x.quote_id = q.current_quote_id)
"""


@query("draft_context", _DRAFT + """
SELECT inquiry_id, found_load AS load_id, band_position, found_carrier AS carrier_id, company_name,
  contact_name, final_status, open_reasons, current_quote_id AS quote_id, quote_pm_cents
FROM drafted""", (*_ALL, "carrier_contacts"))
def draft_context(t: Tables) -> DataFrame:
    return draft_rows(t).select(
        "inquiry_id", F.col("load.load_id").alias("load_id"), "band_position",
        F.col("carrier.carrier_id").alias("carrier_id"),
        F.col("carrier.company_name").alias("company_name"),
        F.col("carrier.contact_name").alias("contact_name"),
        F.col("eligibility.final_status").alias("final_status"),
        joined("eligibility.reasons").alias("open_reasons"),
        F.col("quote.quote_id").alias("quote_id"),
        as_cents(F.col("quote_per_mile")).alias("quote_pm_cents"),
    )


@query("draft_evidence", _DRAFT + """
SELECT inquiry_id, 'load' AS fact, 'load' AS kind, 'load:' || found_load AS stable_id
FROM drafted WHERE found_load IS NOT NULL
UNION ALL SELECT inquiry_id, 'carrier', 'carrier', 'carrier:' || found_carrier FROM drafted
WHERE found_carrier IS NOT NULL
UNION ALL SELECT inquiry_id, 'current_quote', 'quote', 'quote:' || current_quote_id FROM drafted
WHERE current_quote_id IS NOT NULL
UNION ALL SELECT inquiry_id, 'eligibility_assessment', 'assessment', 'assessment:' || candidate_id
FROM drafted WHERE candidate_id IS NOT NULL""", (*_ALL, "carrier_contacts"))
def draft_evidence(t: Tables) -> DataFrame:
    return boards.draft_links(draft_rows(t))
