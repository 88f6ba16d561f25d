"""Queries: boards, directories, histories, searches, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions import text
from brokerlake.operators import boards, candidates as cand, dq, jobs as life
from brokerlake.plans import q_rates
from brokerlake.plans.oracles import MARKET
from brokerlake.plans.registry import joined, query
from brokerlake.plans.tables import Tables, as_cents

AS_OF = "1998-06-15"


def as_of():
    return F.lit(AS_OF).cast("date")


@query("join_lookup", """
SELECT i.inquiry_id, l.status, l.origin_state, c.company_name FROM inquiries i
LEFT JOIN loads l USING (load_id) LEFT JOIN carriers c ON c.carrier_id = i.carrier_id""",
       ("inquiries", "loads", "carriers"))
def join_lookup(t: Tables) -> DataFrame:
    return (
        t.inquiries.select("inquiry_id", "load_id", "carrier_id")
        .join(t.loads.select("load_id", "status", "origin_state"), "load_id", "left")
        .join(t.carriers.select("carrier_id", "company_name"), "carrier_id", "left")
        .drop("load_id", "carrier_id")
    )


@query("load_status_counts", "SELECT status, count(*) AS n FROM loads GROUP BY 1", ("loads",))
def load_status_counts(t: Tables) -> DataFrame:
    return boards.load_status_counts(t.loads)


@query("loads_board", """
SELECT l.load_id, l.status, cast(l.pickup_date AS varchar) AS pickup_date,
  CASE status WHEN 'open' THEN 0 WHEN 'covered' THEN 1 WHEN 'delivered' THEN 2 ELSE 3 END
    AS status_rank,
  (SELECT count(*) FROM inquiries i WHERE i.load_id = l.load_id) AS inquiry_count
FROM loads l""", ("loads", "inquiries"))
def loads_board(t: Tables) -> DataFrame:
    return boards.loads_board(t.loads, t.inquiries).select(
        "load_id", "status", F.col("pickup_date").cast("string"), "status_rank", "inquiry_count"
    )


@query("open_loads_board", MARKET + f"""
SELECT b.load_id, b.pm_cents, coalesce(n.n, 0) AS inquiry_count,
  CASE WHEN b.pickup_date < DATE '{AS_OF}' THEN 'Pickup passed'
    WHEN band_position IS NULL THEN 'Insufficient history'
    WHEN band_position = 'below_minimum' THEN 'Below market min'
    WHEN band_position = 'above_maximum' THEN 'Above market max' ELSE 'In market band' END
    AS band_label
FROM banded b LEFT JOIN (SELECT load_id, count(*) AS n FROM inquiries GROUP BY 1) n USING (load_id)
WHERE b.status = 'open'""", ("loads", "market_rates", "inquiries"))
def open_loads_board(t: Tables) -> DataFrame:
    return boards.open_loads_board(q_rates.context(t), t.inquiries, as_of()).select(
        "load_id", as_cents(F.col("offered_per_mile")).alias("pm_cents"), "inquiry_count",
        "band_label",
    )


# -- inbox ------------------------------------------------------------------------------------------

# emails and calls as events; their jobs and inquiries are derived from their numbers
_EVENTS = """, ev AS (
  SELECT event_id, 'email' AS channel, doc_id AS num, external_source_id, sender_email_raw,
    sender_name, subject, occurred_at, received_at FROM emails
  UNION ALL SELECT event_id || '/' || sequence, 'call', cast(transcript_id AS bigint) * 7 + sequence,
    'CV' || transcript_id || '-' || sequence, NULL, NULL, NULL, NULL, TIMESTAMP '2025-03-01 00:00:00'
  FROM segments
), ev_jobs AS (
  SELECT event_id, CASE num % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'
    WHEN 3 THEN 'needs_review' ELSE 'failed' END AS status FROM ev WHERE num % 17 <> 0
), ev_inq AS (
  SELECT event_id || '#1' AS inquiry_id, event_id, 1 AS sequence_number, 'rate_quote'
    AS primary_intent, CASE WHEN num % 2 = 0 THEN 'needs_review' ELSE 'unreviewed' END
    AS review_status, cast(num % 100 AS varchar) AS carrier_id, cast(num AS varchar) AS load_id
  FROM ev WHERE num % 6 <> 0
  UNION ALL SELECT event_id || '#2', event_id, 2, 'decline', 'needs_review', NULL, NULL FROM ev
  WHERE num % 4 = 3
), opened AS (
  SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.event_id ORDER BY
    CASE WHEN j.status = 'needs_review' AND i.review_status = 'needs_review' THEN 0 ELSE 1 END,
    sequence_number) AS n FROM ev_inq i LEFT JOIN ev_jobs j USING (event_id)) WHERE n = 1)
"""
_EVENT_ROLES = ("emails", "segments", "carriers")


def event_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    none = lambda name: F.lit(None).cast("string").alias(name)
    emails = t.emails.select(
        "event_id", F.lit("email").alias("channel"), F.col("doc_id").alias("num"),
        "external_source_id", "sender_email_raw", "sender_name", "subject", "occurred_at",
        "received_at",
    )
    calls = t.segments.select(
        F.concat_ws("/", "event_id", "sequence").alias("event_id"), F.lit("call").alias("channel"),
        (F.col("transcript_id").cast("bigint") * 7 + F.col("sequence")).alias("num"),
        F.concat(F.lit("CV"), "transcript_id", F.lit("-"), "sequence").alias("external_source_id"),
        none("sender_email_raw"), none("sender_name"), none("subject"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.lit("2025-03-01").cast("timestamp").alias("received_at"),
    )
    events = emails.unionByName(calls)
    num = F.col("num")
    jobs = events.where("num % 17 <> 0").select(
        "event_id", F.element_at(F.array(*[F.lit(s) for s in vocab.JOB_STATUS]),
                                 (num % 5 + 1).cast("int")).alias("status"),
    )
    first = events.where("num % 6 <> 0").select(
        F.concat("event_id", F.lit("#1")).alias("inquiry_id"), "event_id",
        F.lit(1).alias("sequence_number"), F.lit("rate_quote").alias("primary_intent"),
        F.when(num % 2 == 0, "needs_review").otherwise("unreviewed").alias("review_status"),
        (num % 100).cast("string").alias("carrier_id"), num.cast("string").alias("load_id"),
    )
    second = events.where("num % 4 = 3").select(
        F.concat("event_id", F.lit("#2")).alias("inquiry_id"), "event_id",
        F.lit(2).alias("sequence_number"), F.lit("decline").alias("primary_intent"),
        F.lit("needs_review").alias("review_status"), none("carrier_id"), none("load_id"),
    )
    return events, jobs, first.unionByName(second)


@query("inbox", _EVENTS + """, named AS (
  SELECT DISTINCT i.event_id FROM ev_inq i LEFT JOIN carriers c ON c.carrier_id = i.carrier_id
  WHERE contains(upper(c.company_name), 'RING') OR contains(upper(i.load_id), 'RING'))
SELECT e.event_id, j.status AS job_status, o.inquiry_id,
  CASE o.primary_intent WHEN 'rate_quote' THEN 'Rate inquiry' WHEN 'decline' THEN 'Decline' END
    AS intent_label,
  epoch_us(coalesce(e.occurred_at, e.received_at)) AS when_us, e.occurred_at IS NULL
    AS when_is_fallback,
  coalesce(j.status IN ('needs_review', 'failed'), false) AS attention
FROM ev e LEFT JOIN ev_jobs j USING (event_id) LEFT JOIN opened o USING (event_id)
WHERE contains(upper(coalesce(e.sender_email_raw, '')), 'RING')
  OR contains(upper(coalesce(e.sender_name, '')), 'RING')
  OR contains(upper(coalesce(e.subject, '')), 'RING')
  OR contains(upper(coalesce(e.external_source_id, '')), 'RING')
  OR e.event_id IN (SELECT event_id FROM named)""", _EVENT_ROLES)
def inbox(t: Tables) -> DataFrame:
    events, jobs, inquiries = event_tables(t)
    rows = boards.inbox(events, jobs, inquiries, t.carriers, query="ring")
    return rows.select(
        "event_id", "job_status", "inquiry_id", "intent_label",
        F.unix_micros("when_at").alias("when_us"), "when_is_fallback", "attention",
    )


@query("inbox_inquiry_pick", _EVENTS + """
SELECT event_id, inquiry_id, primary_intent FROM opened""", _EVENT_ROLES)
def inbox_inquiry_pick(t: Tables) -> DataFrame:
    _, jobs, inquiries = event_tables(t)
    return boards.pick_inquiry(jobs, inquiries)


@query("job_review_rollup", _EVENTS + """
SELECT j.event_id, j.status, CASE WHEN j.status NOT IN ('completed', 'needs_review') THEN j.status
  WHEN EXISTS (SELECT 1 FROM ev_inq i WHERE i.event_id = j.event_id
    AND i.review_status = 'needs_review') THEN 'needs_review' ELSE 'completed' END AS rolled_status
FROM ev_jobs j""", _EVENT_ROLES)
def job_review_rollup(t: Tables) -> DataFrame:
    _, jobs, inquiries = event_tables(t)
    return life.job_review_rollup(jobs, inquiries)


@query("inquiry_detail", """, a AS (
  SELECT inquiry_id, unnest(['explicit', CASE WHEN equipment_code IS NULL THEN 'missing'
    ELSE 'inferred' END]) AS s FROM inquiries
), q AS (
  SELECT inquiry_id, count(*) AS n, count(*) FILTER (WHERE is_current) AS c FROM quotes GROUP BY 1
), s AS (SELECT event_id, count(*) - 1 AS n FROM inquiries GROUP BY 1)
SELECT i.inquiry_id, i.event_id, i.sequence_number, i.primary_intent, cast(1 AS bigint)
  AS explicit_fields, cast(equipment_code IS NOT NULL AS bigint) AS inferred_fields,
  cast(equipment_code IS NULL AS bigint) AS missing_fields, coalesce(q.n, 0) AS quote_count,
  coalesce(q.c, 0) AS current_quotes,
  cast(review_status = 'needs_review' AS bigint) AS pending_reasons,
  cast(primary_intent = 'decline' AS bigint) AS warning_reasons,
  cast(review_status = 'approved' AS bigint) AS resolved_reasons, s.n AS sibling_count
FROM inquiries i LEFT JOIN q USING (inquiry_id) JOIN s USING (event_id)""", ("inquiries", "quotes"))
def inquiry_detail(t: Tables) -> DataFrame:
    inquiries = t.inquiries
    fields = inquiries.select(
        "inquiry_id",
        F.explode(
            F.array(
                F.lit("explicit"),
                F.when(F.col("equipment_code").isNull(), "missing").otherwise("inferred"),
            )
        ).alias("evidence_status"),
    )
    status = F.col("review_status")
    raised = F.filter(
        F.array(
            F.when(status == "needs_review", F.struct(F.lit("review").alias("severity"),
                                                      F.lit(None).cast("int").alias("resolved_at"))),
            F.when(status == "approved", F.struct(F.lit("review").alias("severity"),
                                                  F.lit(1).alias("resolved_at"))),
            F.when(F.col("primary_intent") == "decline",
                   F.struct(F.lit("informational").alias("severity"),
                            F.lit(None).cast("int").alias("resolved_at"))),
        ),
        lambda r: r.isNotNull(),
    )
    reasons = inquiries.select("inquiry_id", F.inline(raised))
    return boards.inquiry_detail(inquiries, fields, t.quotes, reasons)


# -- carriers -----------------------------------------------------------------------------------------


def directory(t: Tables) -> DataFrame:
    return t.carriers.withColumn(
        "mc_number_normalized", text.digits(F.col("mc_number_raw"))
    ).withColumn("dot_number_normalized", text.digits(F.col("dot_number_raw")))


_READ = f""", read AS (
  SELECT *, CASE WHEN authority_status = 'ACTIVE' THEN 'pass'
      WHEN authority_status IN ('INACTIVE', 'REVOKED', 'SUSPENDED') THEN 'fail'
      ELSE 'unknown' END AS a,
    CASE WHEN safety_rating = 'Satisfactory' THEN 'pass'
      WHEN safety_rating = 'Unsatisfactory' THEN 'fail' ELSE 'unknown' END AS s,
    CASE WHEN insurance_expiry IS NULL THEN 'unknown'
      WHEN insurance_expiry >= DATE '{AS_OF}' THEN 'pass' ELSE 'fail' END AS i FROM carriers)
"""


@query("carrier_directory", _READ + """
SELECT r.carrier_id, company_name, CASE WHEN 'fail' IN (a, s, i) THEN 'Compliance issue'
    WHEN 'unknown' IN (a, s, i) THEN 'Needs review' ELSE 'Compliant' END AS compliance_label,
  CASE WHEN onboarded IS NULL THEN 'Onboarding unknown' WHEN onboarded THEN 'Onboarded'
    ELSE 'Not onboarded' END AS onboarding_label,
  (SELECT count(*) FROM inquiries q WHERE q.carrier_id = r.carrier_id) AS inquiry_count,
  (SELECT count(DISTINCT load_id) FROM inquiries q WHERE q.carrier_id = r.carrier_id)
    AS candidacy_count
FROM read r""", ("carriers", "inquiries"))
def carrier_directory(t: Tables) -> DataFrame:
    candidates = cand.candidate_build(t.inquiries)
    return boards.carrier_directory(directory(t), t.inquiries, candidates, as_of())


@query("carrier_profile", _READ + """
SELECT r.carrier_id, company_name, a AS authority_result, s AS safety_result,
  CASE i WHEN 'pass' THEN 'valid' WHEN 'fail' THEN 'expired' ELSE 'unknown' END
    AS insurance_verdict,
  CASE WHEN onboarded IS NULL THEN 'unknown' WHEN onboarded THEN 'complete' ELSE 'required' END
    AS onboarding_verdict,
  array_to_string([x FOR x IN [CASE WHEN mc_number_raw IS NULL THEN 'mc_number' END,
    CASE WHEN dot_number_raw IS NULL THEN 'dot_number' END,
    CASE WHEN insurance_expiry IS NULL THEN 'insurance_expiry' END,
    CASE WHEN a = 'unknown' THEN 'authority_status' END,
    CASE WHEN s = 'unknown' THEN 'safety_rating' END,
    CASE WHEN onboarded IS NULL THEN 'onboarding' END,
    CASE WHEN company_name IS NULL THEN 'company_name' END] IF x IS NOT NULL], ',') AS gaps,
  k.contact_id
FROM read r LEFT JOIN carrier_contacts k ON k.carrier_id = r.carrier_id""",
       ("carriers", "carrier_contacts"))
def carrier_profile(t: Tables) -> DataFrame:
    return boards.carrier_profile(directory(t), t.carrier_contacts, as_of()).withColumn(
        "gaps", joined("gaps")
    )


@query("carrier_facts", """
SELECT carrier_id, company_name, mc_number_raw AS mc_number, dot_number_raw AS dot_number,
  authority_status, safety_rating, cast(insurance_expiry AS varchar) AS insurance_expiry, onboarded,
  reliability_tenths, loads_completed, response_hundredths FROM carriers""", ("carriers",))
def carrier_facts(t: Tables) -> DataFrame:
    return boards.carrier_facts(t.carriers).withColumn(
        "insurance_expiry", F.col("insurance_expiry").cast("string")
    ).withColumn(
        "reliability_tenths", (F.col("reliability_score") * 10).cast("bigint")
    ).withColumn(
        "response_hundredths", as_cents(F.col("avg_response_time_hours"))
    ).drop("reliability_score", "avg_response_time_hours")


# -- histories ------------------------------------------------------------------------------------------


@query("load_timeline", """
SELECT load_id, inquiry_id, epoch_us(occurred_at) AS occurred_us, epoch_us(received_at)
  AS received_us FROM inquiries WHERE load_id IS NOT NULL""", ("inquiries",))
def load_timeline(t: Tables) -> DataFrame:
    return boards.load_timeline(t.inquiries).select(
        "load_id", "inquiry_id", F.unix_micros("occurred_at").alias("occurred_us"),
        F.unix_micros("received_at").alias("received_us"),
    )


@query("load_unmatched", """
SELECT load_id, inquiry_id, epoch_us(created_at) AS created_us FROM inquiries
WHERE load_id IS NOT NULL AND carrier_id IS NULL""", ("inquiries",))
def load_unmatched(t: Tables) -> DataFrame:
    return boards.load_unmatched(t.inquiries).select(
        "load_id", "inquiry_id", F.unix_micros("created_at").alias("created_us")
    )


def _newest(key: str, limit: int) -> str:
    return f""", newest AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY created_at DESC, inquiry_id) AS place
  FROM inquiries WHERE {key} IS NOT NULL AND review_status <> 'rejected' QUALIFY place <= {limit})
"""


@query("carrier_history", _newest("carrier_id", 15) + """
SELECT carrier_id, inquiry_id, load_id, place FROM newest""", ("inquiries",))
def carrier_history(t: Tables) -> DataFrame:
    return boards.carrier_history(t.inquiries).select(
        "carrier_id", "inquiry_id", "load_id", "place"
    ).withColumn("place", F.col("place").cast("bigint"))


@query("load_inquiries", _newest("load_id", 10) + """, c AS (
  SELECT inquiry_id, min(quote_id) AS quote_id FROM quotes WHERE is_current GROUP BY 1)
SELECT n.load_id, n.inquiry_id, n.place, c.quote_id FROM newest n LEFT JOIN c USING (inquiry_id)""",
       ("inquiries", "quotes"))
def load_inquiries(t: Tables) -> DataFrame:
    return boards.load_inquiries(t.inquiries, t.quotes).select(
        "load_id", "inquiry_id", F.col("place").cast("bigint"),
        F.col("current_quote.quote_id").alias("quote_id"),
    )


@query("search_inquiries", """
SELECT i.inquiry_id, c.company_name, i.summary FROM inquiries i
LEFT JOIN carriers c ON c.carrier_id = i.carrier_id
WHERE review_status <> 'rejected' AND (contains(upper(summary), 'TRUCK A FOR 5')
  OR contains(upper(coalesce(company_name, '')), 'TRUCK A FOR 5')
  OR contains(upper(coalesce(load_id, '')), 'TRUCK A FOR 5')
  OR contains(upper(primary_intent), 'TRUCK A FOR 5'))
ORDER BY created_at DESC, inquiry_id LIMIT 10""", ("inquiries", "carriers"))
def search_inquiries(t: Tables) -> DataFrame:
    return boards.search_inquiries(t.inquiries, t.carriers, "Truck a FOR 5").select(
        "inquiry_id", "company_name", "summary"
    )


# -- rules ----------------------------------------------------------------------------------------------

_KEYED = """(SELECT count(*) FROM (SELECT 1 FROM {table} WHERE {where} GROUP BY {keys}
  HAVING count(*) > 1))"""


def _keyed(table: str, keys: str, where: str = "true") -> str:
    return _KEYED.format(table=table, keys=keys, where=where)


_RULES = {
    ("load", "load_external_id"): _keyed("loads", "snapshot_id, load_id"),
    ("load", "distance_positive"): "(SELECT count(*) FROM loads WHERE distance_miles <= 0)",
    ("load", "weight_non_negative"): "(SELECT count(*) FROM loads WHERE weight_lbs < 0)",
    ("load", "rate_non_negative"): "(SELECT count(*) FROM loads WHERE offered_cents < 0)",
    ("carrier", "carrier_source_id"): _keyed("carriers", "snapshot_id, carrier_id"),
    ("carrier", "carrier_mc"): _keyed("carriers", "mc_number_raw", "mc_number_raw IS NOT NULL"),
    ("carrier", "carrier_dot"): _keyed("carriers", "dot_number_raw", "dot_number_raw IS NOT NULL"),
    ("carrier", "reliability_scale"):
        "(SELECT count(*) FROM carriers WHERE reliability_tenths > 50)",
    ("carrier", "loads_completed_non_negative"):
        "(SELECT count(*) FROM carriers WHERE loads_completed < 0)",
    ("carrier_contact", "one_primary_contact"):
        _keyed("carrier_contacts", "carrier_id", "is_primary"),
    ("market_rate_history", "market_week"): _keyed(
        "market_rates", "week_start, origin_state, destination_state, equipment_code"),
    ("market_rate_history", "band_ordering"):
        "(SELECT count(*) FROM market_rates WHERE min_cents > avg_cents OR avg_cents > max_cents)",
    ("market_rate_history", "volume_non_negative"): "0",
    ("ingestion_job", "one_job_per_event"): _keyed("jobs", "event_id"),
    ("ingestion_job", "job_status_vocab"): "0",
    ("transcript_segment", "segment_sequence"): _keyed("segments", "transcript_id, sequence"),
    ("inquiry", "inquiry_sequence"): _keyed("inquiries", "event_id, sequence_number"),
    ("inquiry", "review_status_vocab"): "0",
    ("carrier_quote", "amount_non_negative"): "0",
    ("ai_provider_call", "call_sequence"): _keyed("provider_calls", "operation_id, sequence"),
    ("carrier_contact", "carrier_contact_carrier_id_fk"): "0",
    ("inquiry", "inquiry_load_id_fk"): "(SELECT count(*) FROM inquiries WHERE load_id IS NOT NULL"
        " AND load_id NOT IN (SELECT load_id FROM loads))",
    ("inquiry", "inquiry_carrier_id_fk"): "(SELECT count(*) FROM inquiries WHERE carrier_id IS NOT"
        " NULL AND carrier_id NOT IN (SELECT carrier_id FROM carriers))",
    ("carrier_quote", "carrier_quote_inquiry_id_fk"): "(SELECT count(*) FROM quotes WHERE inquiry_id"
        " NOT IN (SELECT inquiry_id FROM inquiries))",
    ("assistant_message", "message_sequence"): _keyed("messages", "conversation_id, sequence"),
}


@query("dq_constraints", "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, '{rule}' AS rule, cast({sql} AS bigint) AS violations"
    for (table, rule), sql in _RULES.items()
), ("loads", "carriers", "carrier_contacts", "market_rates", "jobs", "segments", "inquiries",
    "quotes", "provider_calls", "messages"))
def dq_constraints(t: Tables) -> DataFrame:
    return dq.violations({
        "load": t.loads, "carrier": directory(t), "carrier_contact": t.carrier_contacts,
        "market_rate_history": t.market_rates, "ingestion_job": t.jobs,
        "transcript_segment": t.segments, "inquiry": t.inquiries, "carrier_quote": t.quotes,
        "ai_provider_call": t.provider_calls, "assistant_message": t.messages,
    })


# (table, column): its role, the target's role and column
_REFERENCES = {
    ("ai_provider_call", "operation_id"): ("provider_calls", "ai_operations", "operation_id"),
    ("extraction_run", "event_id"): ("extractions", "emails", "event_id"),
    ("inquiry", "event_id"): ("inquiries", "emails", "event_id"),
    ("inquiry_review_action", "inquiry_id"): ("review_actions", "inquiries", "inquiry_id"),
    ("inquiry_load_match", "load_id"): ("review_inquiries", "loads", "load_id"),
    ("inquiry_load_match", "inquiry_id"): ("review_inquiries", "inquiries", "inquiry_id"),
    ("inquiry_carrier_match", "carrier_id"): ("review_inquiries", "carriers", "carrier_id"),
    ("inquiry_carrier_match", "inquiry_id"): ("review_inquiries", "inquiries", "inquiry_id"),
}


@query("dq_references", "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, '{table}_{column}_fk' AS rule, (SELECT count(*) FROM {role} s"
    f" WHERE s.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {target} k"
    f" WHERE k.{key} = s.{column})) AS violations"
    for (table, column), (role, target, key) in _REFERENCES.items()
), ("provider_calls", "ai_operations", "extractions", "emails", "inquiries", "review_actions",
    "review_inquiries", "loads", "carriers"))
def dq_references(t: Tables) -> DataFrame:
    return dq.violations({
        "ai_provider_call": t.provider_calls, "ai_operation": t.operations,
        "extraction_run": t.extractions, "communication_event": t.emails, "inquiry": t.inquiries,
        "inquiry_review_action": t.review_actions, "inquiry_load_match": t.review_inquiries,
        "inquiry_carrier_match": t.review_inquiries, "load": t.loads, "carrier": t.carriers,
    }, tuple(r for r in dq.REFERENCES if (r.table, r.columns[0]) in _REFERENCES))
