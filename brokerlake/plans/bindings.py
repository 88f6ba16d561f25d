"""Freight tables derived from the star-schema test tables, as SQL both engines accept.

Money is carried in integer cents here and turned into decimals by ``tables.py``; divisions
are floored doubles of small integers, which are exact in both engines.
"""

from __future__ import annotations

# role -> (roles it reads, SELECT text)
ROLES: dict[str, tuple[tuple[str, ...], str]] = {}


def _role(name: str, sql: str, *needs: str) -> None:
    ROLES[name] = (needs, sql)


_role("customer_lane", """
SELECT c.c_custkey, r.r_name AS origin_state
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""")

_role("supplier_lane", """
SELECT s.s_suppkey, r.r_name AS destination_state
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""")

_role("line_totals", """
SELECT l_orderkey, min(l_suppkey) AS drop_supplier, min(l_returnflag) AS flag,
       cast(sum(l_quantity) AS bigint) AS miles
FROM lineitem GROUP BY l_orderkey""")

_role("loads", """
SELECT cast(o.o_orderkey AS string) AS load_id, o.o_orderkey AS load_key,
  'snap-1' AS snapshot_id,
  CASE WHEN o.o_orderkey % 10 = 3 THEN 'cancelled' WHEN o.o_orderstatus = 'P' THEN 'open'
       WHEN o.o_orderstatus = 'O' THEN 'covered' ELSE 'delivered' END AS status,
  c.origin_state, s.destination_state,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN t.flag = 'A' THEN 'box_truck'
       WHEN t.flag = 'N' THEN 'flatbed' WHEN t.flag = 'R' THEN 'refrigerated' END
    AS equipment_code,
  CASE WHEN o.o_orderkey % 23 = 0 THEN 'Hot Shot' WHEN t.flag = 'A' THEN 'Box Truck'
       WHEN t.flag = 'N' THEN 'Flatbed' WHEN t.flag = 'R' THEN 'Refrigerated' END
    AS equipment_raw,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE t.miles END AS distance_miles,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderkey % 9000 END AS weight_lbs,
  cast(o.o_orderdate AS date) AS pickup_date,
  CASE o.o_orderkey % 8 WHEN 0 THEN '08:00 - 12:00' WHEN 1 THEN ' 9:30 ' WHEN 2 THEN 'morning'
    WHEN 3 THEN '' WHEN 4 THEN '14:00 - 13:00' WHEN 5 THEN '25:00' WHEN 6 THEN '7:05-7:05' END
    AS pickup_window_raw,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE cast(round(o.o_totalprice * 100) AS bigint) END
    AS offered_cents
FROM orders o JOIN customer_lane c ON o.o_custkey = c.c_custkey
LEFT JOIN line_totals t ON o.o_orderkey = t.l_orderkey
LEFT JOIN supplier_lane s ON t.drop_supplier = s.s_suppkey""",
      "customer_lane", "supplier_lane", "line_totals")

_role("market_rates", """
SELECT 'snap-1' AS snapshot_id, cast(date_trunc('week', l.l_shipdate) AS date) AS week_start,
  c.origin_state, s.destination_state,
  CASE l.l_returnflag WHEN 'A' THEN 'box_truck' WHEN 'N' THEN 'flatbed' ELSE 'refrigerated' END
    AS equipment_code,
  min(cast(floor(round(l.l_extendedprice * 100) / l.l_quantity) AS bigint)) AS min_cents,
  cast(floor(sum(cast(floor(round(l.l_extendedprice * 100) / l.l_quantity) AS bigint)) / count(*))
    AS bigint) AS avg_cents,
  max(cast(floor(round(l.l_extendedprice * 100) / l.l_quantity) AS bigint)) AS max_cents,
  count(*) AS load_volume
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer_lane c ON o.o_custkey = c.c_custkey
JOIN supplier_lane s ON l.l_suppkey = s.s_suppkey
GROUP BY 1, 2, 3, 4, 5""", "customer_lane", "supplier_lane")

_role("carriers", """
SELECT cast(s.s_suppkey AS string) AS carrier_id, s.s_suppkey AS carrier_key,
  'snap-1' AS snapshot_id,
  CASE WHEN s.s_suppkey % 17 = 5 THEN NULL
       ELSE concat(coalesce(p.p_name, 'plain'), ' Haulage ', cast(s.s_suppkey AS string)) END
    AS company_name,
  CASE WHEN s.s_suppkey % 13 = 0 THEN NULL
       ELSE concat('MC-', cast(100000 + s.s_suppkey AS string)) END AS mc_number_raw,
  CASE WHEN s.s_suppkey % 7 = 0 THEN NULL
       ELSE concat('DOT ', cast(2000000 + s.s_suppkey * 7 AS string)) END AS dot_number_raw,
  CASE cast(floor(s.s_suppkey / 4) AS bigint) % 8 WHEN 0 THEN NULL WHEN 1 THEN 'INACTIVE' WHEN 2 THEN 'active'
       WHEN 3 THEN 'CONDITIONAL' ELSE 'ACTIVE' END AS authority_status,
  CASE cast(floor(s.s_suppkey / 4) AS bigint) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Unsatisfactory' WHEN 2 THEN 'Conditional'
       ELSE 'Satisfactory' END AS safety_rating,
  CASE WHEN s.s_suppkey % 9 = 0 THEN NULL
       ELSE date '1996-01-01' + cast(s.s_suppkey * 37 % 2400 AS int) END AS insurance_expiry,
  CASE s.s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS onboarded,
  CASE WHEN s.s_suppkey % 11 = 3 THEN NULL
       ELSE cast(floor(abs(s.s_acctbal)) AS bigint) % 51 END AS reliability_tenths,
  CASE WHEN s.s_suppkey % 12 = 7 THEN NULL ELSE s.s_suppkey * 31 % 400 END AS loads_completed,
  CASE WHEN s.s_suppkey % 10 = 9 THEN NULL ELSE s.s_suppkey * 53 % 4800 END AS response_hundredths,
  CASE WHEN s.s_suppkey % 15 = 4 THEN NULL
       ELSE concat('Dispatch', cast(s.s_suppkey AS string), '@Carrier.Example') END AS email,
  CASE WHEN s.s_suppkey % 14 = 6 THEN NULL
       ELSE concat('(555) 010-', lpad(cast(s.s_suppkey AS string), 4, '0')) END AS phone
FROM supplier s LEFT JOIN part p ON p.p_partkey = s.s_suppkey""")

_role("carrier_contacts", """
SELECT concat('c:', carrier_id) AS contact_id, carrier_id, concat('Desk ', carrier_id) AS name,
  email AS email_raw, lower(email) AS email_normalized, phone AS phone_raw,
  CASE WHEN phone IS NOT NULL THEN concat('555010', substring(phone, 11, 20)) END
    AS phone_normalized,
  carrier_key % 4 <> 0 AS is_primary
FROM carriers WHERE email IS NOT NULL OR phone IS NOT NULL""", "carriers")

_role("inquiries", """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-',
    cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-',
    cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS inquiry_id,
  concat('ev:', cast(l_orderkey AS string)) AS event_id,
  cast(l_linenumber AS bigint) AS sequence_number,
  CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE cast(l_orderkey AS string) END AS load_id,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE cast(l_suppkey - l_suppkey % 4 AS string) END
    AS carrier_id,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE cast(l_shipdate AS timestamp) END AS occurred_at,
  cast(cast(l_shipdate AS date) + cast(l_linenumber AS int) AS timestamp) AS received_at,
  cast(cast(l_shipdate AS date) + cast(l_linenumber + 1 AS int) AS timestamp) AS created_at,
  CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'not_stated' WHEN 1 THEN 'conditional'
    WHEN 2 THEN 'unavailable' ELSE 'confirmed' END AS availability_status,
  CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'box_truck'
    WHEN l_returnflag = 'N' THEN 'flatbed' ELSE 'refrigerated' END AS equipment_code,
  CASE WHEN l_partkey % 29 = 0 THEN 'unmatched' WHEN l_partkey % 3 = 0 THEN 'needs_review'
    ELSE 'verified' END AS carrier_resolution_status,
  CASE WHEN l_partkey % 31 = 0 THEN 'unmatched' ELSE 'verified' END AS load_resolution_status,
  CASE WHEN l_linenumber = 7 THEN 'rejected' WHEN l_linenumber % 3 = 0 THEN 'needs_review'
    WHEN l_partkey % 5 = 0 THEN 'approved' ELSE 'unreviewed' END AS review_status,
  CASE l_partkey % 6 WHEN 0 THEN 'availability' WHEN 1 THEN 'rate_quote' WHEN 2 THEN 'decline'
    WHEN 3 THEN 'compliance' WHEN 4 THEN 'confirmation' ELSE 'other' END AS primary_intent,
  concat('Part ', cast(l_partkey AS string), ' on truck ', l_returnflag, ' for ',
    cast(cast(l_quantity AS bigint) AS string), ' units') AS summary
FROM lineitem""")

_role("quotes", """
SELECT concat('q:', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-',
    cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-',
    cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS quote_id,
  concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-',
    cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-',
    cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS inquiry_id,
  CASE WHEN l_suppkey % 7 IN (1, 2)
       THEN cast(floor(round(l_extendedprice * 100) / 50) AS bigint)
       ELSE cast(round(l_extendedprice * 100) AS bigint) END AS amount_cents,
  CASE WHEN l_partkey % 37 = 0 THEN 'CAD' ELSE 'USD' END AS currency,
  CASE l_partkey % 7 WHEN 0 THEN 'broker_rate_reference' WHEN 1 THEN 'carrier_counteroffer'
    WHEN 2 THEN 'ambiguous' ELSE 'carrier_quote' END AS quote_type,
  CASE l_suppkey % 7 WHEN 0 THEN 'hourly' WHEN 1 THEN 'per_mile' WHEN 2 THEN 'per_mile'
    ELSE 'all_in' END AS rate_basis,
  CASE WHEN l_partkey % 9 = 0 THEN 'inferred' ELSE 'explicit' END AS evidence_status,
  l_linenumber % 6 <> 0 AS is_current
FROM lineitem WHERE l_partkey % 4 <> 1""")

_role("emails", """
SELECT concat('email:', cast(doc_id AS string)) AS event_id, doc_id,
  CASE WHEN doc_id % 6 = 0 THEN 'manual' ELSE 'dataset' END AS origin,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('CE', cast(doc_id AS string)) END
    AS external_source_id,
  concat(' Desk-', lang, '@Carrier.Example ') AS sender_email_raw,
  concat('Desk ', lang) AS sender_name,
  substring(text, 1, 60) AS subject, text AS body_text, lang, source,
  CASE WHEN doc_id % 7 = 0 THEN NULL
       ELSE cast(date '2024-01-01' + cast(doc_id % 365 AS int) AS timestamp) END AS occurred_at,
  cast(date '2025-01-01' + cast(doc_id * 17 % 365 AS int) AS timestamp) AS received_at,
  CASE doc_id % 5 WHEN 0 THEN 'MC-1' WHEN 1 THEN NULL
       ELSE concat('MC', cast(100000 + doc_id % 150 AS string)) END AS noted_mc,
  CASE doc_id % 4 WHEN 0 THEN ' BOX truck' WHEN 1 THEN '' ELSE 'Flatbed ' END AS noted_equipment,
  CASE doc_id % 3 WHEN 0 THEN NULL ELSE concat('#', cast(doc_id * 7 AS string)) END AS noted_load
FROM documents""")

# one extraction result per email; classes 1-10 of doc_id % 20 break the contract
_role("extraction_parts", """
SELECT d.doc_id, concat('email:', cast(d.doc_id AS string)) AS event_id, d.doc_id % 20 AS variant,
  regexp_extract(d.text, '[A-Za-z]+ [A-Za-z]+', 0) AS phrase,
  1 + d.doc_id % 3 AS nth,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE concat(coalesce(p.p_name, 'plain'), ' Haulage') END
    AS carrier_name,
  CASE WHEN d.doc_id % 3 = 0 THEN concat('MC ', cast(100000 + d.doc_id % 160 AS string)) END
    AS mc_number,
  CASE WHEN d.doc_id % 4 = 1 THEN concat('DOT', cast(2000000 + (d.doc_id % 50) * 7 AS string)) END
    AS dot_number,
  CASE WHEN d.doc_id % 6 = 2 THEN concat('DISPATCH', cast(d.doc_id % 80 AS string),
    '@carrier.example ') END AS contact_email,
  CASE WHEN d.doc_id % 7 = 3 THEN concat('555-010-', lpad(cast(d.doc_id % 90 AS string), 4, '0'))
    END AS contact_phone,
  CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('Load #', cast(d.doc_id * 7 AS string))
    WHEN 2 THEN 'the friday load' ELSE concat('LD-', cast(90000000 + d.doc_id AS string)) END
    AS load_reference,
  CASE d.doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Box Truck' WHEN 2 THEN ' sprinter VAN '
    WHEN 3 THEN 'Flatbed' ELSE 'hot shot' END AS equipment,
  CASE d.doc_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'not_stated' WHEN 2 THEN 'conditional'
    ELSE 'unavailable' END AS availability,
  CASE d.doc_id % 6 WHEN 0 THEN 'availability' WHEN 1 THEN 'rate_quote'
    WHEN 2 THEN 'rate_negotiation' WHEN 3 THEN 'decline' WHEN 4 THEN 'compliance' ELSE 'other' END
    AS intent,
  CASE WHEN d.doc_id % 8 = 5 THEN 'after 5 pm' END AS conditions,
  100 + d.doc_id % 900 AS base_rate
FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id""")

_role("extractions", """
SELECT event_id, doc_id, variant,
  CASE WHEN variant = 7 THEN '{"inquiries":[]}'
       WHEN variant = 9 THEN concat('{"inquiries":[{"carrier_name":"', intent)
  ELSE concat('{"inquiries":[{"carrier_name":',
    CASE WHEN variant = 10 THEN '5' WHEN carrier_name IS NULL THEN 'null'
         ELSE concat('"', carrier_name, '"') END,
    ',"carrier_name_evidence":', CASE WHEN phrase = '' THEN 'null' ELSE
      concat('{"source_part":"body","excerpt":"', CASE WHEN variant = 8 THEN '' ELSE phrase END,
        '","occurrence":', CASE WHEN variant = 5 THEN '0' WHEN variant = 12 THEN '"1"'
        ELSE cast(nth AS string) END, '}') END,
    ',"mc_number":', CASE WHEN mc_number IS NULL THEN 'null' ELSE concat('"', mc_number, '"') END,
    ',"dot_number":', CASE WHEN dot_number IS NULL THEN 'null'
      ELSE concat('"', dot_number, '"') END,
    ',"contact_email":', CASE WHEN contact_email IS NULL THEN 'null'
      ELSE concat('"', contact_email, '"') END,
    ',"contact_phone":', CASE WHEN contact_phone IS NULL THEN 'null'
      ELSE concat('"', contact_phone, '"') END,
    ',"load_reference":', CASE WHEN load_reference IS NULL THEN 'null'
      ELSE concat('"', load_reference, '"') END,
    ',"load_reference_evidence":{"source_part":"subject","excerpt":"',
      CASE WHEN phrase = '' THEN 'no words' ELSE phrase END, '"}',
    ',"equipment":', CASE WHEN equipment IS NULL THEN 'null' ELSE concat('"', equipment, '"') END,
    ',"equipment_evidence":{"source_part":"body","excerpt":"made up excerpt"}',
    CASE WHEN variant = 2 THEN ',"rating":5' ELSE '' END,
    ',"availability":"', CASE WHEN variant = 3 THEN 'maybe' ELSE availability END, '"',
    ',"intents":', CASE WHEN variant = 6 THEN '[]' ELSE concat('["', intent, '","other","',
      intent, '"]') END,
    ',"rates":[{"amount":', CASE WHEN variant = 4 THEN '0' WHEN variant = 11 THEN '"125.50"'
      ELSE cast(base_rate AS string) END, ',"role":"broker_rate_reference","basis":"all_in"},',
    '{"amount":', cast(base_rate + 25 AS string), '.5,"currency":"USD","role":"carrier_quote",',
      '"basis":"all_in","evidence":', CASE WHEN phrase = '' THEN 'null' ELSE
      concat('{"source_part":"body","excerpt":"', phrase, '"}') END, '},',
    '{"amount":', cast(base_rate + 40 AS string), ',"role":"',
      CASE WHEN doc_id % 3 = 1 THEN 'ambiguous' ELSE 'carrier_counteroffer' END,
      '","basis":"per_mile","evidence":', CASE WHEN phrase = '' OR doc_id % 5 = 2 THEN 'null' ELSE
      concat('{"source_part":"body","excerpt":"', phrase, '"}') END, '}]',
    ',"questions":[{"category":"weight","text":"how heavy"}]',
    ',"conditions":', CASE WHEN conditions IS NULL THEN 'null'
      ELSE concat('"', conditions, '"') END,
    CASE WHEN variant = 1 THEN '' ELSE concat(',"summary":"note ', intent, '"') END, '}',
    CASE WHEN doc_id % 4 = 0 THEN concat(',{"carrier_name":null,"mc_number":null,',
      '"load_reference":null,"equipment":null,"availability":"not_stated","intents":["other"],',
      '"rates":[],"questions":[],"summary":"second"}') ELSE '' END,
    ']}') END AS raw_json
FROM extraction_parts""", "extraction_parts")

_role("segments", """
SELECT cast(conv_id AS string) AS transcript_id, concat('call:', cast(conv_id AS string)) AS event_id,
  cast(turn AS int) AS sequence, role AS speaker_label, text,
  turn * 1000 - CASE WHEN (conv_id + turn) % 37 = 5 THEN 1500 ELSE 0 END AS start_cs,
  turn * 1000 + 900 AS end_cs,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE 5000 + (conv_id * 131 + turn * 977) % 5000 END
    AS confidence_bp
FROM conversations""")

_role("evidence_refs", """
SELECT concat('email:', cast(doc_id AS string)) AS event_id, 'carrier_identity' AS field_name,
  'body' AS source_part,
  coalesce(nullif(substring(text, cast(1 + doc_id % 40 AS int), 2), ''), 'zz') AS excerpt,
  1 + doc_id % 3 AS occurrence, cast(NULL AS bigint) AS segment_sequence
FROM documents
UNION ALL
SELECT concat('email:', cast(doc_id AS string)), 'load_reference', 'subject',
  coalesce(nullif(substring(text, 5, 6), ''), 'zz'), 1, NULL FROM documents
UNION ALL
SELECT concat('email:', cast(doc_id AS string)), 'equipment', 'body',
  concat('zq', substring(text, 3, 9)), 1, NULL FROM documents
UNION ALL
SELECT concat('email:', cast(doc_id AS string)), 'availability', 'body',
  coalesce(nullif(substring(text, cast(1 + doc_id % 40 AS int), 2), ''), 'zz'), 1 + doc_id % 3, NULL
FROM documents WHERE doc_id % 3 = 0
UNION ALL
SELECT concat('call:', cast(conv_id AS string)), 'carrier_identity', 'transcript',
  coalesce(nullif(substring(text, 3, 3), ''), 'zz'), 1 + turn % 2, turn FROM conversations
UNION ALL
SELECT concat('call:', cast(conv_id AS string)), 'equipment', 'body',
  coalesce(nullif(substring(text, 3, 3), ''), 'zz'), 1, NULL FROM conversations
UNION ALL
SELECT concat('call:', cast(conv_id AS string)), 'load_reference', 'transcript',
  coalesce(nullif(substring(text, 1, 8), ''), 'zz'), 1, turn + 1 FROM conversations""")

_role("jobs", """
SELECT cast(event_id AS string) AS job_id, concat('ev:', cast(event_id AS string)) AS event_id,
  event_id AS job_key, 'snap-1' AS snapshot_id,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing'
    WHEN 'signup' THEN 'completed' WHEN 'purchase' THEN 'needs_review' ELSE 'failed' END AS status,
  CASE WHEN user_id % 3 = 0 THEN 'manual' ELSE 'dataset' END AS origin,
  CASE WHEN user_id % 4 = 0 THEN 'call' ELSE 'email' END AS source_type,
  cast(regexp_extract(props, '[0-9]+', 0) AS bigint) % 5 AS retry_count,
  cast(ts AS timestamp) AS submitted_at,
  CASE WHEN event_type = 'view' THEN NULL ELSE cast(ts AS timestamp) END AS started_at,
  CASE WHEN event_type <> 'error' THEN NULL ELSE
    CASE event_id % 5 WHEN 0 THEN 'unsupported_media' WHEN 1 THEN 'invalid_source' WHEN 2 THEN NULL
      WHEN 3 THEN 'provider_timeout' ELSE 'internal_error' END END AS last_error_code,
  user_id
FROM events""")

_role("ai_operations", """
SELECT cast(event_id AS string) AS operation_id,
  CASE user_id % 4 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'ingestion' WHEN 2 THEN 'assistant'
    ELSE 'drafting' END AS usage_category,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(round(value * 1000) AS bigint) END AS latency_ms,
  CASE WHEN event_id % 3 = 0 THEN 'nova-3' WHEN event_id % 3 = 1 THEN 'gpt-5.6-luna'
    ELSE 'other-model' END AS model,
  CASE WHEN event_id % 8 = 0 THEN NULL
       ELSE cast(regexp_extract(props, '[0-9]+', 0) AS bigint) * 137 END AS prompt_tokens,
  CASE WHEN event_id % 10 = 0 THEN NULL
       ELSE cast(regexp_extract(props, '[0-9]+', 0) AS bigint) * 41 END AS completion_tokens,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE cast(round(value * 100) AS bigint) END AS audio_cs
FROM events""")

_role("provider_calls", """
SELECT cast(cast(floor(event_id / 3) AS bigint) AS string) AS operation_id,
  event_id % 3 + 1 AS sequence,
  cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS prompt_tokens,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS completion_tokens,
  CASE WHEN event_id % 7 = 0 THEN user_id % 600 END AS audio_seconds,
  cast(round(value * 100) AS bigint) AS cost_micros,
  CASE WHEN event_type = 'error' THEN concat('e', cast(event_id % 4 AS string)) END AS error_code,
  cast(date '2024-01-01' + cast(event_id % 30 AS int) AS timestamp) AS started_at,
  cast(date '2024-01-01' + cast(event_id % 30 + event_id % 3 AS int) AS timestamp) AS completed_at
FROM events""")

_role("review_inquiries", """
SELECT concat('inq:', cast(user_id AS string)) AS inquiry_id,
  CASE user_id % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'approved'
    ELSE 'rejected' END AS review_status,
  user_id % 2 = 0 AS carrier_pending, user_id % 3 = 0 AS load_pending,
  user_id % 5 = 0 AS other_pending,
  concat('car:', cast(user_id AS string)) AS carrier_id,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('load:', cast(user_id AS string)) END AS load_id
FROM events GROUP BY user_id""")

_role("review_actions", """
SELECT concat('inq:', cast(user_id AS string)) AS inquiry_id,
  cast(event_id AS string) AS action_id, event_id AS action_key,
  CASE event_type WHEN 'view' THEN 'approve_extraction' WHEN 'click' THEN 'correct_carrier'
    WHEN 'signup' THEN 'correct_load' WHEN 'purchase' THEN 'reject_extraction'
    ELSE 'reopen_review' END AS action_type,
  CASE WHEN event_type = 'click' THEN concat('car:', regexp_extract(props, '[0-9]+', 0))
       WHEN event_type = 'signup' THEN concat('load:', regexp_extract(props, '[0-9]+', 0)) END
    AS target_id,
  cast(regexp_extract(props, '[0-9]+', 0) AS bigint) % 17 <> 0 AS same_snapshot,
  cast(ts AS timestamp) AS created_at
FROM events""")

_role("job_transitions", """
SELECT cast(user_id AS string) AS job_id, event_id AS seq_key,
  CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'complete'
    WHEN 'signup' THEN 'needs_review' WHEN 'purchase' THEN 'retry' ELSE 'fail' END AS transition,
  cast(ts AS timestamp) AS at_time
FROM events""")

_role("messages", """
SELECT cast(conv_id AS string) AS conversation_id, turn AS sequence, role,
  CASE WHEN (conv_id + turn) % 10 = 4 THEN 'failed' ELSE 'completed' END AS status, text
FROM conversations""")

_role("gold", """
SELECT concat('case-', cast(l.doc_id AS string)) AS case_id,
  concat('CE', cast(l.doc_id AS string)) AS external_source_id, 'email' AS channel, l.doc_id,
  CASE WHEN l.quality = 1 THEN 'availability' ELSE 'rate_quote' END AS primary_intent,
  CASE WHEN l.toxic = 1 THEN 'not_stated' ELSE 'confirmed' END AS availability,
  CASE l.doc_id % 5 WHEN 1 THEN 'box_truck' WHEN 2 THEN 'sprinter_van' WHEN 3 THEN 'flatbed' END
    AS equipment_code,
  CASE WHEN l.doc_id % 4 = 1 THEN cast(l.doc_id * 7 AS string) END AS load_reference_digits,
  CASE WHEN l.doc_id % 3 = 0 THEN cast(100000 + l.doc_id % 120 AS string) END AS mc_number_digits,
  l.doc_id % 17 = 0 AS mc_garbled,
  CASE WHEN l.doc_id % 6 = 5 THEN NULL ELSE cast(140 + l.doc_id % 900 AS string) END
    AS position_amount,
  CASE WHEN l.doc_id % 6 = 5 THEN NULL ELSE 'carrier_counteroffer' END AS position_role
FROM labels l""")


def with_clause(*names: str) -> str:
    """``WITH`` text holding the named roles and everything they read, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = ROLES[name]
        for need in needs:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({ROLES[n][1].strip()}\n)" for n in ordered)
