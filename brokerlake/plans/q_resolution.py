"""Queries: extraction contract, grounding, entity resolution, review reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.functions import text
from brokerlake.operators import extraction, grounding, matching
from brokerlake.plans.registry import joined, query
from brokerlake.plans.tables import Tables
from brokerlake.scale import durable

# classes of the extraction binding that break the contract
_VALID = """, valid AS (
  SELECT * FROM extraction_parts WHERE variant NOT IN (1, 2, 3, 4, 6, 7, 9, 10)
    AND NOT (variant IN (5, 8) AND phrase <> ''))
"""


def valid(t: Tables) -> DataFrame:
    return extraction.validate_extractions(t.extractions)[0]


def inquiries(t: Tables) -> DataFrame:
    return extraction.explode_inquiries(valid(t))


@query("extraction_validate", _VALID + """
SELECT p.event_id, CASE WHEN v.event_id IS NULL THEN 'invalid' ELSE 'valid' END
  AS validation_status,
  CASE WHEN v.event_id IS NOT NULL THEN '' ELSE CASE p.variant
    WHEN 1 THEN 'inquiries.0.summary: missing' WHEN 2 THEN 'inquiries.0: unknown_key'
    WHEN 3 THEN 'inquiries.0.availability: not_in_vocabulary'
    WHEN 4 THEN 'inquiries.0.rates.0.amount: not_a_positive_number'
    WHEN 5 THEN 'inquiries.0.carrier_name_evidence.occurrence: not_a_positive_integer'
    WHEN 6 THEN 'inquiries.0.intents: empty' WHEN 7 THEN 'inquiries: empty'
    WHEN 8 THEN 'inquiries.0.carrier_name_evidence.excerpt: empty' WHEN 9 THEN '$: malformed'
    ELSE 'inquiries.0.carrier_name: not_text' END END AS errors
FROM extraction_parts p LEFT JOIN valid v ON p.event_id = v.event_id""", ("extraction_parts",))
def extraction_validate(t: Tables) -> DataFrame:
    return extraction.check_extractions(t.extractions).select(
        "event_id", "validation_status", joined("errors").alias("errors")
    )


@query("explode_inquiries", _VALID + """
SELECT event_id || '#1' AS inquiry_id, 1 AS sequence_number, intent AS primary_intent,
  CASE WHEN intent = 'other' THEN 'other' ELSE intent || ',other' END AS intents, carrier_name,
  mc_number, load_reference, availability, cast(3 AS bigint) AS rate_count, conditions,
  'how heavy' AS questions
FROM valid
UNION ALL SELECT event_id || '#2', 2, 'other', 'other', NULL, NULL, NULL, 'not_stated', 0, NULL, ''
FROM valid WHERE doc_id % 4 = 0""", ("extraction_parts",))
def explode_inquiries(t: Tables) -> DataFrame:
    return inquiries(t).select(
        "inquiry_id", "sequence_number", "primary_intent", joined("intents").alias("intents"),
        "carrier_name", "mc_number", "load_reference", "availability",
        F.size("rates").cast("bigint").alias("rate_count"), "conditions",
        joined(F.transform("questions", lambda q: q["text"])).alias("questions"),
    )


_LOCATE = """, hay AS (
  SELECT r.*, CASE r.source_part WHEN 'subject' THEN e.subject WHEN 'body' THEN e.body_text
    ELSE s.text END AS block, s.start_cs, s.end_cs, s.confidence_bp
  FROM evidence_refs r LEFT JOIN emails e ON e.event_id = r.event_id
    AND r.source_part IN ('subject', 'body')
  LEFT JOIN segments s ON s.event_id = r.event_id AND r.source_part = 'transcript'
    AND s.sequence = r.segment_sequence
), first_hit AS (SELECT *, coalesce(strpos(block, excerpt), 0) AS p1 FROM hay
), second_hit AS (
  SELECT *, CASE WHEN p1 = 0 THEN 0 WHEN strpos(substring(block, p1 + 1), excerpt) = 0 THEN 0
    ELSE p1 + strpos(substring(block, p1 + 1), excerpt) END AS p2 FROM first_hit
), third_hit AS (
  SELECT *, CASE WHEN p2 = 0 THEN 0 WHEN strpos(substring(block, p2 + 1), excerpt) = 0 THEN 0
    ELSE p2 + strpos(substring(block, p2 + 1), excerpt) END AS p3 FROM second_hit
), placed AS (
  SELECT *, nullif(CASE occurrence WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 0) - 1 AS pos
  FROM third_hit
), spanned AS (
  SELECT *, CASE WHEN pos IS NULL THEN NULL WHEN source_part = 'transcript'
    THEN event_id || '#' || cast(cast(start_cs / 100.0 AS decimal(8,2)) AS varchar) || '-'
      || cast(cast(end_cs / 100.0 AS decimal(8,2)) AS varchar)
    ELSE event_id || '#' || source_part || ':' || pos || '-' || (pos + length(excerpt)) END
    AS span_id FROM placed)
"""
_REF_ROLES = ("evidence_refs", "emails", "segments")


def grounded(t: Tables) -> DataFrame:
    return grounding.ground(t.evidence_refs, t.emails, t.segments)


@query("ground_evidence", _LOCATE + """
SELECT event_id, span_id, min(source_part) AS source_part, count(*) AS cited,
  min(CASE WHEN source_part <> 'transcript' THEN pos END) AS start_offset
FROM spanned WHERE span_id IS NOT NULL GROUP BY 1, 2""", _REF_ROLES)
def ground_evidence(t: Tables) -> DataFrame:
    """Distinct spans with how often each is cited."""
    refs = grounded(t)
    cited = refs.where("span_id IS NOT NULL").groupBy("event_id", "span_id").agg(
        F.count("*").alias("cited")
    )
    spans = grounding.evidence_spans(refs).select(
        "event_id", "span_id", "source_part", F.col("start_offset").cast("bigint")
    )
    return spans.join(cited, ["event_id", "span_id"])


@query("field_assessment", _LOCATE + """
SELECT event_id, field_name, source_part, segment_sequence, occurrence,
  CASE WHEN excerpt = '' THEN 'missing' WHEN span_id IS NULL THEN 'inferred' ELSE 'explicit' END
    AS evidence_status
FROM spanned""", _REF_ROLES)
def field_assessment(t: Tables) -> DataFrame:
    """The cited excerpt stands for the field's value."""
    rows = grounded(t).withColumn("value", F.nullif(F.col("excerpt"), F.lit(""))).withColumn(
        "inquiry_id",
        F.to_json(F.struct("event_id", "source_part", "segment_sequence", "occurrence")),
    )
    fields = "event_id string, source_part string, segment_sequence bigint, occurrence bigint"
    return grounding.field_assessments(rows).select(
        "field_name", "evidence_status", F.from_json("inquiry_id", fields).alias("_k")
    ).select("field_name", "evidence_status", "_k.*")


@query("quote_supersession", _VALID + """, texts AS (
  SELECT v.*, strpos(d.text, v.phrase) AS found FROM valid v JOIN documents d USING (doc_id))
SELECT event_id || '#1' AS inquiry_id, 0 AS rate_index, 'broker_rate_reference' AS quote_type,
  CASE WHEN variant = 11 THEN 12550 ELSE base_rate * 100 END AS amount_cents,
  cast(NULL AS integer) AS supersedes, 'inferred' AS evidence_status, false AS is_current
FROM texts
UNION ALL SELECT event_id || '#1', 1, 'carrier_quote', (base_rate + 25) * 100 + 50, NULL,
  CASE WHEN phrase <> '' AND found > 0 THEN 'explicit' ELSE 'inferred' END,
  doc_id % 3 = 1 AND phrase <> '' AND found > 0
FROM texts
UNION ALL SELECT event_id || '#1', 2,
  CASE WHEN doc_id % 3 = 1 THEN 'ambiguous' ELSE 'carrier_counteroffer' END,
  (base_rate + 40) * 100, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE 1 END,
  CASE WHEN phrase <> '' AND found > 0 AND doc_id % 5 <> 2 THEN 'explicit' ELSE 'inferred' END,
  doc_id % 3 <> 1 AND phrase <> '' AND found > 0 AND doc_id % 5 <> 2
FROM texts""", ("extraction_parts",))
def quote_supersession(t: Tables) -> DataFrame:
    rates = grounding.ground(grounding.rate_mentions(inquiries(t)), t.emails, t.segments)
    return grounding.quote_supersession(rates).select(
        "inquiry_id", "rate_index", "quote_type",
        (F.col("amount") * 100).cast("bigint").alias("amount_cents"), "supersedes",
        "evidence_status", "is_current",
    )


@query("low_confidence_flag", """
SELECT DISTINCT r.event_id FROM evidence_refs r JOIN segments s ON s.event_id = r.event_id
  AND s.sequence = r.segment_sequence
WHERE r.source_part = 'transcript' AND s.confidence_bp < 7000""", _REF_ROLES)
def low_confidence_flag(t: Tables) -> DataFrame:
    rows = grounded(t).withColumnRenamed("event_id", "inquiry_id")
    return grounding.low_confidence(rows).withColumnRenamed("inquiry_id", "event_id")


@query("segment_flags", _LOCATE + """
SELECT g.event_id, cast(g.sequence AS bigint) AS sequence,
  coalesce(g.confidence_bp < 7000, false) AS uncertain,
  EXISTS (SELECT 1 FROM spanned x WHERE x.event_id = g.event_id AND x.span_id IS NOT NULL
    AND x.segment_sequence = g.sequence) AS cited
FROM segments g""", _REF_ROLES)
def segment_flags(t: Tables) -> DataFrame:
    spans = grounded(t).where("span_id IS NOT NULL")
    return grounding.segment_flags(t.segments, spans).select(
        "event_id", F.col("sequence").cast("bigint"), "uncertain", "cited"
    )


@query("segment_order_check", """, steps AS (
  SELECT *, lag(start_cs) OVER (PARTITION BY transcript_id ORDER BY sequence) AS before
  FROM segments)
SELECT transcript_id, count(*) AS segment_count, bool_or(coalesce(start_cs < before, false))
  AS unordered, sum(length(text)) = 0 AS empty,
  CASE WHEN bool_or(coalesce(start_cs < before, false)) OR sum(length(text)) = 0
    THEN 'transcription_failed' ELSE 'ok' END AS outcome
FROM steps GROUP BY 1""", ("segments",))
def segment_order_check(t: Tables) -> DataFrame:
    return grounding.segment_order_check(t.segments)


# -- carriers and loads ---------------------------------------------------------------------------


def directory(t: Tables) -> DataFrame:
    return t.carriers.withColumn(
        "mc_number_normalized", text.digits(F.col("mc_number_raw"))
    ).withColumn("dot_number_normalized", text.digits(F.col("dot_number_raw")))


def proposed(t: Tables) -> DataFrame:
    """One proposed inquiry per email, with its envelope, hints and untrusted annotations."""
    notes = t.emails.select(
        "event_id", text.canonical_address(F.col("sender_email_raw"))
        .alias("sender_email_normalized"), "noted_mc", "noted_equipment", "noted_load",
    )
    hint = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ref "), F.col("doc_id") * 7))
    # what an operator typed beside some named inquiries: another word, and the trade's
    manual = F.when(
        F.col("carrier_name").isNotNull() & (F.col("doc_id") % 4 == 1),
        F.concat(F.substring_index("carrier_name", " ", 1), F.lit(" gear haulage")),
    )
    return t.extraction_parts.join(notes, "event_id").select(
        F.col("event_id").alias("inquiry_id"), F.lit("snap-1").alias("snapshot_id"), "doc_id",
        "carrier_name", "mc_number", "dot_number", "contact_email", "contact_phone",
        "load_reference", "equipment", hint.alias("load_hint"), "sender_email_normalized",
        "noted_mc", "noted_equipment", "noted_load",
        manual.alias("manual_hint"),
    )


def exact(t: Tables) -> DataFrame:
    return matching.match_carrier_exact(
        proposed(t), matching.carrier_index(directory(t), t.carrier_contacts)
    )


_SIGNALS = """, signals AS (
  SELECT event_id AS inquiry_id, 1 AS pri, 'mc_number' AS kind,
    regexp_replace(mc_number, '[^0-9]', '', 'g') AS value FROM extraction_parts
  UNION ALL SELECT event_id, 2, 'dot_number', regexp_replace(dot_number, '[^0-9]', '', 'g')
  FROM extraction_parts
  UNION ALL SELECT event_id, 3, 'email', lower(trim(contact_email)) FROM extraction_parts
  UNION ALL SELECT event_id, 4, 'phone', regexp_replace(contact_phone, '[^0-9]', '', 'g')
  FROM extraction_parts
), answers AS (
  SELECT 'mc_number' AS kind, regexp_replace(mc_number_raw, '[^0-9]', '', 'g') AS value, carrier_id
  FROM carriers
  UNION ALL SELECT 'dot_number', regexp_replace(dot_number_raw, '[^0-9]', '', 'g'), carrier_id
  FROM carriers
  UNION ALL SELECT 'email', email_normalized, carrier_id FROM carrier_contacts
  UNION ALL SELECT 'phone', phone_normalized, carrier_id FROM carrier_contacts
), hits AS (
  SELECT s.inquiry_id, s.pri, s.kind, a.carrier_id FROM signals s
  JOIN answers a ON a.kind = s.kind AND a.value = s.value
), ident AS (
  SELECT inquiry_id, count(DISTINCT carrier_id) AS n, min(carrier_id) AS carrier_id,
    arg_min(kind, pri) AS kind FROM hits GROUP BY 1)
"""
_MATCH_ROLES = ("extraction_parts", "carriers", "carrier_contacts")


@query("match_carrier_exact", _SIGNALS + """
SELECT p.event_id AS inquiry_id, CASE WHEN i.n IS NULL THEN 'none' WHEN i.n = 1 THEN 'verified'
  ELSE 'conflicting' END AS identity, CASE WHEN i.n = 1 THEN i.carrier_id END AS carrier_id,
  CASE WHEN i.n = 1 THEN i.kind END AS primary_method
FROM extraction_parts p LEFT JOIN ident i ON i.inquiry_id = p.event_id""", _MATCH_ROLES)
def match_carrier_exact(t: Tables) -> DataFrame:
    return exact(t)


@query("match_carrier_conflict", _SIGNALS + """
SELECT h.inquiry_id, h.carrier_id, cast(NULL AS varchar) AS shared_signal,
  arg_min(h.kind, h.pri) AS primary_method, cast(1 AS bigint) AS group_size,
  'conflicting' AS match_tier
FROM hits h JOIN ident i USING (inquiry_id) WHERE i.n > 1 GROUP BY 1, 2""", _MATCH_ROLES)
def match_carrier_conflict(t: Tables) -> DataFrame:
    index = matching.carrier_index(directory(t), t.carrier_contacts)
    return matching.match_carrier_conflict(proposed(t), index, exact(t))


# the ratio: twice the letters of the longest common block (the first of equal ones) and of those
# found in the same way before and behind it, over the letters of both names
_WEAK = _SIGNALS + """, asked AS (
  SELECT p.event_id AS inquiry_id, lower(trim(p.carrier_name)) AS n1,
    CASE WHEN p.carrier_name IS NOT NULL AND p.doc_id % 4 = 1
      THEN split_part(lower(p.carrier_name), ' ', 1) || ' gear haulage' END AS n2
  FROM extraction_parts p WHERE p.event_id NOT IN (SELECT inquiry_id FROM ident)
), named AS (
  SELECT n1 AS name FROM asked WHERE n1 IS NOT NULL
  UNION SELECT n2 FROM asked WHERE n2 IS NOT NULL
), pairs AS MATERIALIZED (
  SELECT row_number() OVER () AS pair, name, company FROM named,
    (SELECT DISTINCT lower(company_name) AS company FROM carriers WHERE company_name IS NOT NULL)
), cells AS (
  SELECT pair, i, j FROM (
    SELECT pair, name, company, unnest(range(length(name))) AS i FROM pairs) a,
    LATERAL (SELECT unnest(range(length(a.company))) AS j) b
  WHERE substr(name, i + 1, 1) = substr(company, j + 1, 1)
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY pair, i - j ORDER BY i) AS island FROM cells
), runs AS MATERIALIZED (
  SELECT pair, i, j, row_number() OVER (PARTITION BY pair, i - j, island ORDER BY i DESC) AS run
  FROM islands
), blocks AS (
  WITH RECURSIVE found AS (
    SELECT p.pair, 0::bigint AS alo, length(name)::bigint AS ahi, 0::bigint AS blo,
      length(company)::bigint AS bhi, max(struct_pack(run := run, i := -i, j := -j)) AS best
    FROM pairs p JOIN runs r USING (pair) GROUP BY ALL
    UNION ALL
    SELECT c.pair, c.alo, c.ahi, c.blo, c.bhi,
      max(struct_pack(run := least(run, c.ahi - i, c.bhi - j), i := -i, j := -j))
    FROM (
      SELECT pair, alo, -best.i AS ahi, blo, -best.j AS bhi FROM found
      UNION ALL SELECT pair, -best.i + best.run, ahi, -best.j + best.run, bhi FROM found
    ) c JOIN runs r ON r.pair = c.pair AND i >= c.alo AND i < c.ahi AND j >= c.blo AND j < c.bhi
    GROUP BY c.pair, c.alo, c.ahi, c.blo, c.bhi
  ) SELECT pair, sum(best.run) AS same FROM found GROUP BY pair
), scores AS (
  SELECT name, company, greatest(2 * coalesce(same, 0)::double / (length(name) + length(company)),
    CASE WHEN contains(company, name) OR contains(name, company) THEN 0.75 ELSE 0 END) AS ratio
  FROM pairs LEFT JOIN blocks USING (pair)
), weak AS (
  SELECT inquiry_id, carrier_id, max(ratio) AS ratio, string_agg(DISTINCT code, ',' ORDER BY code) AS signals,
    row_number() OVER (PARTITION BY inquiry_id ORDER BY max(ratio) DESC, carrier_id) AS rank
  FROM (SELECT inquiry_id, n1 AS name, 'name_similarity' AS code FROM asked
    UNION ALL SELECT inquiry_id, n2, 'manual_hint' FROM asked) a
  JOIN scores USING (name) JOIN carriers c ON lower(c.company_name) = company
  WHERE ratio >= 0.6 GROUP BY inquiry_id, carrier_id)
"""


@query("match_carrier_weak", _WEAK + """
SELECT inquiry_id, carrier_id, ratio, cast(rank AS integer) AS rank, signals FROM weak
WHERE rank <= 3""", _MATCH_ROLES)
def match_carrier_weak(t: Tables) -> DataFrame:
    found = matching.match_carrier_weak(proposed(t), t.carriers, exact=exact(t))
    return found.select(
        "inquiry_id", "carrier_id", "ratio", "rank", joined("signal_codes").alias("signals")
    )


_LOAD_MATCH = """, refs AS (
  SELECT event_id AS inquiry_id, load_reference,
    nullif(regexp_replace(load_reference, '[^0-9]', '', 'g'), '') AS ref,
    CASE WHEN doc_id % 3 = 0 THEN cast(doc_id * 7 AS varchar) END AS hint FROM extraction_parts
), found AS (
  SELECT r.*, l.load_id IS NOT NULL AS ok, h.load_id IS NOT NULL AS hint_ok FROM refs r
  LEFT JOIN loads l ON l.load_id = r.ref
  LEFT JOIN loads h ON h.load_id = r.hint AND l.load_id IS NULL AND r.load_reference IS NULL
), load_match AS (
SELECT inquiry_id, CASE WHEN ok THEN ref END AS load_id,
  CASE WHEN ok THEN 'verified' ELSE 'unmatched' END AS load_resolution_status,
  CASE WHEN ok THEN 'exact' WHEN hint_ok THEN 'weak' END AS match_tier,
  CASE WHEN ok THEN 'external_load_id' WHEN hint_ok THEN 'corrected_reference' END
    AS primary_method,
  CASE WHEN hint_ok THEN hint END AS proposed_load_id,
  CASE WHEN ok AND hint <> ref THEN 'conflicting_load_reference'
    WHEN ok THEN NULL WHEN load_reference IS NOT NULL THEN 'ambiguous_load_reference'
    WHEN hint IS NOT NULL THEN 'ambiguous_load_reference' END AS reason_code
FROM found)
"""


@query("match_load", _LOAD_MATCH + "SELECT * FROM load_match", ("extraction_parts", "loads"))
def match_load(t: Tables) -> DataFrame:
    return matching.match_load(proposed(t), t.loads)


_CONFLICTS = """, noted AS (
  SELECT p.event_id AS inquiry_id, array_to_string([x FOR x IN [
    CASE WHEN lower(trim(nullif(e.noted_equipment, ''))) <> lower(trim(p.equipment))
      THEN 'equipment' END,
    CASE WHEN regexp_replace(e.noted_mc, '[^0-9]', '', 'g')
      <> regexp_replace(p.mc_number, '[^0-9]', '', 'g') THEN 'mc_number' END,
    CASE WHEN regexp_replace(e.noted_load, '[^0-9]', '', 'g')
      <> nullif(regexp_replace(p.load_reference, '[^0-9]', '', 'g'), '') THEN 'load_reference' END
  ] IF x IS NOT NULL], ',') AS metadata_conflicts
  FROM extraction_parts p JOIN emails e USING (event_id))
"""


@query("metadata_conflict", _CONFLICTS + "SELECT * FROM noted", ("extraction_parts", "emails"))
def metadata_conflict(t: Tables) -> DataFrame:
    return matching.metadata_conflicts(proposed(t)).select(
        "inquiry_id", joined("metadata_conflicts").alias("metadata_conflicts")
    )


def reasons(t: Tables) -> DataFrame:
    rows = matching.metadata_conflicts(proposed(t))
    decided = durable(exact(t))
    weak = matching.match_carrier_weak(proposed(t), t.carriers, exact=decided).select(
        "inquiry_id"
    ).distinct().withColumn("_weak", F.lit(True))
    loads = matching.match_load(proposed(t), t.loads).select(
        "inquiry_id", F.col("reason_code").alias("load_reason")
    )
    resolved = (
        rows.join(decided.select("inquiry_id", "identity"), "inquiry_id")
        .join(weak, "inquiry_id", "left").join(loads, "inquiry_id")
        .withColumn("weak_found", F.coalesce("_weak", F.lit(False)))
        .withColumn("low_confidence", F.col("doc_id") % 23 == 0)
    )
    return matching.review_reasons(resolved)


# every named inquiry of this binding resembles some carrier: all companies end in the same word
_REASONS = _SIGNALS + _LOAD_MATCH + _CONFLICTS + """, ids AS (
  SELECT p.event_id AS inquiry_id, p.doc_id, p.carrier_name, p.mc_number, coalesce(i.n, 0) AS n
  FROM extraction_parts p LEFT JOIN ident i ON i.inquiry_id = p.event_id
), reasons AS (
  SELECT inquiry_id, 'conflicting_carrier_identity' AS code, 'review' AS severity FROM ids
  WHERE n > 1
  UNION ALL SELECT inquiry_id, CASE WHEN carrier_name IS NULL AND mc_number IS NULL
    THEN 'missing_mc' ELSE 'weak_carrier_match' END, 'review' FROM ids WHERE n = 0
  UNION ALL SELECT inquiry_id, reason_code, 'review' FROM load_match WHERE reason_code IS NOT NULL
  UNION ALL SELECT inquiry_id, 'metadata_content_conflict', 'informational' FROM noted
  WHERE metadata_conflicts <> ''
  UNION ALL SELECT inquiry_id, 'low_confidence_transcript_evidence', 'review' FROM ids
  WHERE doc_id % 23 = 0)
"""
_REASON_ROLES = ("extraction_parts", "carriers", "carrier_contacts", "loads", "emails")


@query("review_reasons", _REASONS + "SELECT * FROM reasons", _REASON_ROLES)
def review_reasons(t: Tables) -> DataFrame:
    return reasons(t)


@query("review_status_derive", _REASONS + """
SELECT p.event_id AS inquiry_id, CASE WHEN EXISTS (SELECT 1 FROM reasons r
    WHERE r.inquiry_id = p.event_id AND r.severity = 'review'
    AND r.code <> 'ambiguous_load_reference') THEN 'needs_review' ELSE 'unreviewed' END
  AS review_status
FROM extraction_parts p""", _REASON_ROLES)
def review_status_derive(t: Tables) -> DataFrame:
    """Ambiguous load references count as resolved here."""
    done = F.when(
        F.col("code") == "ambiguous_load_reference", F.lit("2024-01-01").cast("timestamp")
    )
    return matching.review_status_derive(
        proposed(t).select("inquiry_id"), reasons(t).withColumn("resolved_at", done)
    )


@query("match_listing", _SIGNALS + """
SELECT h.inquiry_id, h.carrier_id, i.n = 1 AS is_selected,
  CASE WHEN i.n = 1 THEN 'exact' ELSE 'conflicting' END AS match_tier
FROM hits h JOIN ident i USING (inquiry_id) GROUP BY ALL""", _MATCH_ROLES)
def match_listing(t: Tables) -> DataFrame:
    single = exact(t).where("identity = 'verified'").select(
        "inquiry_id", "carrier_id", F.lit(True).alias("is_selected"),
        F.lit("exact").alias("match_tier"),
    )
    several = match_carrier_conflict(t).select(
        "inquiry_id", "carrier_id", F.lit(False).alias("is_selected"), "match_tier"
    )
    rows = single.unionByName(several).withColumn("created_at", F.lit(0)).withColumn(
        "match_id", F.col("carrier_id")
    )
    return matching.match_listing(rows).drop("created_at", "match_id")


@query("load_lookup", """, asked AS (
  SELECT event_id AS request_id, load_reference AS reference, CASE WHEN doc_id % 9 = 0 THEN '7' END
    AS scope_load_id, coalesce(nullif(regexp_replace(load_reference, '[^0-9]', '', 'g'), ''),
    load_reference) AS load_id FROM extraction_parts WHERE load_reference IS NOT NULL)
SELECT request_id, a.load_id, CASE WHEN scope_load_id <> a.load_id THEN 'scope_denied'
  WHEN l.load_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome
FROM asked a LEFT JOIN loads l ON l.load_id = a.load_id""", ("extraction_parts", "loads"))
def load_lookup(t: Tables) -> DataFrame:
    asked = t.extraction_parts.where("load_reference IS NOT NULL").select(
        F.col("event_id").alias("request_id"), F.col("load_reference").alias("reference"),
        F.when(F.col("doc_id") % 9 == 0, "7").alias("scope_load_id"),
    )
    return matching.load_lookup(asked, t.loads).select("request_id", "load_id", "outcome")


@query("carrier_lookup", """, asked AS (
  SELECT event_id AS request_id, regexp_replace(mc_number, '[^0-9]', '', 'g') AS mc,
    upper(trim(carrier_name)) AS name FROM extraction_parts
), by_mc AS (
  SELECT a.request_id, min(c.carrier_id) AS id FROM asked a JOIN carriers c
    ON regexp_replace(c.mc_number_raw, '[^0-9]', '', 'g') = a.mc GROUP BY 1
), names AS (SELECT DISTINCT name FROM asked
), by_name AS (
  SELECT n.name, min(c.carrier_id) FILTER (WHERE upper(c.company_name) = n.name) AS id,
    min(c.carrier_id) AS part_id
  FROM names n JOIN carriers c ON contains(upper(c.company_name), n.name) GROUP BY 1)
SELECT a.request_id, coalesce(m.id, n.id, n.part_id) AS carrier_id,
  CASE WHEN m.id IS NOT NULL THEN 'mc_number' WHEN n.id IS NOT NULL THEN 'name'
    WHEN n.part_id IS NOT NULL THEN 'name_part' ELSE 'not_found' END AS matched_by
FROM asked a LEFT JOIN by_mc m USING (request_id) LEFT JOIN by_name n USING (name)""",
       ("extraction_parts", "carriers"))
def carrier_lookup(t: Tables) -> DataFrame:
    asked = t.extraction_parts.select(
        F.col("event_id").alias("request_id"), "mc_number",
        F.col("carrier_name").alias("company_name"),
    )
    return matching.carrier_lookup(asked, directory(t))


@query("carrier_search", """
SELECT carrier_id, company_name FROM carriers c WHERE contains(upper(company_name), 'BOLT')
  OR EXISTS (SELECT 1 FROM carrier_contacts k WHERE k.carrier_id = c.carrier_id
    AND contains(upper(k.email_normalized), 'BOLT'))
ORDER BY company_name NULLS LAST, carrier_id LIMIT 8""", ("carriers", "carrier_contacts"))
def carrier_search(t: Tables) -> DataFrame:
    return matching.carrier_search(directory(t), t.carrier_contacts, "Bolt").select(
        "carrier_id", "company_name"
    )
