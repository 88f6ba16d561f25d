"""Queries: scalar functions over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.functions import text
from brokerlake.operators import aiops, boards, extraction, grounding, ingestion
from brokerlake.plans.oracles import half_even
from brokerlake.plans.registry import query
from brokerlake.plans.tables import Tables

# the SQL side spells out the canonical text and address; the given texts hold no characters
# whose compatibility form differs from their composed form
_ADDRESS = "lower(trim(nfc_normalize(sender_email_raw), E' \\t\\n\\r'))"


def _canonical(column: str) -> str:
    lines = f"regexp_replace(nfc_normalize({column}), E'\\r\\n?', E'\\n', 'g')"
    return (f"trim(regexp_replace({lines}, E'[ \\t]+(\\n|$)', E'\\\\1', 'g'),"
            " E' \\t\\n\\r\\x0b\\x0c')")


@query("fn_digits", """
SELECT carrier_id, nullif(regexp_replace(mc_number_raw, '[^0-9]', '', 'g'), '') AS mc,
  nullif(regexp_replace(company_name, '[^0-9]', '', 'g'), '') AS in_name FROM carriers""",
       ("carriers",))
def fn_digits(t: Tables) -> DataFrame:
    return t.carriers.select(
        "carrier_id", text.digits(F.col("mc_number_raw")).alias("mc"),
        text.digits(F.col("company_name")).alias("in_name"),
    )


@query("fn_canonical_address", f"""
SELECT event_id, {_ADDRESS} AS address FROM emails""", ("emails",))
def fn_canonical_address(t: Tables) -> DataFrame:
    return t.emails.select(
        "event_id", text.canonical_address(F.col("sender_email_raw")).alias("address")
    )


@query("fn_canonical_text", f"""
SELECT event_id, sha256({_canonical('body_text')}) AS body_hash FROM emails""", ("emails",))
def fn_canonical_text(t: Tables) -> DataFrame:
    return t.emails.select(
        "event_id", F.sha2(text.canonical_text(F.col("body_text")), 256).alias("body_hash")
    )


FINGERPRINTS = f""", printed AS (
  SELECT *, sha256('email:v1' || chr(0) || {_ADDRESS} || chr(0) || {_canonical('subject')}
    || chr(0) || {_canonical('body_text')}) AS content_fingerprint FROM emails)
"""


@query("fn_email_fingerprint", FINGERPRINTS + """
SELECT event_id, content_fingerprint FROM printed""", ("emails",))
def fn_email_fingerprint(t: Tables) -> DataFrame:
    return ingestion.with_fingerprint(t.emails).select("event_id", "content_fingerprint")


@query("fn_audio_fingerprint", """
SELECT page_id, sha256('audio-bytes:v1' || chr(0) || html) AS fingerprint FROM pages""")
def fn_audio_fingerprint(t: Tables) -> DataFrame:
    return t.base("pages").select(
        "page_id", text.audio_fingerprint(F.encode("html", "UTF-8")).alias("fingerprint")
    )


@query("fn_carrier_identity", """
SELECT carrier_id, CASE
    WHEN mc_number_raw IS NOT NULL THEN 'mc:' || regexp_replace(mc_number_raw, '[^0-9]', '', 'g')
    WHEN dot_number_raw IS NOT NULL THEN 'dot:' || regexp_replace(dot_number_raw, '[^0-9]', '', 'g')
    WHEN email IS NOT NULL AND carrier_key % 2 = 0 THEN 'email:' || lower(email)
    WHEN phone IS NOT NULL AND carrier_key % 3 = 0
      THEN 'phone:' || regexp_replace(phone, '[^0-9]', '', 'g')
    ELSE 'rowhash:' || substring(sha256('{"name":"' || coalesce(company_name, '') || '"}' || chr(0)
      || carrier_id), 1, 24) END AS source_identifier
FROM carriers""", ("carriers",))
def fn_carrier_identity(t: Tables) -> DataFrame:
    rows = t.carriers.select(
        "carrier_id", F.col("mc_number_raw").alias("mc_number"),
        F.col("dot_number_raw").alias("dot_number"),
        F.when(F.col("carrier_key") % 2 == 0, F.col("email")).alias("email"),
        F.when(F.col("carrier_key") % 3 == 0, F.col("phone")).alias("phone"),
        F.concat(F.lit('{"name":"'), F.coalesce("company_name", F.lit("")), F.lit('"}'))
        .alias("row_json"),
        F.col("carrier_id").alias("ordinal"),
    )
    return rows.select("carrier_id", ingestion.carrier_identity().alias("source_identifier"))


@query("fn_pickup_window", """
SELECT load_id, CASE load_key % 8 WHEN 0 THEN 'range' WHEN 1 THEN 'single_time'
    WHEN 2 THEN 'qualitative' WHEN 3 THEN 'missing' WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid'
    WHEN 6 THEN 'range' ELSE 'missing' END AS pickup_window_status,
  epoch_us(CASE load_key % 8 WHEN 0 THEN pickup_date + INTERVAL 8 HOUR
    WHEN 1 THEN pickup_date + INTERVAL 570 MINUTE
    WHEN 6 THEN pickup_date + INTERVAL 425 MINUTE END) AS start_us,
  epoch_us(CASE load_key % 8 WHEN 0 THEN pickup_date + INTERVAL 12 HOUR
    WHEN 1 THEN pickup_date + INTERVAL 570 MINUTE
    WHEN 6 THEN pickup_date + INTERVAL 425 MINUTE END) AS end_us
FROM loads""", ("loads",))
def fn_pickup_window(t: Tables) -> DataFrame:
    parsed = t.loads.select(
        "load_id",
        *ingestion.pickup_window(F.col("pickup_window_raw"), F.col("pickup_date"), F.lit("UTC")),
    )
    return parsed.select(
        "load_id", "pickup_window_status", F.unix_micros("pickup_start_at").alias("start_us"),
        F.unix_micros("pickup_end_at").alias("end_us"),
    )


@query("fn_aware_timestamp", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts))
  WHEN 1 THEN epoch_us(date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE) END AS at_us
FROM events""")
def fn_aware_timestamp(t: Tables) -> DataFrame:
    """Instants with ``Z`` and with an offset are read; naive and broken ones are not."""
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.concat(written, F.lit("Z")))
        .when(kind == 1, F.concat(written, F.lit("+05:30")))
        .when(kind == 2, written).otherwise(F.concat(F.lit("x"), written, F.lit("Z")))
    )
    return t.base("events").select(
        "event_id", F.unix_micros(ingestion.aware_timestamp(raw)).alias("at_us")
    )


@query("fn_optional_numeric", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN NULL WHEN 2 THEN NULL
    ELSE user_id END AS as_int, event_id % 4 = 2 AS int_rejected,
  CASE event_id % 4 WHEN 1 THEN NULL WHEN 2 THEN user_id * 100 + 50 ELSE user_id * 100 END
    AS as_cents, false AS decimal_rejected
FROM events""")
def fn_optional_numeric(t: Tables) -> DataFrame:
    """Integers, blanks, decimals and padded integers; a decimal is not an integer."""
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = (
        F.when(kind == 0, user).when(kind == 1, F.lit(""))
        .when(kind == 2, F.concat(user, F.lit(".50")))
        .otherwise(F.concat(F.lit(" "), user, F.lit(" ")))
    )
    whole, not_whole = ingestion.optional_int(raw)
    amount, not_amount = ingestion.optional_decimal(raw, "decimal(12,2)")
    return t.base("events").select(
        "event_id", whole.alias("as_int"), not_whole.alias("int_rejected"),
        (amount * 100).cast("bigint").alias("as_cents"), not_amount.alias("decimal_rejected"),
    )


def equipment_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Alias and type tables built from the vocabulary, one row per label."""
    from brokerlake import vocab

    types = t.spark.createDataFrame(
        [(code, label, True) for label, code in vocab.EQUIPMENT_LABELS.items()],
        "code string, display_name string, is_active boolean",
    )
    aliases = t.spark.createDataFrame(
        [("dataset", label.lower(), code) for label, code in vocab.EQUIPMENT_LABELS.items()]
        + [("broker", "26ft box", "box_truck")],
        "source string, normalized_label string, equipment_code string",
    )
    return aliases, types


@query("fn_equipment_alias", """
SELECT event_id, CASE lower(trim(equipment)) WHEN 'box truck' THEN 'box_truck'
  WHEN 'sprinter van' THEN 'sprinter_van' WHEN 'flatbed' THEN 'flatbed'
  WHEN 'refrigerated' THEN 'refrigerated' END AS equipment_code
FROM extraction_parts""", ("extraction_parts",))
def fn_equipment_alias(t: Tables) -> DataFrame:
    rows = t.extraction_parts.select("event_id", "equipment")
    return extraction.resolve_equipment(rows, "equipment", *equipment_tables(t)).select(
        "event_id", "equipment_code"
    )


@query("fn_equipment_synonym", """
SELECT doc_id, CASE WHEN contains(low, 'box') OR contains(low, 'straight truck') THEN 'box_truck'
  WHEN contains(low, 'sprinter') OR contains(low, 'van') THEN 'sprinter_van'
  WHEN contains(low, 'flatbed') OR contains(low, 'flat bed') THEN 'flatbed'
  WHEN contains(low, 'reefer') OR contains(low, 'refrigerated') OR contains(low, 'refer truck')
  THEN 'refrigerated' END AS equipment_code
FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def fn_equipment_synonym(t: Tables) -> DataFrame:
    return t.base("documents").select(
        "doc_id", aiops.normalize_equipment(F.col("text")).alias("equipment_code")
    )


@query("fn_lane_key", """
SELECT load_id, upper(trim(origin_state)) || '>' || upper(trim(destination_state)) AS lane
FROM loads""", ("loads",))
def fn_lane_key(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" "), F.lower("origin_state"), F.lit("\t"))
    return t.loads.select(
        "load_id",
        F.concat(ingestion.lane_state(padded), F.lit(">"),
                 ingestion.lane_state(F.col("destination_state"))).alias("lane"),
    )


@query("fn_array_explode", """, lanes AS (
  SELECT c.carrier_id, upper(n.n_name) AS o, CASE WHEN c.carrier_key % 2 = 0 THEN 'NJ' ELSE 'PA' END
    AS d, c.carrier_key FROM carriers c JOIN nation n ON n.n_nationkey = c.carrier_key % 25)
SELECT carrier_id, 'lane' AS kind, o || '>' || d AS link FROM lanes WHERE carrier_key % 4 <> 1
UNION ALL SELECT carrier_id, 'equipment', 'flatbed' FROM lanes WHERE carrier_key % 3 <> 0
UNION ALL SELECT carrier_id, 'equipment', 'box_truck' FROM lanes""", ("carriers",))
def fn_array_explode(t: Tables) -> DataFrame:
    """Repeated labels and lanes collapse; unknown labels and odd lanes are dropped."""
    nations = t.base("nation").select(
        F.col("n_nationkey").cast("bigint").alias("_n"), "n_name"
    )
    end = F.when(F.col("carrier_key") % 2 == 0, F.lit("nj")).otherwise(F.lit(" PA"))
    lane = F.concat(F.lower("n_name"), F.when(F.col("carrier_key") % 4 == 1, "-x-").otherwise("-"),
                    end)
    rows = t.carriers.withColumn("_n", F.col("carrier_key") % 25).join(nations, "_n").select(
        "carrier_id", F.array(lane, lane).alias("preferred_lanes"),
        F.array(
            F.lit("Box Truck"), F.lit(" box truck "), F.lit("Hot Shot"),
            F.when(F.col("carrier_key") % 3 != 0, F.lit("FLATBED")),
        ).alias("equipment_types"),
    )
    lanes = ingestion.explode_lanes(rows).select(
        "carrier_id", F.lit("lane").alias("kind"),
        F.concat_ws(">", "origin_state", "destination_state").alias("link"),
    )
    trucks = ingestion.explode_equipment(rows, equipment_tables(t)[0]).select(
        "carrier_id", F.lit("equipment").alias("kind"), F.col("equipment_code").alias("link")
    )
    return lanes.unionByName(trucks)


_IN, _OUT = "coalesce(prompt_tokens, 0) * 2000", "coalesce(completion_tokens, 0) * 12000"
COSTED = f""", costed AS (
  SELECT *, CASE model WHEN 'gpt-5.6-luna' THEN {half_even(f'{_IN} + {_OUT}', '10000')}
    WHEN 'nova-3' THEN {half_even('audio_cs * 43', '60')} END AS cost_micros FROM ai_operations)
"""


@query("fn_op_cost", COSTED + """
SELECT operation_id, cast(cost_micros AS bigint) AS cost_micros FROM costed""", ("ai_operations",))
def fn_op_cost(t: Tables) -> DataFrame:
    return aiops.op_cost(t.operations).select(
        "operation_id", (F.col("estimated_cost") * 1_000_000).cast("bigint").alias("cost_micros")
    )


@query("fn_strip_nul", """
SELECT page_id, sha256(to_json({'h': html})) AS cleaned FROM pages""")
def fn_strip_nul(t: Tables) -> DataFrame:
    """NULs are put before every tag and stripped again from the JSON text."""
    marked = F.regexp_replace("html", "<", "\x00<")
    cleaned = text.strip_nul(F.to_json(F.struct(marked.alias("h"))))
    return t.base("pages").select(
        "page_id", F.sha2(cleaned, 256).alias("cleaned")
    )


@query("fn_when", """
SELECT event_id, epoch_us(coalesce(occurred_at, received_at)) AS when_us,
  occurred_at IS NULL AS when_is_fallback FROM emails""", ("emails",))
def fn_when(t: Tables) -> DataFrame:
    return t.emails.select("event_id", *boards.event_when()).select(
        "event_id", F.unix_micros("when_at").alias("when_us"), "when_is_fallback"
    )


# spans cited in bodies: three per text, some touching, some past its end
_SPANS = """, spans AS (
  SELECT event_id, doc_id % 50 AS s, doc_id % 50 + 20 AS e FROM emails
  UNION ALL SELECT event_id, doc_id % 50 + 20, doc_id % 50 + 35 FROM emails
  UNION ALL SELECT event_id, 90 + doc_id % 7, 5000 FROM emails WHERE doc_id % 2 = 0
), clipped AS (
  SELECT p.event_id, p.s, least(p.e, length(m.body_text)) AS e FROM spans p
  JOIN emails m USING (event_id) WHERE least(p.e, length(m.body_text)) > p.s
), marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY event_id ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM clipped
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY event_id ORDER BY s, e) AS island FROM marked
), merged AS (
  SELECT event_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY event_id, island)
"""


def _spans(t: Tables) -> DataFrame:
    at = F.col("doc_id") % 50
    span = lambda a, b: F.struct(a.alias("start_offset"), b.alias("end_offset"))
    spans = F.array(
        span(at, at + 20), span(at + 20, at + 35),
        F.when(F.col("doc_id") % 2 == 0, span(F.col("doc_id") % 7 + 90, F.lit(5000).cast("bigint"))),
    )
    kept = F.filter(spans, lambda s: s.isNotNull())
    return t.emails.select("event_id", F.inline(kept)).select(
        "event_id", F.col("start_offset").cast("int"), F.col("end_offset").cast("int")
    )


@query("merge_intervals", _SPANS + """
SELECT event_id, cast(s AS bigint) AS s, cast(e AS bigint) AS e FROM merged""", ("emails",))
def merge_intervals(t: Tables) -> DataFrame:
    lengths = t.emails.select("event_id", F.char_length("body_text").alias("n"))
    clipped = _spans(t).join(lengths, "event_id").select(
        "event_id", F.col("start_offset").alias("s"), F.least("end_offset", "n").alias("e")
    ).where("e > s")
    merged = grounding.merge_intervals(clipped, ["event_id"], "s", "e")
    return merged.select("event_id", F.col("s").cast("bigint"), F.col("e").cast("bigint"))


@query("fn_text_pieces", _SPANS + """, cuts AS (
  SELECT event_id, s, e, true AS hit FROM merged
  UNION ALL SELECT event_id, coalesce(lag(e) OVER (PARTITION BY event_id ORDER BY s), 0), s, false
  FROM merged
  UNION ALL SELECT m.event_id, coalesce(x.e, 0), length(m.body_text), false FROM emails m
  LEFT JOIN (SELECT event_id, max(e) AS e FROM merged GROUP BY 1) x USING (event_id))
SELECT c.event_id, cast(c.s AS bigint) AS s, cast(c.e AS bigint) AS e, c.hit,
  sha256(substring(m.body_text, cast(c.s + 1 AS bigint), cast(c.e - c.s AS bigint))) AS piece_hash
FROM cuts c JOIN emails m USING (event_id)
WHERE c.e > c.s OR length(m.body_text) = 0""", ("emails",))
def fn_text_pieces(t: Tables) -> DataFrame:
    pieces = grounding.text_pieces(t.emails, _spans(t), "event_id", "body_text")
    return pieces.select(
        "event_id", F.col("start_offset").cast("bigint").alias("s"),
        F.col("end_offset").cast("bigint").alias("e"), "hit",
        F.sha2("piece", 256).alias("piece_hash"),
    )
