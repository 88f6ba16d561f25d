"""Queries: sources, snapshots, admission, identity, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake.operators import ingestion
from brokerlake.plans.oracles import half_even
from brokerlake.plans.q_functions import FINGERPRINTS, equipment_tables
from brokerlake.plans.registry import joined, query, scratch
from brokerlake.plans.tables import Tables
from brokerlake.scale import durable
from brokerlake.sources import files, sinks

# -- files -------------------------------------------------------------------------------------


@query("scan_loads_csv", """
SELECT cast(o_orderkey AS varchar) AS load_id, o_orderkey % 29 = 0 AS rejected,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 11 = 0 THEN NULL
    ELSE cast(o_custkey + 1 AS bigint) END AS distance_miles,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
    ELSE cast(round(o_totalprice * 100) AS bigint) END AS offered_cents,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
    ELSE cast(cast(o_orderdate AS date) AS varchar) END AS pickup_date,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 2 = 0 THEN NULL ELSE 'flatbed' END
    AS equipment_code,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'single_time' END AS pickup_window_status
FROM orders""")
def scan_loads_csv(t: Tables) -> DataFrame:
    """Orders written as a loads file, read back as text and imported; some rows do not parse."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("decimal(14,0)") / F.lit(100)
    miles = F.when(key % 11 != 0, (F.col("o_custkey") + 1).cast("string"))
    raw = t.base("orders").select(
        key.cast("string").alias("load_id"), F.lit('Said "A",\nB').alias("origin_city"),
        F.lit(" pa ").alias("origin_state"), F.lit("").alias("origin_zip"),
        F.lit("Y").alias("destination_city"), F.lit("nj").alias("destination_state"),
        F.lit("07001").alias("destination_zip"),
        F.when(key % 29 == 0, "12.0").otherwise(miles).alias("distance_miles"),
        F.when(key % 2 == 0, "Hot Shot").otherwise(" FLATBED").alias("equipment_type"),
        F.lit(None).cast("string").alias("weight_lbs"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("pickup_date"),
        F.lit("9:30").alias("pickup_window"), F.lit("").alias("delivery_date"),
        cents.cast("decimal(12,2)").cast("string").alias("offered_rate_usd"),
        F.lit("open").alias("status"), F.lit("").alias("shipper_name"),
        F.lit("").alias("internal_notes"),
    )
    folder = scratch(t.spark)
    raw.write.option("header", True).option("escape", '"').csv(folder)
    rows, problems = files.read_loads(t.spark, folder)
    files.require_clean(problems)
    loads, rejected = ingestion.import_loads(rows, equipment_tables(t)[0], "snap-1", "UTC")
    kept = loads.select(
        "load_id", F.lit(False).alias("rejected"), F.col("distance_miles").cast("bigint"),
        (F.col("offered_rate_usd") * 100).cast("bigint").alias("offered_cents"),
        F.col("pickup_date").cast("string"), "equipment_code", "pickup_window_status",
    )
    return kept.unionByName(
        rejected.select("load_id", F.lit(True).alias("rejected")), allowMissingColumns=True
    )


@query("scan_rates_csv", """
SELECT cast(week_start AS varchar) AS week_start, upper(origin_state) AS origin_state,
  destination_state, equipment_code, min_cents, avg_cents, max_cents, load_volume,
  cast(NULL AS varchar) AS problems
FROM market_rates WHERE equipment_code <> 'refrigerated'
UNION ALL SELECT cast(week_start AS varchar), upper(origin_state), destination_state, NULL, NULL, NULL,
  NULL, NULL, 'equipment_type' FROM market_rates WHERE equipment_code = 'refrigerated'""",
       ("market_rates",))
def scan_rates_csv(t: Tables) -> DataFrame:
    """Weekly rates written as a rate file and imported; an unknown label rejects its row."""
    label = (
        F.when(F.col("equipment_code") == "box_truck", "Box Truck")
        .when(F.col("equipment_code") == "flatbed", "Flatbed").otherwise("Cold Box")
    )
    raw = t.market_rates.select(
        F.col("week_start").cast("string"), F.lower("origin_state").alias("origin_state"),
        "destination_state", label.alias("equipment_type"),
        F.col("average_rate_per_mile").cast("string").alias("avg_rate_per_mile"),
        F.col("minimum_rate_per_mile").cast("string").alias("min_rate_per_mile"),
        F.col("maximum_rate_per_mile").cast("string").alias("max_rate_per_mile"),
        F.col("load_volume").cast("string"),
    )
    folder = scratch(t.spark)
    raw.write.option("header", True).csv(folder)
    rates, rejected = ingestion.import_rates(
        files.read_rates(t.spark, folder), equipment_tables(t)[0], "snap-1"
    )
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    kept = rates.select(
        F.col("week_start").cast("string"), "origin_state", "destination_state", "equipment_code",
        cents("minimum_rate_per_mile").alias("min_cents"),
        cents("average_rate_per_mile").alias("avg_cents"),
        cents("maximum_rate_per_mile").alias("max_cents"),
        F.col("load_volume").cast("bigint"), F.lit(None).cast("string").alias("problems"),
    )
    refused = rejected.select(
        "week_start", F.upper("origin_state").alias("origin_state"), "destination_state",
        joined("problems").alias("problems"),
    )
    return kept.unionByName(refused, allowMissingColumns=True)


def _array_files(t: Tables, rows: DataFrame, item: Column) -> str:
    """The items written as files that hold one JSON array each."""

    def framed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lead = "[ "
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(lead + value)
                lead = ", "
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if lead == "[ " else "]"]})

    folder = scratch(t.spark)
    rows.select(item.alias("value")).mapInArrow(framed, "value string").write.text(folder)
    return folder


@query("scan_carriers_json", """
SELECT coalesce(company_name, '-') AS company_name, mc_number_raw AS mc_number,
  carrier_key % 3 = 0 AS has_lane, false AS problem FROM carriers WHERE carrier_key % 10 <> 9
UNION ALL SELECT '-', NULL, false, false FROM carriers WHERE carrier_key % 10 = 9
UNION ALL SELECT 'missing required key', NULL, false, true FROM carriers
WHERE carrier_key % 10 = 9""", ("carriers",))
def scan_carriers_json(t: Tables) -> DataFrame:
    """Carrier objects, some without the key that must be present."""
    whole = F.to_json(
        F.struct(
            F.col("company_name"), F.col("mc_number_raw").alias("mc_number"),
            F.when(F.col("carrier_key") % 3 == 0, F.array(F.lit("PA-NJ"))).alias("preferred_lanes"),
            "onboarded",
        ),
        {"ignoreNullFields": "false"},
    )
    item = F.when(F.col("carrier_key") % 10 == 9, F.lit('{"email":null}')).otherwise(whole)
    rows, problems = files.read_carriers(t.spark, _array_files(t, t.carriers, item))
    read = rows.select(
        F.coalesce("company_name", F.lit("-")).alias("company_name"), "mc_number",
        F.col("preferred_lanes").isNotNull().alias("has_lane"), F.lit(False).alias("problem"),
    )
    return read.unionByName(
        problems.select(
            F.col("problem").alias("company_name"), F.lit(None).cast("string").alias("mc_number"),
            F.lit(False).alias("has_lane"), F.lit(True).alias("problem"),
        )
    )


@query("scan_emails_json", FINGERPRINTS + """
SELECT 'email' AS kind, 'CE' || doc_id AS detail,
  epoch_us(CASE WHEN doc_id % 50 <> 7 THEN received_at END) AS at_us, content_fingerprint
FROM printed
UNION ALL SELECT 'duplicate content', content_fingerprint, NULL, NULL FROM printed
GROUP BY content_fingerprint HAVING count(*) > 1
UNION ALL SELECT 'timestamp without a zone', 'CE' || doc_id, NULL, NULL FROM printed
WHERE doc_id % 50 = 7""", ("emails",))
def scan_emails_json(t: Tables) -> DataFrame:
    stamp = F.concat(
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.col("doc_id") % 50 == 7, "").otherwise("+00:00"),
    )
    item = F.to_json(
        F.struct(
            F.concat(F.lit("CE"), "doc_id").alias("email_id"), stamp.alias("timestamp"),
            F.col("sender_email_raw").alias("from_email"), F.lit("desk@x.example").alias("to_email"),
            "subject", F.col("body_text").alias("body"),
        )
    )
    rows, problems = files.read_emails(t.spark, _array_files(t, t.emails, item))
    read = rows.select(
        F.lit("email").alias("kind"), F.col("email_id").alias("detail"),
        F.unix_micros("source_occurred_at").alias("at_us"), "content_fingerprint",
    )
    return read.unionByName(
        problems.select(F.col("problem").alias("kind"), "detail"), allowMissingColumns=True
    )


def _little_endian(value: Column) -> Column:
    """Four bytes of a number, lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


#: bytes of audio up to which recordings that hold audio hold all of it
_AUDIO = 4096


def recordings(t: Tables, audio: bool = False) -> DataFrame:
    """A recording per event, built from its numbers: every verdict occurs, headers included that
    lie behind a long list chunk. What a kind has in common is one literal.

    They end behind their header, as the importer takes them. With ``audio`` those of up to ``_AUDIO``
    bytes hold all that they declare, and all declare their whole length; the others are cut short.
    """
    kind, frames = F.col("event_id") % 9, F.expr("user_id * 100 + event_id % 977 + 1")

    def build(n: int) -> Column:
        channels, width, rate = {3: 3, 8: 2}.get(n, 1), 5 if n == 4 else 2, 8000
        block = channels * width
        if n == 0:
            return F.lit(b"")
        number = lambda v, size: v.to_bytes(size, "little")
        declared = {5: F.lit(0), 6: F.lit(8000 * 601)}.get(n, frames)
        if audio and n == 6:  # as many seconds in few bytes
            rate, declared = 1, F.lit(601)
        head = b"WAVE"
        if n != 2:
            head += b"fmt " + number(16, 4) + number(1, 2) + number(channels, 2) + number(rate, 4)
            head += number(block * rate, 4) + number(block, 2) + number(width * 8, 2)
            head += b"LIST" + number(6000, 4) + b"x" * 6000 if n == 8 else b""
            head += b"data"
        name = F.lit(b"RIFX" if n == 1 else b"RIFF")
        if n == 2:
            return F.concat(name, F.lit(number(len(head), 4) + head))
        data = declared * block
        size = F.lit(len(head) + 4) + (data if audio else F.lit(0))
        held = F.when(data <= _AUDIO, data).otherwise(0) if audio else F.lit(0)
        return F.concat(
            name, _little_endian(size), F.lit(head), _little_endian(data),
            F.repeat(F.lit("a"), held.cast("int")).cast("binary"),
        )

    content = build(7)
    for n in (8, 6, 5, 4, 3, 2, 1, 0):
        content = F.when(kind == n, build(n)).otherwise(content)
    return t.base("events").select(
        F.concat(F.lit("call_"), "event_id").alias("stem"), content.alias("content")
    ).select(
        F.concat(F.lit("/calls/"), "stem", F.lit(".wav")).alias("path"),
        F.concat("stem", F.lit(".wav")).alias("name"), "stem",
        F.octet_length("content").cast("bigint").alias("length"), "content",
    )


_VERDICT = """CASE event_id % 9 WHEN 0 THEN 'empty_file' WHEN 1 THEN 'invalid_signature'
  WHEN 2 THEN 'invalid_container' WHEN 3 THEN 'unsupported_channels'
  WHEN 4 THEN 'unsupported_width' WHEN 5 THEN 'no_audio' WHEN 6 THEN 'too_long' END"""
# frames that a recording declares and does not hold make it an invalid container
_CUT = f"""event_id % 9 IN (3, 4, 7, 8) AND (user_id * 100 + event_id % 977 + 1)
    * CASE event_id % 9 WHEN 3 THEN 6 WHEN 4 THEN 5 WHEN 7 THEN 2 ELSE 4 END > {_AUDIO}"""


@query("wav_validate", f"""
SELECT 'call_' || event_id || '.wav' AS name,
  CASE WHEN {_CUT} THEN 'invalid_container' ELSE {_VERDICT} END AS error_code,
  CASE WHEN event_id % 9 IN (7, 8) AND NOT ({_CUT})
    THEN {half_even('(user_id * 100 + event_id % 977 + 1) * 100', '8000')} END AS duration_cs,
  CASE WHEN {_CUT} THEN NULL WHEN event_id % 9 = 8 THEN 2 WHEN event_id % 9 = 7 THEN 1 END
    AS channels
FROM events""")
def wav_validate(t: Tables) -> DataFrame:
    return files.validate_wav(recordings(t, audio=True)).select(
        "name", "error_code", (F.col("duration_seconds") * 100).cast("bigint").alias("duration_cs"),
        F.when(F.col("error_code").isNull(), F.col("channels")).alias("channels"),
    )


@query("scan_calls_wav", f"""
, v AS (SELECT event_id, {_VERDICT} AS error_code, event_id % 9 AS kind,
    user_id * 100 + event_id % 977 AS n FROM events)
, f AS (SELECT *, CASE kind WHEN 0 THEN '0' WHEN 1 THEN '1:' || n WHEN 2 THEN '2'
    WHEN 5 THEN '5' WHEN 6 THEN '6' ELSE kind || ':' || n END AS same FROM v)
SELECT 'unusable recording' AS problem, count(*) AS problems FROM v
WHERE error_code IS NOT NULL AND kind NOT IN (3, 4)
UNION ALL SELECT 'duplicate recording', count(*) FROM (
  SELECT same FROM f WHERE kind <> 0 GROUP BY same HAVING count(*) > 1)""")
def scan_calls_wav(t: Tables) -> DataFrame:
    problems = files.call_problems(files.validate_wav(recordings(t), whole=False))
    return problems.groupBy("problem").agg(F.count("*").alias("problems"))


@query("snapshot_manifest", """, listing AS (
  SELECT 'doc-' || doc_id || '.wav' AS name, sha256(text) AS checksum FROM documents
), grouped AS (
  SELECT left(sha256(name), 4) AS part, sha256('[' || string_agg('["' || name || '","' || checksum
    || '"]', ',' ORDER BY name) || ']') AS hash FROM listing GROUP BY 1
), calls AS (
  SELECT sha256(string_agg(part || ':' || hash, ',' ORDER BY part)) AS checksum FROM grouped
), sources AS (
  SELECT lang || '.csv' AS name, sha256(cast(count(*) AS varchar)) AS checksum FROM documents
  GROUP BY lang UNION ALL SELECT 'call_recordings', checksum FROM calls)
SELECT 'v1' AS version, sha256('{"sources": [' || string_agg('["' || name || '", "' || checksum
  || '"]', ', ' ORDER BY name) || '], "version": "v1"}') AS manifest_checksum FROM sources""")
def snapshot_manifest(t: Tables) -> DataFrame:
    """One source per language, and every document as a recording."""
    documents = t.base("documents")
    sources = documents.groupBy("lang").agg(F.count("*").cast("string").alias("n")).select(
        F.concat("lang", F.lit(".csv")).alias("name"), F.sha2("n", 256).alias("checksum")
    )
    calls = documents.select(
        F.concat(F.lit("doc-"), "doc_id", F.lit(".wav")).alias("name"),
        F.sha2("text", 256).alias("checksum"),
    )
    return files.snapshot_manifest(sources, calls, "v1")


# -- snapshots and batches ---------------------------------------------------------------------------


@query("snapshot_conflict", """, new AS (
  SELECT DISTINCT 'v' || user_id AS version, 'c' || event_id % 3 AS manifest_checksum FROM events
), existing AS (
  SELECT DISTINCT 'v' || user_id AS version, 'c' || event_id % 2 AS manifest_checksum,
    user_id % 4 <> 0 AS imported FROM events WHERE user_id % 3 = 0)
SELECT n.version, n.manifest_checksum, CASE
  WHEN EXISTS (SELECT 1 FROM existing e WHERE e.version = n.version AND e.imported
    AND e.manifest_checksum <> n.manifest_checksum) THEN 'reject'
  WHEN EXISTS (SELECT 1 FROM existing e WHERE e.version = n.version
    AND e.manifest_checksum = n.manifest_checksum) THEN 'reuse' ELSE 'create' END AS decision
FROM new n""")
def snapshot_conflict(t: Tables) -> DataFrame:
    events = t.base("events")
    version = F.concat(F.lit("v"), "user_id").alias("version")
    check = lambda n: F.concat(F.lit("c"), F.col("event_id") % n).alias("manifest_checksum")
    new = events.select(version, check(3)).distinct()
    existing = events.where("user_id % 3 = 0").select(
        version, check(2), F.when(F.col("user_id") % 4 != 0, F.lit(1)).alias("imported_at")
    ).distinct()
    return ingestion.resolve_snapshot(new, existing)


@query("snapshot_activate", """, e AS (
  SELECT 'snap-' || doc_id % 10 AS snapshot_id, 'email' AS channel, doc_id % 97 <> 0 AS content,
    doc_id % 101 <> 1 AS job, true AS stored FROM documents
  UNION ALL SELECT 'snap-' || (conv_id * 31 + turn) % 10, 'call', conv_id % 89 <> 3, true,
    conv_id % 83 <> 5 FROM conversations
), b AS (
  SELECT 'snap-' || o_orderkey % 10 AS snapshot_id,
    count(*) FILTER (WHERE o_orderkey % 10 IN (2, 3) AND o_orderstatus = 'P') AS incomplete_batches
  FROM orders GROUP BY 1
), g AS (
  SELECT snapshot_id, count(*) FILTER (WHERE NOT content) AS missing_content,
    count(*) FILTER (WHERE NOT job) AS missing_jobs,
    count(*) FILTER (WHERE channel = 'call' AND content AND NOT stored) AS missing_objects
  FROM e GROUP BY 1)
SELECT snapshot_id, incomplete_batches, coalesce(missing_content, 0) AS missing_content,
  coalesce(missing_jobs, 0) AS missing_jobs, coalesce(missing_objects, 0) AS missing_objects,
  incomplete_batches + coalesce(missing_content, 0) + coalesce(missing_jobs, 0)
    + coalesce(missing_objects, 0) = 0 AS can_activate
FROM b LEFT JOIN g USING (snapshot_id)""")
def snapshot_activate(t: Tables) -> DataFrame:
    snap = lambda c: F.concat(F.lit("snap-"), c).alias("snapshot_id")
    docs = t.base("documents").withColumn("event_id", F.concat(F.lit("e"), "doc_id"))
    spoken = t.base("conversations").withColumn(
        "event_id", F.concat_ws("-", F.lit("c"), "conv_id", "turn")
    )
    events = docs.select("event_id", snap(F.col("doc_id") % 10), F.lit("email").alias("channel"))
    events = events.unionByName(
        spoken.select(
            "event_id", snap((F.col("conv_id") * 31 + F.col("turn")) % 10),
            F.lit("call").alias("channel"),
        )
    )
    key = F.col("event_id").alias("storage_key")
    calls = spoken.where("conv_id % 89 <> 3").select("event_id", key)
    objects = spoken.where("conv_id % 83 <> 5").select(key)
    emails = docs.where("doc_id % 97 <> 0").select("event_id")
    jobs = docs.where("doc_id % 101 <> 1").select("event_id").unionByName(
        spoken.select("event_id")
    )
    late = (F.col("o_orderkey") % 10).isin(2, 3) & (F.col("o_orderstatus") == "P")
    batches = t.base("orders").select(
        snap(F.col("o_orderkey") % 10),
        F.when(late, "processing").otherwise("completed").alias("status"),
    )
    return ingestion.activation_check(batches, events, emails, calls, jobs, objects)


@query("import_upsert", """
SELECT carrier_id, company_name FROM carriers WHERE carrier_key % 3 <> 0""", ("carriers",))
def import_upsert(t: Tables) -> DataFrame:
    """A third of the carriers is there already; the rest arrives twice."""
    rows = t.carriers.select("snapshot_id", "carrier_id", "company_name", "carrier_key")
    target = rows.where("carrier_key % 3 = 0")
    added = ingestion.insert_new(target, rows.unionByName(rows), ["snapshot_id", "carrier_id"])
    return added.select("carrier_id", "company_name")


@query("import_batch_accounting", """, r AS (
  SELECT event_type AS source_type, event_id AS ordinal, CASE WHEN event_type <> 'view'
    AND user_id % 5 = 0 THEN 'failed' WHEN user_id % 2 = 0 THEN 'created' ELSE 'existing' END
    AS outcome FROM events
), x AS (
  SELECT source_type, string_agg('row ' || ordinal || ': ValueError', '; ' ORDER BY ordinal)
    AS error_summary
  FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY ordinal) AS n FROM r
    WHERE outcome = 'failed') WHERE n <= 20 GROUP BY 1)
SELECT r.source_type, count(*) AS records_seen,
  count(*) FILTER (WHERE outcome = 'created') AS records_created,
  count(*) FILTER (WHERE outcome = 'existing') AS records_existing,
  count(*) FILTER (WHERE outcome = 'failed') AS records_failed,
  coalesce(max(x.error_summary), '') AS error_summary,
  CASE WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'partially_failed'
    ELSE 'completed' END AS status
FROM r LEFT JOIN x USING (source_type) GROUP BY 1""")
def import_batch_accounting(t: Tables) -> DataFrame:
    failed = (F.col("event_type") != "view") & (F.col("user_id") % 5 == 0)
    results = t.base("events").select(
        F.col("event_type").alias("source_type"), F.col("event_id").alias("ordinal"),
        F.when(failed, "failed").when(F.col("user_id") % 2 == 0, "created").otherwise("existing")
        .alias("outcome"),
        F.lit("ValueError").alias("error"),
    )
    return ingestion.batch_stats(results)


@query("import_batch_rerun", """, r AS (
  SELECT event_type AS source_type, CASE
    WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'created'
    WHEN event_type <> 'view' AND user_id % 10 = 0 THEN 'failed' ELSE 'existing' END AS outcome
  FROM events)
SELECT source_type, count(*) AS records_seen,
  count(*) FILTER (WHERE outcome = 'created') AS records_created,
  count(*) FILTER (WHERE outcome = 'existing') AS records_existing,
  count(*) FILTER (WHERE outcome = 'failed') AS records_failed,
  CASE WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'partially_failed'
    ELSE 'completed' END AS status
FROM r GROUP BY 1""")
def import_batch_rerun(t: Tables) -> DataFrame:
    """A second run after that of ``import_batch_accounting``: the view batch was completed."""
    failed = (F.col("event_type") != "view") & (F.col("user_id") % 10 == 0)
    results = t.base("events").select(
        F.col("event_type").alias("source_type"), F.col("event_id").alias("ordinal"),
        F.when(failed, "failed").otherwise("existing").alias("outcome"),
        F.lit("ValueError").alias("error"),
    )
    # one row per source is read twice
    batches = durable(import_batch_accounting(t))
    return ingestion.rerun_batches(batches, results).drop("error_summary")


@query("write_tables", """
SELECT 'snap-' || carrier_key % 5 AS snapshot_id,
  count(*) * CASE WHEN carrier_key % 5 = 0 THEN 1 ELSE 2 END AS row_count,
  min(carrier_id) AS first_carrier
FROM carriers GROUP BY carrier_key % 5""", ("carriers",))
def write_tables(t: Tables) -> DataFrame:
    """Append the carriers twice, then replace one snapshot with itself read from the table."""
    root = scratch(t.spark)
    rows = t.carriers.select(
        "carrier_id", "company_name",
        F.concat(F.lit("snap-"), F.col("carrier_key") % 5).alias("snapshot_id"),
    )
    sinks.append(rows, root, "carrier")
    sinks.append(rows, root, "carrier")
    stored = sinks.load(t.spark, root, "carrier")
    sinks.replace_snapshot(
        stored.where("snapshot_id = 'snap-0'").distinct(), root, "carrier"
    )
    return sinks.load(t.spark, root, "carrier").groupBy("snapshot_id").agg(
        F.count("*").alias("row_count"), F.min("carrier_id").alias("first_carrier")
    )


# -- admission ------------------------------------------------------------------------------------


@query("email_submission_validate", r"""
SELECT doc_id, array_to_string([x FOR x IN [
  CASE WHEN doc_id % 13 = 0 THEN 'sender_name_too_long' END,
  CASE WHEN doc_id % 5 = 2 THEN 'sender_email_missing' END,
  CASE WHEN doc_id % 5 IN (1, 3) THEN 'sender_email_invalid' END,
  CASE WHEN doc_id % 11 = 0 THEN 'subject_control' END,
  CASE WHEN regexp_full_match(text, '\s*') THEN 'body_blank' END,
  CASE WHEN length(text) > 50000 THEN 'body_too_long' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN 'body_control' END,
  CASE WHEN doc_id % 17 = 0 THEN 'load_hint_too_long' END
] IF x IS NOT NULL], ',') AS errors FROM documents""")
def email_submission_validate(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 5
    rows = t.base("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 13 == 0, F.repeat(F.lit("n"), 256)).otherwise("Dana")
        .alias("sender_name"),
        F.when(kind == 0, " ok@host.example ").when(kind == 1, "bad address").when(kind == 2, " ")
        .when(kind == 3, "a@b").otherwise("x.y+z@sub.host.co").alias("sender_email"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("bell \x07 rings")).otherwise("plain")
        .alias("subject"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 17 == 0, F.repeat(F.lit("7"), 65))
        .alias("suspected_load_reference"),
        F.lit(None).cast("string").alias("suspected_carrier_identity"),
    )
    accepted, rejected = ingestion.validate_emails(rows)
    return accepted.select("doc_id", F.lit("").alias("errors")).unionByName(
        rejected.select("doc_id", joined("errors").alias("errors"))
    )


@query("ingest_invariants", """
SELECT event_id, CASE event_type
  WHEN 'view' THEN array_to_string([x FOR x IN [
    CASE WHEN event_id % 2 = 0 THEN 'import_batch_id' END,
    CASE WHEN event_id % 3 = 0 THEN 'external_source_id' END,
    CASE WHEN event_id % 5 = 0 THEN 'occurred_at' END,
    CASE WHEN event_id % 7 = 0 THEN 'dataset_snapshot_id' END,
    CASE WHEN event_id % 4 = 0 THEN 'dispatch_mode' END] IF x IS NOT NULL], ',')
  WHEN 'click' THEN array_to_string([x FOR x IN [
    CASE WHEN event_id % 3 <> 0 THEN 'requires_external_source_id' END,
    CASE WHEN event_id % 7 <> 0 THEN 'requires_dataset_snapshot_id' END] IF x IS NOT NULL], ',')
  WHEN 'signup' THEN array_to_string([x FOR x IN [
    CASE WHEN event_id % 3 <> 0 THEN 'requires_external_source_id' END,
    CASE WHEN event_id % 7 <> 0 THEN 'requires_dataset_snapshot_id' END] IF x IS NOT NULL], ',')
  ELSE 'unknown_origin' END AS problems FROM events""")
def ingest_invariants(t: Tables) -> DataFrame:
    every = lambda n: F.when(F.col("event_id") % n == 0, F.lit("given"))
    kind = F.col("event_type")
    rows = t.base("events").select(
        "event_id",
        F.when(kind == "view", "manual").when(kind == "click", "dataset")
        .when(kind == "signup", "simulation").when(kind == "error", "import").alias("origin"),
        every(2).alias("import_batch_id"), every(3).alias("external_source_id"),
        F.lit(None).cast("string").alias("source_metadata"), every(5).alias("occurred_at"),
        every(7).alias("dataset_snapshot_id"),
        F.when(F.col("event_id") % 4 == 0, "deferred").otherwise("immediate")
        .alias("dispatch_mode"),
        F.lit(None).cast("string").alias("storage_key"),
    )
    return ingestion.ingest_invariants(rows).select("event_id", joined("problems").alias("problems"))


@query("event_identity", """
SELECT stable_evidence_id, epoch_us(occurred_at) AS occurred_us FROM (
  SELECT CASE WHEN origin = 'manual' THEN 'email:manual:' || event_id
      ELSE 'email:' || external_source_id END AS stable_evidence_id,
    CASE WHEN origin = 'manual' THEN TIMESTAMP '2024-05-24 05:00:00'
      + INTERVAL 19 HOUR + INTERVAL (doc_id % 200) MINUTE ELSE occurred_at END AS occurred_at
  FROM emails)
UNION ALL SELECT 'call:CV' || transcript_id || '-' || sequence, NULL FROM segments""",
       ("emails", "segments"))
def event_identity(t: Tables) -> DataFrame:
    """Local zone five hours behind UTC; the as-of instant is already the next day in UTC."""
    minutes = F.expr("make_dt_interval(0, 0, cast(doc_id % 200 as int), 0)")
    emails = t.emails.select(
        "event_id", "origin", F.lit("email").alias("channel"), "external_source_id",
        F.col("occurred_at").alias("source_occurred_at"),
        (F.date_trunc("day", F.col("received_at")) + minutes).alias("received_at"),
    )
    calls = t.segments.select(
        F.concat_ws(":", "event_id", "sequence").alias("event_id"),
        F.lit("dataset").alias("origin"), F.lit("call").alias("channel"),
        F.concat(F.lit("CV"), "transcript_id", F.lit("-"), "sequence").alias("external_source_id"),
        F.lit("2024-01-01").cast("timestamp").alias("source_occurred_at"),
        F.lit("2024-01-01").cast("timestamp").alias("received_at"),
    )
    rows = ingestion.event_identity(
        emails.unionByName(calls), "2024-05-25 03:00:00", "-05:00"
    )
    return rows.select("stable_evidence_id", F.unix_micros("occurred_at").alias("occurred_us"))


@query("submission_dedupe", FINGERPRINTS + """, known AS (
  SELECT content_fingerprint, min('old:' || event_id) AS known FROM printed WHERE doc_id % 10 = 0
  GROUP BY 1
), ranked AS (
  SELECT *, first_value(event_id) OVER (PARTITION BY content_fingerprint
    ORDER BY received_at, event_id) AS first_id FROM printed)
SELECT r.event_id, coalesce(k.known, r.first_id) AS result_event_id,
  CASE WHEN k.known IS NULL AND r.first_id = r.event_id THEN 'created' ELSE 'existing' END
    AS outcome
FROM ranked r LEFT JOIN known k USING (content_fingerprint)""", ("emails",))
def submission_dedupe(t: Tables) -> DataFrame:
    printed = ingestion.with_fingerprint(t.emails)
    existing = printed.where("doc_id % 10 = 0").select(
        F.concat(F.lit("old:"), "event_id").alias("event_id"), "content_fingerprint"
    )
    incoming = printed.select(
        "event_id", "content_fingerprint", F.col("received_at").alias("submitted_at")
    )
    return ingestion.dedupe_submissions(incoming, existing).select(
        "event_id", "result_event_id", "outcome"
    )


@query("fingerprint_duplicates", FINGERPRINTS + """, g AS (
  SELECT content_fingerprint, count(*) AS group_size, min(event_id) AS first_id FROM printed
  GROUP BY 1 HAVING count(*) > 1)
SELECT event_id, content_fingerprint, group_size, first_id FROM printed
JOIN g USING (content_fingerprint)""", ("emails",))
def fingerprint_duplicates(t: Tables) -> DataFrame:
    return ingestion.dup_groups(ingestion.with_fingerprint(t.emails), "event_id")


@query("distinct_values", """
SELECT DISTINCT sender_email_raw, lang, source FROM emails""", ("emails",))
def distinct_values(t: Tables) -> DataFrame:
    return t.emails.select("sender_email_raw", "lang", "source").distinct()
