"""Admission of communications and source rows: validation, identity, duplicates, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions.text import (
    canonical_address, digits, email_fingerprint, nfkc, strip,
)
from brokerlake.operators.extraction import resolve_equipment

_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
_ADDRESS = (
    r"(?i)^[-!#$%&'*+/=?^_`{}|~0-9A-Z]+(\.[-!#$%&'*+/=?^_`{}|~0-9A-Z]+)*"
    r"@((localhost)|((?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+"
    r"(?:[A-Z0-9-]{2,63}(?<!-))))$"
)


# -- submitted emails ------------------------------------------------------------------------------


#: The largest number that the stored integers hold.
_INT = (1 << 31) - 1


def _named_problems(pairs: list[tuple[str, Column]]) -> Column:
    options = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in pairs])
    return F.filter(options, lambda p: p.isNotNull())


def email_errors() -> Column:
    """Problems of a submitted email, by name."""
    control = lambda c: F.col(c).rlike(_CONTROL)
    longer = lambda c, n: F.char_length(c) > n
    sender = strip(F.col("sender_email"))
    name, subject = strip(F.col("sender_name")), strip(F.col("subject"))
    load_hint = strip(F.col("suspected_load_reference"))
    carrier_hint = strip(F.col("suspected_carrier_identity"))
    no_body = F.coalesce(strip(F.col("body")) == "", F.lit(True))
    return _named_problems([
        ("sender_name_too_long", longer(name, vocab.MAX_SENDER_NAME)),
        ("sender_name_control", name.rlike(_CONTROL)),
        ("sender_email_missing", F.coalesce(sender == "", F.lit(True))),
        ("sender_email_invalid", (sender != "") & ~sender.rlike(_ADDRESS)),
        ("sender_email_too_long", longer(sender, vocab.MAX_SENDER_EMAIL)),
        ("subject_too_long", longer(subject, vocab.MAX_SUBJECT)),
        ("subject_control", subject.rlike(_CONTROL)),
        ("body_blank", no_body),
        ("body_too_long", longer(F.col("body"), vocab.MAX_BODY)),
        ("body_control", control("body")),
        ("load_hint_too_long", longer(load_hint, vocab.MAX_LOAD_HINT)),
        ("load_hint_control", load_hint.rlike(_CONTROL)),
        ("carrier_hint_too_long", longer(carrier_hint, vocab.MAX_CARRIER_HINT)),
        ("carrier_hint_control", carrier_hint.rlike(_CONTROL)),
    ])


def validate_emails(submitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry ``errors``."""
    checked = submitted.withColumn("errors", email_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def origin_problems() -> Column:
    """Trusted context a submission must not, or must, carry."""
    given = lambda c: F.col(c).isNotNull()
    manual = F.col("origin") == "manual"
    trusted = F.col("origin").isin("dataset", "simulation")
    known = F.coalesce(manual | trusted, F.lit(False))
    no_source = F.coalesce(F.length("external_source_id") == 0, F.lit(True))
    return _named_problems([
        ("import_batch_id", manual & given("import_batch_id")),
        ("external_source_id", manual & given("external_source_id")),
        ("source_metadata", manual & (F.length("source_metadata") > 0)),
        ("occurred_at", manual & given("occurred_at")),
        ("dataset_snapshot_id", manual & given("dataset_snapshot_id")),
        ("dispatch_mode", manual & (F.col("dispatch_mode") != "immediate")),
        ("storage_key", manual & given("storage_key")),
        ("requires_external_source_id", trusted & no_source),
        ("requires_dataset_snapshot_id", trusted & ~given("dataset_snapshot_id")),
        ("unknown_origin", ~known),
    ])


def ingest_invariants(submitted: DataFrame) -> DataFrame:
    return submitted.withColumn("problems", origin_problems())


# -- identity --------------------------------------------------------------------------------------


def event_identity(
    events: DataFrame, as_of: str, timezone: str
) -> DataFrame:
    """Add ``stable_evidence_id`` and the event's ``occurred_at``.

    A manual event happens on the snapshot's local date at the local time it was received;
    recordings of the dataset carry no reliable time.
    """
    local = F.from_utc_timestamp("received_at", timezone)
    day = F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), timezone).cast("date")
    since_midnight = local - F.date_trunc("day", local)
    demo = F.to_utc_timestamp(day.cast("timestamp") + since_midnight, timezone)
    manual = F.col("origin") == "manual"
    own_id = F.when(
        manual, F.concat_ws(":", "channel", F.lit("manual"), "event_id")
    ).otherwise(F.concat_ws(":", "channel", "external_source_id"))
    occurred = F.when(manual, demo).when(F.col("channel") == "email", F.col("source_occurred_at"))
    return events.withColumn("stable_evidence_id", own_id).withColumn("occurred_at", occurred)


def carrier_identity() -> Column:
    """Source identifier of a carrier row: first of MC, DOT, address and phone, else a row hash.

    Expects mc_number, dot_number, email, phone, ``row_json`` (key-sorted JSON of the row) and
    ``ordinal`` (its place in the source).
    """
    tagged = lambda tag, c: F.concat(F.lit(tag), c)
    address = F.when(F.length("email") > 0, canonical_address(F.col("email")))
    row = F.concat(nfkc(F.col("row_json")), F.lit("\x00"), F.col("ordinal").cast("string"))
    return F.coalesce(
        tagged("mc:", digits(F.col("mc_number"))),
        tagged("dot:", digits(F.col("dot_number"))),
        tagged("email:", address),
        tagged("phone:", digits(F.col("phone"))),
        tagged("rowhash:", F.substring(F.sha2(row, 256), 1, 24)),
    )


# -- duplicates --------------------------------------------------------------------------------------


def with_fingerprint(emails: DataFrame) -> DataFrame:
    return emails.withColumn(
        "content_fingerprint",
        email_fingerprint(F.col("sender_email_raw"), F.col("subject"), F.col("body_text")),
    )


def dedupe_submissions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of each submission: the first with its content is created, the rest exist.

    ``incoming``: event_id, content_fingerprint, submitted_at. ``existing``: event_id,
    content_fingerprint. The winner of each fingerprint is a minimum, combined map-side.
    """
    first = incoming.groupBy("content_fingerprint").agg(
        F.min(F.struct("submitted_at", "event_id")).getField("event_id").alias("_first")
    )
    known = existing.groupBy("content_fingerprint").agg(F.min("event_id").alias("_known"))
    winners = first.join(known, "content_fingerprint", "left").select(
        "content_fingerprint", F.coalesce("_known", "_first").alias("result_event_id"),
        F.col("_known").isNull().alias("_new"),
    )
    created = F.col("_new") & (F.col("event_id") == F.col("result_event_id"))
    return (
        incoming.join(winners, "content_fingerprint")
        .withColumn("outcome", F.when(created, "created").otherwise("existing"))
        .drop("_new")
    )


def dup_groups(rows: DataFrame, ident: str, fingerprint: str = "content_fingerprint") -> DataFrame:
    """Members of every fingerprint that occurs more than once, one row per member.

    Members are rows, not collected lists, so a group of any size stays distributed.
    """
    groups = rows.groupBy(fingerprint).agg(
        F.count("*").alias("group_size"), F.min(ident).alias("first_id")
    ).where("group_size > 1")
    return rows.select(fingerprint, ident).join(groups, fingerprint)


# -- snapshots and batches -----------------------------------------------------------------------------


def resolve_snapshot(new: DataFrame, existing: DataFrame) -> DataFrame:
    """reject, reuse or create for each (version, manifest_checksum)."""
    done = existing.where("imported_at IS NOT NULL").select(
        "version", F.col("manifest_checksum").alias("_other")
    )
    clash = (
        new.select("version", "manifest_checksum").join(done, "version")
        .where(F.col("_other") != F.col("manifest_checksum"))
        .select("version", "manifest_checksum").distinct().withColumn("_clash", F.lit(True))
    )
    same = existing.select("version", "manifest_checksum").distinct().withColumn(
        "_same", F.lit(True)
    )
    return (
        new.join(clash, ["version", "manifest_checksum"], "left")
        .join(same, ["version", "manifest_checksum"], "left")
        .withColumn(
            "decision",
            F.when(F.col("_clash"), "reject").when(F.col("_same"), "reuse").otherwise("create"),
        )
        .drop("_clash", "_same")
    )


def activation_check(
    batches: DataFrame, events: DataFrame, emails: DataFrame, calls: DataFrame, jobs: DataFrame,
    objects: DataFrame,
) -> DataFrame:
    """Per snapshot: what still blocks activation, and whether it may be activated."""
    has = lambda df, key, flag: df.select(key).distinct().withColumn(flag, F.lit(True))
    open_batches = batches.groupBy("snapshot_id").agg(
        F.count_if(F.col("status") != "completed").alias("incomplete_batches")
    )
    stored = has(objects, "storage_key", "_object")
    recorded = calls.select("event_id", "storage_key").join(stored, "storage_key", "left").groupBy(
        "event_id"
    ).agg(F.lit(True).alias("_call"), F.bool_or(F.coalesce("_object", F.lit(False))).alias("_object"))
    rows = (
        events.join(has(emails, "event_id", "_email"), "event_id", "left")
        .join(recorded, "event_id", "left")
        .join(has(jobs, "event_id", "_job"), "event_id", "left")
    )
    got = lambda c: F.coalesce(c, F.lit(False))
    is_call = F.col("channel") == "call"
    content = F.when(is_call, got("_call")).otherwise(got("_email"))
    gaps = rows.groupBy("snapshot_id").agg(
        F.count_if(~content).alias("missing_content"),
        F.count_if(~got("_job")).alias("missing_jobs"),
        F.count_if(is_call & got("_call") & ~got("_object")).alias("missing_objects"),
    )
    zero = ["incomplete_batches", "missing_content", "missing_jobs", "missing_objects"]
    return (
        open_batches.join(gaps, "snapshot_id", "full").fillna(0, zero)
        .withColumn("can_activate", F.expr(" + ".join(zero) + " = 0"))
    )


def insert_new(
    target: DataFrame, incoming: DataFrame, keys: list[str], first_by: tuple[str, ...] = ()
) -> DataFrame:
    """Rows to append: natural keys the target does not have yet, each once.

    Of several incoming rows with one key the first by ``first_by`` (then by value) is taken, so
    a repeated run picks the same one.
    """
    rest = [c for c in incoming.columns if c not in keys and c not in first_by]
    chosen = F.min(F.struct(*first_by, *rest)).alias("_row")
    first = incoming.groupBy(*keys).agg(chosen).select(*keys, "_row.*")
    return first.join(target.select(*keys).distinct(), keys, "left_anti").select(
        *incoming.columns
    )


def open_rows(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows of sources whose batch is not completed yet; a completed batch is never run again."""
    done = batches.where("status = 'completed'").select("source_type").distinct()
    return rows.join(done, "source_type", "left_anti")


def rerun_batches(batches: DataFrame, results: DataFrame) -> DataFrame:
    """The batches after another run: completed ones and those without rows stay, others are
    replaced by what ``results`` (as in ``batch_stats``) says. Sources are few, one row each."""
    again = batch_stats(open_rows(results, batches))
    kept = batches.join(again.select("source_type"), "source_type", "left_anti")
    return kept.unionByName(again)


def batch_stats(results: DataFrame) -> DataFrame:
    """Per source: seen, created, existing, failed, status and the first 20 errors.

    ``results``: source_type, ordinal, outcome (created, existing, failed), error. The twenty
    earliest failures are found by a per-source limit before anything is collected.
    """
    counted = results.groupBy("source_type").agg(
        F.count("*").alias("records_seen"),
        *[F.count_if(F.col("outcome") == o).alias(f"records_{o}")
          for o in ("created", "existing", "failed")],
    )
    first = Window.partitionBy("source_type").orderBy("ordinal")
    listed = (
        results.where("outcome = 'failed'")
        .withColumn("_n", F.row_number().over(first)).where("_n <= 20")
        .withColumn("_line", F.concat(F.lit("row "), F.col("ordinal").cast("string"), F.lit(": "),
                                      F.col("error")))
        .groupBy("source_type")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_lines"))
        .select(
            "source_type",
            F.array_join(F.transform("_lines", lambda x: x["_line"]), "; ").alias("error_summary"),
        )
    )
    return (
        counted.join(listed, "source_type", "left")
        .withColumn("error_summary", F.coalesce("error_summary", F.lit("")))
        .withColumn(
            "status",
            F.when(F.col("records_failed") > 0, "partially_failed").otherwise("completed"),
        )
    )


# -- source rows to typed tables --------------------------------------------------------------------


def optional_int(raw: Column) -> tuple[Column, Column]:
    """(value, unparsable): blank is unknown; anything but an integer rejects the row."""
    blank = raw.isNull() | (raw == "")
    value = F.when(~blank & raw.rlike(r"^\s*[+-]?[0-9]+(_?[0-9]+)*\s*$"),
                   F.replace(strip(raw), F.lit("_")).try_cast("bigint"))
    return value, ~blank & value.isNull()


def optional_decimal(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, unusable): blank is unknown; no number, or one beyond ``kind``, rejects the row."""
    blank = raw.isNull() | (raw == "")
    value = F.when(~blank, strip(raw).try_cast("decimal(38,10)")).try_cast(kind)
    return value, ~blank & value.isNull()


def lane_state(raw: Column) -> Column:
    return F.upper(strip(raw))


def explode_lanes(carriers: DataFrame) -> DataFrame:
    """Preferred lanes "PA-NJ" as rows; anything but two parts is dropped, repeats too."""
    lanes = carriers.select("carrier_id", F.explode("preferred_lanes").alias("_lane"))
    parts = F.split("_lane", "-")
    return (
        lanes.where(F.size(parts) == 2)
        .select("carrier_id", lane_state(parts[0]).alias("origin_state"),
                lane_state(parts[1]).alias("destination_state"))
        .distinct()
    )


def explode_equipment(carriers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Equipment labels as codes; unknown labels are dropped, repeats too."""
    labels = carriers.select("carrier_id", F.explode("equipment_types").alias("label"))
    types = aliases.select(F.col("equipment_code").alias("code"))
    resolved = resolve_equipment(labels, "label", aliases, types, source="dataset")
    return resolved.where("equipment_code IS NOT NULL").select(
        "carrier_id", "equipment_code"
    ).distinct()


def pickup_window(raw: Column, day: Column, timezone: Column) -> list[Column]:
    """(pickup_window_status, pickup_start_at, pickup_end_at); the ends are UTC instants."""
    text = strip(raw)
    range_of = r"^([0-9]{1,2}):([0-9]{2})\s*-\s*([0-9]{1,2}):([0-9]{2})$"
    single = r"^([0-9]{1,2}):([0-9]{2})$"
    is_range, is_single = text.rlike(range_of), text.rlike(single)
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    h1 = F.when(is_range, part(range_of, 1)).when(is_single, part(single, 1))
    m1 = F.when(is_range, part(range_of, 2)).when(is_single, part(single, 2))
    h2 = F.when(is_range, part(range_of, 3)).when(is_single, h1)
    m2 = F.when(is_range, part(range_of, 4)).when(is_single, m1)
    fits = (h1 <= 23) & (m1 <= 59) & (h2 <= 23) & (m2 <= 59) & (h1 * 60 + m1 <= h2 * 60 + m2)
    status = (
        F.when(text.isNull() | (text == ""), "missing")
        .when(is_range, F.when(fits, "range").otherwise("invalid"))
        .when(is_single, F.when(fits, "single_time").otherwise("invalid"))
        .otherwise("qualitative")
    )
    timed = (is_range | is_single) & fits

    def at(hour: Column, minute: Column) -> Column:
        local = F.try_make_timestamp_ntz(
            F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0)
        ).cast("timestamp")
        return F.when(timed, F.to_utc_timestamp(local, timezone))

    return [
        status.alias("pickup_window_status"),
        at(h1, m1).alias("pickup_start_at"), at(h2, m2).alias("pickup_end_at"),
    ]


def aware_timestamp(raw: Column) -> Column:
    """ISO-8601 instant with an explicit zone; anything else is NULL."""
    zoned = raw.rlike(r"[0-9](Z|[+-][0-9]{2}(:?[0-9]{2})?(:[0-9]{2})?)$")
    return F.when(zoned, raw.try_cast("timestamp"))


def import_loads(raw: DataFrame, aliases: DataFrame, snapshot_id: str, timezone: str):
    """(loads, rejected) from the all-text source rows."""
    day = F.try_to_date("pickup_date", "yyyy-MM-dd")
    delivery = F.try_to_date("delivery_date", "yyyy-MM-dd")
    given_delivery = F.coalesce(F.length("delivery_date") > 0, F.lit(False))
    miles, bad_miles = optional_int(F.col("distance_miles"))
    weight, bad_weight = optional_int(F.col("weight_lbs"))
    rate, bad_rate = optional_decimal(F.col("offered_rate_usd"), "decimal(10,2)")
    problems = _named_problems([
        ("pickup_date", day.isNull()),
        ("delivery_date", given_delivery & delivery.isNull()),
        ("distance_miles", bad_miles | (miles <= 0) | (miles > _INT)),
        ("weight_lbs", bad_weight | (weight < 0) | (weight > _INT)),
        ("offered_rate_usd", bad_rate | (rate < 0)),
    ])
    types = aliases.select(F.col("equipment_code").alias("code"))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    checked = resolve_equipment(
        raw.withColumn("problems", problems), "equipment_type", aliases, types, source="dataset"
    )
    loads = checked.where(F.size("problems") == 0).select(
        F.lit(snapshot_id).alias("snapshot_id"), "load_id", "status", "origin_city",
        lane_state(F.col("origin_state")).alias("origin_state"),
        filled("origin_zip").alias("origin_zip"), "destination_city",
        lane_state(F.col("destination_state")).alias("destination_state"),
        filled("destination_zip").alias("destination_zip"),
        miles.try_cast("int").alias("distance_miles"), "equipment_code",
        filled("equipment_type").alias("equipment_raw"), weight.try_cast("int").alias("weight_lbs"),
        day.alias("pickup_date"), filled("pickup_window").alias("pickup_window_raw"),
        *pickup_window(F.col("pickup_window"), day, F.lit(timezone)),
        delivery.alias("delivery_date"), rate.alias("offered_rate_usd"),
        filled("shipper_name").alias("shipper_name"),
        F.coalesce("internal_notes", F.lit("")).alias("internal_notes"),
    )
    return loads, checked.where(F.size("problems") > 0)


def import_rates(raw: DataFrame, aliases: DataFrame, snapshot_id: str):
    """(market rates, rejected) from the all-text source rows; unknown equipment rejects."""
    types = aliases.select(F.col("equipment_code").alias("code"))
    rows = resolve_equipment(raw, "equipment_type", aliases, types, source="dataset")
    week = F.try_to_date("week_start", "yyyy-MM-dd")
    money = {c: strip(F.col(f"{c}_rate_per_mile")).try_cast("decimal(8,2)")
             for c in ("avg", "min", "max")}
    volume, bad_volume = optional_int(F.col("load_volume"))
    problems = _named_problems([
        ("equipment_type", F.col("equipment_code").isNull()),
        ("week_start", week.isNull()),
        *[(f"{c}_rate_per_mile", v.isNull()) for c, v in money.items()],
        ("band_ordering", (money["min"] > money["avg"]) | (money["avg"] > money["max"])),
        ("load_volume", bad_volume | volume.isNull() | (volume < 0) | (volume > _INT)),
    ])
    checked = rows.withColumn("problems", problems)
    rates = checked.where(F.size("problems") == 0).select(
        F.lit(snapshot_id).alias("snapshot_id"), week.alias("week_start"),
        lane_state(F.col("origin_state")).alias("origin_state"),
        lane_state(F.col("destination_state")).alias("destination_state"), "equipment_code",
        money["avg"].alias("average_rate_per_mile"), money["min"].alias("minimum_rate_per_mile"),
        money["max"].alias("maximum_rate_per_mile"), volume.try_cast("int").alias("load_volume"),
    )
    return rates, checked.where(F.size("problems") > 0)
