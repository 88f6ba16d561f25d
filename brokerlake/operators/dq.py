"""Declared rules checked on whole tables: unique, conditional unique, check, foreign key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab


@dataclass(frozen=True)
class Rule:
    table: str
    name: str
    kind: str  # unique | check | reference
    columns: tuple[str, ...] = ()
    condition: str | None = None  # rows the rule applies to, or the check itself
    target: str | None = None


def unique(table: str, name: str, *columns: str, where: str | None = None) -> Rule:
    return Rule(table, name, "unique", columns, where)


def check(table: str, name: str, condition: str) -> Rule:
    return Rule(table, name, "check", (), condition)


def reference(table: str, column: str, target: str, target_column: str | None = None) -> Rule:
    return Rule(table, f"{table}_{column}_fk", "reference", (column, target_column or column),
                None, target)


def _one_of(column: str, options) -> str:
    return f"{column} IN ({', '.join(repr(o) for o in options)})"


_RESULTS = [
    f"{c}_result" for c in ("authority", "safety", "insurance", "identity", "equipment",
                            "availability", "onboarding")
]

RULES: tuple[Rule, ...] = (
    unique("dataset_snapshot", "one_active_snapshot", "is_active", where="is_active"),
    unique("dataset_snapshot", "snapshot_version_checksum", "version", "manifest_checksum"),
    unique("import_batch", "batch_identity", "snapshot_id", "source_type", "source_filename",
           "content_checksum"),
    unique("equipment_type", "equipment_code", "code"),
    unique("equipment_alias", "alias_label", "source", "normalized_label"),
    unique("lane", "directional_lane", "origin_state", "destination_state"),
    unique("load", "load_external_id", "snapshot_id", "load_id"),
    check("load", "distance_positive", "distance_miles > 0"),
    check("load", "weight_non_negative", "weight_lbs >= 0"),
    check("load", "rate_non_negative", "offered_rate_usd >= 0"),
    unique("carrier", "carrier_source_id", "snapshot_id", "carrier_id"),
    unique("carrier", "carrier_mc", "snapshot_id", "mc_number_normalized",
           where="mc_number_normalized IS NOT NULL"),
    unique("carrier", "carrier_dot", "snapshot_id", "dot_number_normalized",
           where="dot_number_normalized IS NOT NULL"),
    check("carrier", "reliability_scale", "reliability_score BETWEEN 0 AND 5"),
    check("carrier", "loads_completed_non_negative", "loads_completed >= 0"),
    unique("carrier_contact", "one_primary_contact", "carrier_id", where="is_primary"),
    unique("carrier_equipment", "carrier_equipment_link", "carrier_id", "equipment_code"),
    unique("carrier_preferred_lane", "carrier_lane_link", "carrier_id", "origin_state",
           "destination_state"),
    unique("market_rate_history", "market_week", "snapshot_id", "week_start", "origin_state",
           "destination_state", "equipment_code"),
    check("market_rate_history", "band_ordering",
          "minimum_rate_per_mile <= average_rate_per_mile"
          " AND average_rate_per_mile <= maximum_rate_per_mile"),
    check("market_rate_history", "volume_non_negative", "load_volume >= 0"),
    unique("communication_event", "event_evidence_id", "stable_evidence_id"),
    unique("communication_event", "event_fingerprint", "content_fingerprint"),
    unique("communication_event", "dataset_source_id", "snapshot_id", "external_source_id",
           where="origin = 'dataset' AND external_source_id IS NOT NULL"),
    unique("email_content", "one_email_per_event", "event_id"),
    unique("call_recording", "one_recording_per_event", "event_id"),
    unique("call_recording", "storage_key", "storage_key"),
    unique("ingestion_job", "one_job_per_event", "event_id"),
    check("ingestion_job", "job_status_vocab", _one_of("status", vocab.JOB_STATUS)),
    unique("transcript", "one_current_transcript", "recording_id", where="is_current"),
    unique("transcript_segment", "segment_sequence", "transcript_id", "sequence"),
    unique("extraction_run", "one_current_extraction", "event_id", where="is_current"),
    unique("inquiry", "inquiry_sequence", "event_id", "sequence_number"),
    check("inquiry", "review_status_vocab", _one_of("review_status", vocab.REVIEW_STATUS)),
    unique("inquiry_intent", "intent_once", "inquiry_id", "intent"),
    unique("inquiry_intent", "one_primary_intent", "inquiry_id", where="is_primary"),
    check("evidence_span", "span_shape",
          "(source_part IN ('subject', 'body') AND start_offset IS NOT NULL"
          " AND end_offset IS NOT NULL AND start_seconds IS NULL AND end_seconds IS NULL"
          " AND segment_sequence IS NULL)"
          " OR (source_part = 'transcript' AND start_seconds IS NOT NULL"
          " AND end_seconds IS NOT NULL AND start_offset IS NULL AND end_offset IS NULL)"),
    check("evidence_span", "span_ordering",
          "(start_offset IS NULL OR end_offset >= start_offset)"
          " AND (start_seconds IS NULL OR end_seconds >= start_seconds)"),
    unique("evidence_span", "span_stable_id", "event_id", "span_id"),
    unique("inquiry_field_assessment", "one_current_assessment", "inquiry_id", "field_name",
           where="is_current"),
    check("carrier_quote", "amount_non_negative", "amount >= 0"),
    unique("inquiry_carrier_match", "carrier_proposed_once", "inquiry_id", "carrier_id"),
    unique("inquiry_carrier_match", "one_selected_carrier", "inquiry_id", where="is_selected"),
    unique("inquiry_load_match", "load_proposed_once", "inquiry_id", "load_id"),
    unique("inquiry_load_match", "one_selected_load", "inquiry_id", where="is_selected"),
    unique("carrier_load_candidate", "candidate_pair", "carrier_id", "load_id"),
    unique("candidate_inquiry", "candidate_link", "candidate_id", "inquiry_id"),
    check("compliance_assessment", "compliance_vocab",
          " AND ".join(_one_of(c, vocab.COMPONENT_RESULTS) for c in _RESULTS[:3])
          + " AND compliance_result IN ('pass', 'fail', 'needs_review')"),
    check("eligibility_assessment", "eligibility_vocab",
          " AND ".join(_one_of(c, vocab.COMPONENT_RESULTS) for c in _RESULTS[3:])
          + " AND " + _one_of("final_status", vocab.FINAL_STATUS)),
    unique("ai_provider_call", "call_sequence", "operation_id", "sequence"),
    unique("evaluation_case_result", "case_once", "run_id", "case_id"),
    unique("evaluation_score", "metric_once", "case_result_id", "metric"),
    unique("assistant_message", "message_sequence", "conversation_id", "sequence"),
    unique("tool_execution", "tool_sequence", "run_id", "sequence"),
    unique("draft_evidence_link", "draft_fact_once", "draft_id", "fact"),
    unique("assistant_citation", "citation_once", "message_id", "source_id", "claim"),
    reference("carrier_contact", "carrier_id", "carrier"),
    reference("inquiry", "load_id", "load"),
    reference("inquiry", "carrier_id", "carrier"),
    reference("carrier_quote", "inquiry_id", "inquiry"),
    reference("transcript_segment", "transcript_id", "transcript"),
    reference("ingestion_job", "event_id", "communication_event"),
)


# --- fixed values: further references between tables, as "table.column target[.column]" ---
_REFERENCES = """
import_batch.snapshot_id dataset_snapshot
equipment_alias.equipment_code equipment_type.code
load.snapshot_id dataset_snapshot
load.equipment_code equipment_type.code
carrier.snapshot_id dataset_snapshot
carrier_equipment.carrier_id carrier
carrier_equipment.equipment_code equipment_type.code
carrier_preferred_lane.carrier_id carrier
market_rate_history.snapshot_id dataset_snapshot
market_rate_history.equipment_code equipment_type.code
communication_event.snapshot_id dataset_snapshot
email_content.event_id communication_event
call_recording.event_id communication_event
ingestion_job.snapshot_id dataset_snapshot
transcript.recording_id call_recording
transcript.operation_id ai_operation
extraction_run.event_id communication_event
extraction_run.job_id ingestion_job
extraction_run.transcript_id transcript
extraction_run.operation_id ai_operation
inquiry.event_id communication_event
inquiry.equipment_code equipment_type.code
inquiry_intent.inquiry_id inquiry
inquiry_question.inquiry_id inquiry
evidence_span.event_id communication_event
inquiry_field_assessment.inquiry_id inquiry
inquiry_carrier_match.inquiry_id inquiry
inquiry_carrier_match.carrier_id carrier
inquiry_load_match.inquiry_id inquiry
inquiry_load_match.load_id load
inquiry_review_reason.inquiry_id inquiry
inquiry_review_action.inquiry_id inquiry
carrier_load_candidate.carrier_id carrier
carrier_load_candidate.load_id load
candidate_inquiry.candidate_id carrier_load_candidate
candidate_inquiry.inquiry_id inquiry
compliance_assessment.candidate_id carrier_load_candidate
eligibility_assessment.candidate_id carrier_load_candidate
ai_provider_call.operation_id ai_operation
evaluation_case_result.run_id evaluation_run
evaluation_case_result.operation_id ai_operation
evaluation_score.case_result_id evaluation_case_result
"""


def _declared(line: str) -> Rule:
    source, target = line.split()
    table, column = source.split(".")
    target, _, target_column = target.partition(".")
    return reference(table, column, target, target_column or None)


REFERENCES: tuple[Rule, ...] = tuple(map(_declared, _REFERENCES.split("\n")[1:-1]))


def rule_violations(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (or keys) that break one rule."""
    df = tables[rule.table]
    if rule.kind == "check":
        # as in SQL, an unknown outcome passes
        return df.where(~F.coalesce(F.expr(rule.condition), F.lit(True)))
    if rule.kind == "unique":
        applies = df if rule.condition is None else df.where(rule.condition)
        keyed = applies.where(" AND ".join(f"{c} IS NOT NULL" for c in rule.columns))
        return keyed.groupBy(*rule.columns).agg(F.count("*").alias("n")).where("n > 1")
    column, target_column = rule.columns
    known = tables[rule.target].select(F.col(target_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def covered_by(tables: dict[str, DataFrame], rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules whose tables are given."""
    return [r for r in rules if r.table in tables and (r.target is None or r.target in tables)]


def _key(columns: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether a row has the key, and the key as texts."""
    given = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    return given, F.array(*[F.col(c).cast("string") for c in columns])


def _places(usable: list[Rule]) -> list[tuple[int, int]]:
    """(group, slot) of each rule. References to one column are one group, in which each has a slot
    for its count, so that the column states its keys once for all of them."""
    groups: dict = {}
    places = []
    for number, rule in enumerate(usable):
        slots = groups.setdefault((rule.target, rule.columns[1:]) if rule.target else number, [])
        slots.append(number)
        places.append((list(groups.values()).index(slots), len(slots) - 1))
    return places


def _fact(place: tuple[int, int | None], width: int, when: Column, key: Column) -> Column:
    """One row counted in its slot, or, without a slot, a key that is known."""
    group, slot = place
    fact = F.struct(
        F.lit(group).alias("group"), key.alias("key"),
        *[F.lit(int(i == slot)).cast("long").alias(f"n{i}") for i in range(width)],
        F.lit(slot is None).alias("known"),
    )
    return F.when(when, fact)


def _facts(table: str, usable: list[Rule], places: list[tuple[int, int]], width: int) -> list[Column]:
    """What one row of ``table`` says to each rule, NULL where it says nothing."""
    facts, stated = [], set()
    for rule, place in zip(usable, places):
        if rule.table == table and rule.kind == "check":
            # as in SQL, an unknown outcome passes
            broken = ~F.coalesce(F.expr(rule.condition), F.lit(True))
            facts.append(_fact(place, width, broken, F.lit(None).cast("array<string>")))
        elif rule.table == table:
            given, key = _key(rule.columns[:1] if rule.kind == "reference" else rule.columns)
            applies = F.lit(True) if rule.condition is None else F.expr(rule.condition)
            facts.append(_fact(place, width, given & applies, key))
        if rule.target == table and place[0] not in stated:
            stated.add(place[0])
            given, key = _key(rule.columns[1:])
            facts.append(_fact((place[0], None), width, given, key))
    return facts


def violations(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Violation count of every rule whose table (and target) is given.

    Each table is read once, for all rules on it and all references to it: a row states its key to
    each rule, and once to all references to one column; one grouping by (group, key) counts the rows
    of each rule and tells whether the key is known at the target. Rows of one key are added up before the exchange, so a hot key is a few rows there. A
    broken check counts rows, a unique rule counts keys, a reference counts rows whose key is
    nowhere. Rows with a NULL in the key state nothing; empty tables break no rule. Keys are
    compared as texts, so both ends of a reference must be of kinds that print alike.
    """
    usable = covered_by(tables, rules)
    places = _places(usable)
    width = 1 + max((slot for _, slot in places), default=0)
    named = ((name, _facts(name, usable, places, width)) for name in sorted(tables))
    stated = [
        tables[name].select(F.inline(F.array_compact(F.array(*facts)))) for name, facts in named if facts
    ]
    listed = next(iter(tables.values())).sparkSession.createDataFrame(
        [(*place, r.table, r.name) for place, r in zip(places, usable)],
        "group int, slot int, table_name string, name string",
    )
    if not stated:
        return listed.select("table_name", F.col("name").alias("rule"), F.lit(0).cast("long").alias("violations"))
    slots = [f"n{i}" for i in range(width)]
    by_key = reduce(DataFrame.unionByName, stated).groupBy("group", "key").agg(
        *[F.sum(n).alias(n) for n in slots], F.max("known").alias("known")
    )
    keyed = [group for (group, _), r in zip(places, usable) if r.kind == "unique"]
    broken = [
        F.when(F.col("group").isin(keyed), (F.col(n) > 1).cast("long")).when(~F.col("known"), F.col(n))
        for n in slots
    ]
    sums = by_key.groupBy("group").agg(*[F.sum(b).alias(n) for b, n in zip(broken, slots)])
    counts = sums.select("group", F.posexplode(F.array(*slots)).alias("slot", "violations"))
    return listed.join(counts, ["group", "slot"], "left").select(
        "table_name", F.col("name").alias("rule"), F.coalesce("violations", F.lit(0)).alias("violations")
    )
