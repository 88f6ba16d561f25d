"""Carrier-for-load candidates: current facts, policy, eligibility, reasons and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.operators import rates
from brokerlake.scale import AT_HAND, at_hand, nulls_last_key, positions, stored

CANDIDATE = ["load_id", "carrier_id"]


def candidate_id() -> Column:
    return F.concat_ws("|", "load_id", "carrier_id")


def seen_at() -> Column:
    return F.coalesce(F.col("occurred_at"), F.col("received_at"))


# -- latest explicit value -----------------------------------------------------------------


def latest_explicit_aggs(
    name: str, value: Column, time: Column, counted: Column, high: Column | None = None
) -> dict[str, Column]:
    """Partial aggregates, by name, from which ``latest_explicit_result`` decides value and conflict.

    Minima and maxima only: they combine map-side, need no group in one place, and a row that
    appears twice does not matter. A row that stands for several values has their lowest in
    ``value`` and their highest in ``high``.
    """
    high = value if high is None else high
    dated = counted & time.isNotNull()
    newest_first = F.struct((-F.unix_micros(time)).alias("age"), value.alias("v"))
    newest_last = F.struct(F.unix_micros(time).alias("age"), high.alias("v"))
    return {
        f"_{name}_lo": F.min(F.when(counted, value)),
        f"_{name}_hi": F.max(F.when(counted, high)),
        f"_{name}_undated": F.bool_or(counted & time.isNull()),
        f"_{name}_last_lo": F.min(F.when(dated, newest_first)),
        f"_{name}_last_hi": F.max(F.when(dated, newest_last)),
    }


def named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def latest_explicit_result(name: str) -> tuple[Column, Column]:
    low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
    last_low, last_high = F.col(f"_{name}_last_lo.v"), F.col(f"_{name}_last_hi.v")
    conflict = F.when(low.isNull() | (low == high), F.lit(False)).otherwise(
        F.coalesce(F.col(f"_{name}_undated"), F.lit(False)) | (last_low != last_high)
    )
    value = F.when(low == high, low).when(low.isNotNull() & ~conflict, last_high)
    return value, conflict


def latest_explicit(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Conflict-aware latest value per key; a contradiction without chronology stays open."""
    counted = F.col(value).isNotNull()
    grouped = df.groupBy(*keys).agg(
        *named(latest_explicit_aggs("x", F.col(value), F.col(time), counted))
    )
    result, conflict = latest_explicit_result("x")
    return grouped.select(*keys, result.alias(value), conflict.alias("conflict"))


# -- candidates and current facts ----------------------------------------------------------


def candidate_build(inquiries: DataFrame) -> DataFrame:
    """One candidate per resolved (carrier, load) pair."""
    linked = inquiries.where("carrier_id IS NOT NULL AND load_id IS NOT NULL")
    return linked.groupBy(*CANDIDATE).agg(
        F.min(seen_at()).alias("first_seen_at"),
        F.max(seen_at()).alias("last_activity_at"),
        F.count("*").alias("inquiry_count"),
    )


def candidate_links(inquiries: DataFrame) -> DataFrame:
    return inquiries.where("carrier_id IS NOT NULL AND load_id IS NOT NULL").select(
        candidate_id().alias("candidate_id"), *CANDIDATE, "inquiry_id",
        F.lit("supporting").alias("relationship"),
    )


QUOTE = ["quote_id", "amount", "currency", "quote_type", "rate_basis"]


def usable_quote() -> Column:
    return (
        F.col("is_current")
        & (F.col("evidence_status") == "explicit")
        & F.col("quote_type").isin(*vocab.CARRIER_ROLES)
    )


def stated_facts() -> list[Column]:
    """What the facts need of an inquiry, as narrow as can be: these columns are shuffled. A
    rejected inquiry keeps its candidate but contributes nothing."""
    live = F.col("review_status") != "rejected"
    said = F.col("availability_status")
    both = (F.col("carrier_resolution_status") == "verified") & (
        F.col("load_resolution_status") == "verified"
    )
    return [
        F.col("occurred_at"), live.alias("_live"), (live & both).alias("_verified"),
        F.when(live & (said != "not_stated"), said).alias("_said"),
        F.when(live, F.col("equipment_code")).alias("_truck"),
    ]


def fact_aggs(quote: Column, high: Column, quoted: Column) -> dict[str, Column]:
    """Aggregates of a candidate's rows of ``stated_facts`` and their quotes where ``quoted``."""
    time, said, truck = F.col("occurred_at"), F.col("_said"), F.col("_truck")
    return {
        "identity_verified": F.bool_or("_verified"),
        **latest_explicit_aggs("availability", said, time, said.isNotNull()),
        **latest_explicit_aggs("equipment", truck, time, truck.isNotNull()),
        # the quote struct starts with its id, so comparing structs compares ids
        **latest_explicit_aggs("quote", quote, time, F.col("_live") & quoted, high),
    }


def fact_results() -> list[Column]:
    out = []
    for name in ("availability", "equipment", "quote"):
        value, conflict = latest_explicit_result(name)
        out += [value.alias(f"current_{name}"), conflict.alias(f"{name}_conflict")]
    return out


def quoted_inquiries(inquiries: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every linked inquiry beside each of its quotes that count."""
    heard = F.coalesce("occurred_at", "received_at", "created_at")
    linked = inquiries.where("carrier_id IS NOT NULL AND load_id IS NOT NULL").select(
        "inquiry_id", *CANDIDATE, *stated_facts(),
        *([heard.alias("_heard")] if "created_at" in inquiries.columns else []),
    )
    return linked.join(quotes.where(usable_quote()).select("inquiry_id", *QUOTE), "inquiry_id", "left")


def _quote_aggs() -> dict[str, Column]:
    quote = F.struct(*QUOTE, F.lit("explicit").alias("evidence_status"))
    return fact_aggs(quote, quote, F.col("quote_id").isNotNull())


def current_facts(inquiries: DataFrame, quotes: DataFrame) -> DataFrame:
    """Current identity, availability, equipment and quote of every candidate.

    One join and one grouped aggregate for all four.
    """
    grouped = quoted_inquiries(inquiries, quotes).groupBy(*CANDIDATE).agg(*named(_quote_aggs()))
    return grouped.select(
        candidate_id().alias("candidate_id"), *CANDIDATE, "identity_verified", *fact_results()
    )


# -- policy ----------------------------------------------------------------------------------


def authority_result(raw: Column) -> Column:
    return (
        F.when(raw.isin(*vocab.AUTHORITY_PASS), "pass")
        .when(raw.isin(*vocab.AUTHORITY_FAIL), "fail")
        .otherwise("unknown")
    )


def safety_result(raw: Column) -> Column:
    return (
        F.when(raw.isin(*vocab.SAFETY_PASS), "pass")
        .when(raw.isin(*vocab.SAFETY_FAIL), "fail")
        .otherwise("unknown")
    )


def insurance_result(expiry: Column, needed_on: Column) -> Column:
    return F.when(expiry.isNull(), "unknown").when(expiry >= needed_on, "pass").otherwise("fail")


def compliance_overall(*results: Column) -> Column:
    any_is = lambda word: reduce(lambda a, b: a | b, [r == word for r in results])
    return F.when(any_is("fail"), "fail").when(any_is("unknown"), "needs_review").otherwise("pass")


def policy_compliance(candidates: DataFrame) -> DataFrame:
    """Policy v1 on rows that carry carrier facts and the load's pickup date."""
    return (
        candidates.withColumn("authority_result", authority_result(F.col("authority_status")))
        .withColumn("safety_result", safety_result(F.col("safety_rating")))
        .withColumn(
            "insurance_result", insurance_result(F.col("insurance_expiry"), F.col("pickup_date"))
        )
        .withColumn(
            "compliance_result",
            compliance_overall(
                F.col("authority_result"), F.col("safety_result"), F.col("insurance_result")
            ),
        )
        .withColumn("policy_version", F.lit(vocab.POLICY_VERSION))
    )


_CARRIER_FACTS = [
    "carrier_id", "company_name", "authority_status", "safety_rating", "insurance_expiry",
    "onboarded", "reliability_score", "loads_completed", "avg_response_time_hours",
]
_LOAD_FACTS = ["load_id", "pickup_date", "distance_miles", "equipment_code AS load_equipment"]


def eligibility(facts: DataFrame, carriers: DataFrame, loads: DataFrame) -> DataFrame:
    """Component results and the final status of each candidate's facts."""
    return decided(
        facts.join(carriers.select(*_CARRIER_FACTS), "carrier_id").join(
            loads.selectExpr(*_LOAD_FACTS), "load_id"
        )
    )


def assess(
    inquiries: DataFrame, quotes: DataFrame, carriers: DataFrame, loads: DataFrame
) -> DataFrame:
    """``eligibility`` of ``current_facts``, and the inquiry each candidate was last heard in.

    Rows meet their load before they are grouped. They are narrow there, and one shuffle by load
    serves that join, the grouping and all that follows by load; where a load is hot the join
    splits it. Ties for the last inquiry go to the highest id.
    """
    grouped = _met_by_load(quoted_inquiries(inquiries, quotes), loads)
    return decided(grouped.join(at_hand(carriers.select(*_CARRIER_FACTS)), "carrier_id"))


def _met_by_load(quoted: DataFrame, loads: DataFrame) -> DataFrame:
    """The current facts of each candidate beside those of its load, from ``quoted_inquiries``."""
    # a broadcast of few loads would leave the rows to be shuffled as wide partial results
    load_facts = loads.selectExpr(*_LOAD_FACTS).hint("merge")
    keys = [*CANDIDATE, *[c for c in load_facts.columns if c != "load_id"]]
    grouped = quoted.join(load_facts, "load_id").groupBy(*keys).agg(
        *named(_quote_aggs()),
        F.max(F.struct("_heard", "inquiry_id")).getField("inquiry_id").alias("latest_inquiry_id"),
    )
    return grouped.select(
        candidate_id().alias("candidate_id"), *keys, "identity_verified", *fact_results(),
        "latest_inquiry_id",
    )


def may_be_eligible() -> Column:
    """Whether some load may find a carrier eligible, by what is known of the carrier alone."""
    return (
        (authority_result(F.col("authority_status")) == "pass")
        & (safety_result(F.col("safety_rating")) == "pass")
        & F.col("insurance_expiry").isNotNull()
        & F.col("onboarded")
    )


def assess_quoted(
    inquiries: DataFrame, quotes: DataFrame, carriers: DataFrame, loads: DataFrame
) -> DataFrame:
    """``assess`` for prices only: every candidate that has a current quote, with that quote and
    whether it is eligible (``final_status`` is 'eligible' or NULL).

    Fewer and narrower rows are shuffled. A rejected inquiry contributes nothing; what is stated of
    a carrier that can never be eligible decides nothing, so of its inquiries only the quotes count;
    and an inquiry that brings neither a quote nor a fact stays where it met the quotes.
    """
    known = stored(carriers.select(*_CARRIER_FACTS), "side")
    rows = inquiries.where(F.col("review_status") != "rejected")
    if known.count() <= AT_HAND:
        known = F.broadcast(known)
        # more carriers would have to be met by a shuffle of its own
        hopeful = known.where(may_be_eligible()).select("carrier_id", F.lit(True).alias("_hopeful"))
        rows = rows.join(hopeful, "carrier_id", "left")
    else:
        rows = rows.withColumn("_hopeful", F.lit(True))
    told = {
        "carrier_resolution_status": F.when(F.col("_hopeful"), F.col("carrier_resolution_status")),
        "availability_status": F.when(F.col("_hopeful"), F.col("availability_status")),
        "equipment_code": F.when(F.col("_hopeful"), F.col("equipment_code")),
    }
    quoted = quoted_inquiries(rows.withColumns(told), quotes).withColumn("_live", F.lit(True))
    brought = quoted.where(
        F.col("quote_id").isNotNull() | F.col("_verified") | F.col("_said").isNotNull()
        | F.col("_truck").isNotNull()
    )
    facts = _met_by_load(brought, loads).where("current_quote IS NOT NULL")
    eligible = F.when(F.col("final_status") == "eligible", F.col("final_status"))
    return decided(facts.join(known, "carrier_id")).select(
        "candidate_id", *CANDIDATE, "distance_miles", "current_quote", eligible.alias("final_status")
    )


def decided(rows: DataFrame) -> DataFrame:
    """Component results and the final status, in order of precedence, on rows that carry the
    current facts and what is known of carrier and load."""
    rows = policy_compliance(rows)
    truck, wanted = F.col("current_equipment"), F.col("load_equipment")
    said = F.col("current_availability")
    rows = (
        rows.withColumn(
            "identity_result", F.when(F.col("identity_verified"), "pass").otherwise("unknown")
        )
        .withColumn(
            "equipment_result",
            F.when(wanted.isNull() | truck.isNull(), "unknown")
            .when(truck == wanted, "pass")
            .otherwise("fail"),
        )
        .withColumn(
            "availability_result",
            F.when(said == "confirmed", "pass")
            .when(said == "unavailable", "fail")
            .otherwise("unknown"),
        )
        .withColumn(
            "onboarding_result",
            F.when(F.col("onboarded"), "pass")
            .when(~F.col("onboarded"), "fail")
            .otherwise("unknown"),
        )
    )
    is_ = lambda column, word: F.col(column) == word
    blocked = (
        is_("compliance_result", "fail")
        | is_("equipment_result", "fail")
        | is_("availability_result", "fail")
    )
    unclear = (
        ~is_("equipment_result", "pass")
        | ~is_("availability_result", "pass")
        | ~is_("identity_result", "pass")
        | F.col("quote_conflict")
        | is_("onboarding_result", "unknown")
    )
    return rows.withColumn(
        "final_status",
        F.when(blocked, "blocked")
        .when(is_("compliance_result", "needs_review"), "needs_compliance_review")
        .when(unclear, "needs_clarification")
        .when(is_("onboarding_result", "fail"), "needs_onboarding")
        .otherwise("eligible"),
    )


def reasons_array() -> Column:
    """All reasons of one assessment as an array of structs, built on the row itself."""

    def reason(when: Column, component: str, code: str, severity: str, seen=None, needed=None):
        text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
        return F.when(
            when,
            F.struct(
                F.lit(component).alias("component"),
                F.lit(code).alias("code"),
                F.lit(severity).alias("severity"),
                text(seen).alias("observed"),
                text(needed).alias("required"),
            ),
        )

    is_ = lambda name, word: F.col(f"{name}_result") == word
    expiry = F.coalesce(F.col("insurance_expiry").cast("string"), F.lit(""))
    needed_expiry = F.concat(F.lit(">= "), F.col("pickup_date").cast("string"))
    onboarded = F.initcap(F.col("onboarded").cast("string"))
    authority, safety = F.col("authority_status"), F.col("safety_rating")
    pass_authority, pass_safety = F.lit("ACTIVE"), F.lit("Satisfactory")
    equipment_open = is_("equipment", "unknown")
    availability_open = is_("availability", "unknown")
    conditional = F.col("current_availability") == "conditional"
    conditional = F.coalesce(conditional, F.lit(False))
    truck_conflict, said_conflict = F.col("equipment_conflict"), F.col("availability_conflict")
    options = [
        reason(is_("authority", "fail"), "authority", "authority_inactive", "blocker",
               authority, pass_authority),
        reason(is_("authority", "unknown"), "authority", "authority_unknown", "review",
               authority, pass_authority),
        reason(is_("safety", "fail"), "safety", "safety_unacceptable", "blocker",
               safety, pass_safety),
        reason(is_("safety", "unknown"), "safety", "safety_unknown", "review",
               safety, pass_safety),
        reason(is_("insurance", "fail"), "insurance", "insurance_expired", "blocker",
               expiry, needed_expiry),
        reason(is_("insurance", "unknown"), "insurance", "insurance_expiry_unknown", "review",
               expiry, needed_expiry),
        reason(is_("onboarding", "fail"), "onboarding", "carrier_not_onboarded", "review",
               onboarded, F.lit("true")),
        reason(is_("equipment", "fail"), "equipment", "equipment_mismatch", "blocker",
               F.col("current_equipment"), F.col("load_equipment")),
        reason(equipment_open & truck_conflict, "equipment", "equipment_conflicting", "review"),
        reason(equipment_open & ~truck_conflict, "equipment", "equipment_unknown", "review"),
        reason(is_("availability", "fail"), "availability", "carrier_unavailable", "blocker"),
        reason(availability_open & said_conflict, "availability", "availability_conflicting",
               "review"),
        reason(availability_open & ~said_conflict & conditional, "availability",
               "availability_conditional", "review"),
        reason(availability_open & ~said_conflict & ~conditional, "availability",
               "availability_unknown", "review"),
        reason(F.col("quote_conflict"), "quote", "quote_ambiguous", "warning"),
        reason(~F.col("quote_conflict") & F.col("current_quote").isNull(), "quote",
               "quote_missing", "information"),
    ]
    return F.filter(F.array(*options), lambda r: r.isNotNull())


def assessment_reasons(assessed: DataFrame) -> DataFrame:
    return assessed.select(
        "candidate_id", *CANDIDATE, F.inline(reasons_array())
    )


def open_reasons() -> Column:
    """Codes of the blocker and review reasons, in the order they are raised."""
    shown = F.filter(reasons_array(), lambda r: r["severity"].isin("blocker", "review"))
    return F.transform(shown, lambda r: r["code"])


# -- ranking -----------------------------------------------------------------------------------


def with_comparable_quote(assessed: DataFrame) -> DataFrame:
    return rates.comparable(assessed.select("*", "current_quote.*"))


def _strength() -> list[Column]:
    return [
        F.col("all_in").isNull().asc(),
        F.col("all_in").asc_nulls_last(),
        *nulls_last_key(F.col("reliability_score"), descending=True),
        *nulls_last_key(F.col("loads_completed"), descending=True),
        *nulls_last_key(F.col("avg_response_time_hours")),
        F.col("carrier_id").asc(),
    ]


# what a ranking keeps of a candidate: the sort stores its rows, so they are kept narrow
_RANKED = [
    "load_id", "carrier_id", "candidate_id", "company_name", "final_status", "all_in", "per_mile",
    "reliability_score", "loads_completed", "avg_response_time_hours", "quote_id",
]


def strongest_candidates(priced: DataFrame, inquiries: DataFrame | None = None) -> DataFrame:
    """Eligible candidates of each load, strongest first. Given the inquiries that they come from,
    large loads are found by counting those."""
    eligible = priced.where("final_status = 'eligible'").select(*_RANKED)
    return positions(eligible, ["load_id"], _strength(), bound=inquiries)


def workspace_candidates(priced: DataFrame, inquiries: DataFrame | None = None) -> DataFrame:
    """All candidates of each load: actionable statuses first, eligible ones by strength."""
    ranks = F.create_map(
        *[F.lit(x) for pair in vocab.CANDIDATE_STATUS_RANK.items() for x in pair]
    )
    is_eligible = F.col("final_status") == "eligible"
    strength = [
        F.when(is_eligible, key).asc()
        for key in (
            F.col("all_in").isNull(),
            F.col("all_in"),
            F.col("reliability_score").isNull(),
            -F.col("reliability_score"),
            F.col("loads_completed").isNull(),
            -F.col("loads_completed"),
            F.col("avg_response_time_hours").isNull(),
            F.col("avg_response_time_hours"),
            F.col("carrier_id"),
        )
    ]
    rank = F.coalesce(F.try_element_at(ranks, F.col("final_status")), F.lit(5))
    rows = priced.select(
        *_RANKED, rank.alias("status_rank"), open_reasons().alias("open_reasons"), "latest_inquiry_id"
    )
    order = [
        F.col("status_rank").asc(), *strength, F.col("quote_id").isNull().asc(),
        F.col("carrier_id").asc(),
    ]
    return positions(rows, ["load_id"], order, bound=inquiries)


# -- assessment history --------------------------------------------------------------------------


def fact_hash() -> Column:
    """Identity of everything an assessment depends on."""
    parts = [
        "final_status", "identity_result", "equipment_result", "availability_result",
        "onboarding_result", "authority_result", "safety_result", "insurance_result",
        "current_availability", "current_equipment", "current_quote.quote_id",
        "equipment_conflict", "availability_conflict", "quote_conflict", "policy_version",
    ]
    shown = [F.coalesce(F.col(p).cast("string"), F.lit("\x01")) for p in parts]
    return F.sha2(F.concat_ws("\x00", *shown), 256)


def assessment_history(
    existing: DataFrame, assessed: DataFrame, evaluated_at: Column
) -> DataFrame:
    """New immutable assessments to append: only candidates whose facts changed.

    ``existing`` holds load_id, carrier_id, fact_hash, evaluated_at of all earlier assessments.
    """
    newest = existing.groupBy(*CANDIDATE).agg(
        F.max_by("fact_hash", F.struct("evaluated_at", "fact_hash")).alias("known_hash")
    )
    return (
        assessed.withColumn("fact_hash", fact_hash())
        .join(newest, CANDIDATE, "left")
        .where(~F.col("known_hash").eqNullSafe(F.col("fact_hash")))
        .select(
            F.sha2(F.concat_ws("\x00", "candidate_id", "fact_hash", evaluated_at.cast("string")),
                   256).alias("assessment_id"),
            "candidate_id", *CANDIDATE, "final_status", "policy_version", "fact_hash",
            evaluated_at.alias("evaluated_at"),
        )
    )


def current_rows(rows: DataFrame, keys: list[str], created: str, ident: str) -> DataFrame:
    """The newest row per key, without a window: a struct maximum combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(created, ident, *[c for c in rest if c not in (created, ident)]))
    return rows.groupBy(*keys).agg(newest.alias("_newest")).select(*keys, "_newest.*")


def candidate_assessment(requests: DataFrame, assessed: DataFrame) -> DataFrame:
    """Status, reasons and current quote for requested (carrier, load) pairs."""
    known = assessed.select(
        *CANDIDATE, "final_status", open_reasons().alias("open_reasons"),
        F.size(reasons_array()).alias("reason_count"),
        F.col("current_quote.quote_id").alias("quote_id"), F.lit(True).alias("_found"),
    )
    return (
        requests.join(known, CANDIDATE, "left")
        .withColumn("outcome", F.when(F.col("_found"), "found").otherwise("not_found"))
        .drop("_found")
    )


