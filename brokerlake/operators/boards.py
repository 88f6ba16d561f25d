"""Boards, directories, histories and searches as set-at-a-time queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions import money
from brokerlake.functions.text import icontains
from brokerlake.operators import candidates as cand
from brokerlake.scale import at_hand, stored


def event_when() -> list[Column]:
    """Display time and whether it fell back to the receipt time."""
    return [
        F.coalesce("occurred_at", "received_at").alias("when_at"),
        F.col("occurred_at").isNull().alias("when_is_fallback"),
    ]


def _case_of(column: Column, options: dict, default) -> Column:
    result = F.lit(default)
    for key, value in reversed(options.items()):
        result = F.when(column == key, value).otherwise(result)
    return result


# -- loads ----------------------------------------------------------------------------------


def load_status_counts(loads: DataFrame) -> DataFrame:
    return loads.groupBy("status").agg(F.count("*").alias("n"))


def inquiry_counts(inquiries: DataFrame, key: str) -> DataFrame:
    return inquiries.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("inquiry_count")
    )


def loads_board(loads: DataFrame, inquiries: DataFrame) -> DataFrame:
    counted = loads.join(inquiry_counts(inquiries, "load_id"), "load_id", "left")
    return (
        counted.withColumn("inquiry_count", F.coalesce("inquiry_count", F.lit(0)))
        .withColumn("status_rank", _case_of(F.col("status"), vocab.LOAD_STATUS_RANK, 3))
        .orderBy("status_rank", "pickup_date", "load_id")
    )


def open_loads_board(context: DataFrame, inquiries: DataFrame, as_of: Column) -> DataFrame:
    """Open loads with band label; a past pickup is said first, then missing history."""
    label = (
        F.when(F.col("pickup_date") < as_of, "Pickup passed")
        .when(F.col("band_position").isNull(), "Insufficient history")
        .otherwise(_case_of(F.col("band_position"), vocab.BAND_LABELS, None))
    )
    return (
        context.where("status = 'open'")
        .join(inquiry_counts(inquiries, "load_id"), "load_id", "left")
        .withColumn("inquiry_count", F.coalesce("inquiry_count", F.lit(0)))
        .withColumn("band_label", label)
        .orderBy("pickup_date", "load_id")
    )


def load_facts(context: DataFrame, best: DataFrame, types: dict | None = None) -> DataFrame:
    """Flat record per load; the equipment name falls back to the raw label."""
    names = {code: label for label, code in vocab.EQUIPMENT_LABELS.items()}
    return context.join(best, "load_id", "left").select(
        "load_id", "status", "origin_state", "destination_state",
        F.coalesce(_case_of(F.col("equipment_code"), types or names, None), "equipment_raw")
        .alias("equipment"),
        "pickup_date", "weight_lbs",
        F.when(F.col("distance_miles") != 0, F.col("distance_miles")).alias("distance_miles"),
        F.when(F.col("offered_rate_usd") != 0, F.col("offered_rate_usd"))
        .alias("offered_rate_usd"),
        F.when(F.col("offered_per_mile") != 0, F.col("offered_per_mile"))
        .alias("offered_per_mile"),
        F.col("band_position").alias("market_band_position"),
        F.col("lowest_overall.all_in").alias("lowest_overall_quote"),
        F.col("lowest_eligible.all_in").alias("lowest_eligible_quote"),
    )


def dashboard_counts(inquiries: DataFrame, assessed: DataFrame) -> DataFrame:
    """Inquiries to review and candidates with compliance trouble, as one row."""
    one = F.lit(1).alias("_one")
    review = inquiries.agg(
        F.count_if(F.col("review_status") == "needs_review").alias("review_count")
    ).select("*", one)
    warnings = assessed.agg(
        F.count_if(F.col("final_status").isin("blocked", "needs_compliance_review"))
        .alias("compliance_warnings")
    ).select("*", one)
    return review.join(warnings, "_one").drop("_one")


# -- inbox ------------------------------------------------------------------------------------


def pick_inquiry(jobs: DataFrame, inquiries: DataFrame) -> DataFrame:
    """The inquiry an event opens on: first reviewable one of a needs_review job, else first."""
    to_review = (F.col("status") == "needs_review") & (F.col("review_status") == "needs_review")
    rank = F.struct(F.when(to_review, 0).otherwise(1), F.col("sequence_number"), "inquiry_id")
    return (
        inquiries.join(jobs.select("event_id", "status"), "event_id", "left")
        .groupBy("event_id")
        .agg(
            F.min_by("inquiry_id", rank).alias("inquiry_id"),
            F.min_by("primary_intent", rank).alias("primary_intent"),
        )
    )


def inbox(
    events: DataFrame,
    jobs: DataFrame,
    inquiries: DataFrame,
    carriers: DataFrame,
    source: str | None = None,
    state: str | None = None,
    query: str | None = None,
) -> DataFrame:
    """Events with job state, the inquiry they open on and attention flag, newest first."""
    rows = events
    if source is not None:
        rows = rows.where(F.col("channel") == source)
    states = jobs.select("event_id", F.col("status").alias("job_status"))
    rows = rows.join(states, "event_id", "left")
    if state is not None:
        rows = rows.where(F.col("job_status") == state)
    if query:
        names = carriers.select("carrier_id", "company_name")
        named = inquiries.join(names, "carrier_id", "left").where(
            icontains(F.col("company_name"), query) | icontains(F.col("load_id"), query)
        )
        by_inquiry = named.select("event_id").distinct().withColumn("_named", F.lit(True))
        own = F.coalesce("_named", F.lit(False))
        for column in ("sender_email_raw", "sender_name", "subject", "external_source_id"):
            own = own | icontains(F.col(column), query)
        rows = rows.join(by_inquiry, "event_id", "left").where(own).drop("_named")
    attention = F.coalesce(F.col("job_status").isin("needs_review", "failed"), F.lit(False))
    return (
        rows.join(pick_inquiry(jobs, inquiries), "event_id", "left")
        .select("*", *event_when(), attention.alias("attention"))
        .withColumn(
            "intent_label", _case_of(F.col("primary_intent"), vocab.INTENT_LABELS, None)
        )
        .orderBy(F.col("attention").desc(), F.col("when_at").desc_nulls_first(), "event_id")
    )


# -- carriers -----------------------------------------------------------------------------------


def directory_compliance(as_of: Column) -> Column:
    """Compliance label of the directory; insurance is read against the snapshot's date."""
    results = [
        cand.authority_result(F.col("authority_status")),
        cand.safety_result(F.col("safety_rating")),
        cand.insurance_result(F.col("insurance_expiry"), as_of),
    ]
    overall = cand.compliance_overall(*results)
    return (
        F.when(overall == "fail", "Compliance issue")
        .when(overall == "needs_review", "Needs review").otherwise("Compliant")
    )


def onboarding_label() -> Column:
    return (
        F.when(F.col("onboarded"), "Onboarded")
        .when(~F.col("onboarded"), "Not onboarded").otherwise("Onboarding unknown")
    )


def carrier_directory(
    carriers: DataFrame, inquiries: DataFrame, candidates: DataFrame, as_of: Column,
    query: str | None = None,
) -> DataFrame:
    """Carriers with compliance, onboarding and counts. Both counts are aggregated before the
    joins, so inquiries and candidacies never multiply."""
    rows = carriers
    if query:
        hit = F.lit(False)
        for column in (
            "company_name", "mc_number_raw", "mc_number_normalized", "dot_number_raw",
            "dot_number_normalized",
        ):
            hit = hit | icontains(F.col(column), query)
        rows = rows.where(hit)
    candidacies = candidates.groupBy("carrier_id").agg(F.count("*").alias("candidacy_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        rows.join(inquiry_counts(inquiries, "carrier_id"), "carrier_id", "left")
        .join(candidacies, "carrier_id", "left")
        .select(
            "carrier_id", "company_name", directory_compliance(as_of).alias("compliance_label"),
            onboarding_label().alias("onboarding_label"), zero("inquiry_count"),
            zero("candidacy_count"),
        )
        .orderBy(F.lower("company_name").asc_nulls_last(), "carrier_id")
    )


def profile_gaps() -> Column:
    """Names of what is missing from a carrier's file, in reading order."""
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    unknown = lambda result: result == "unknown"
    gaps = [
        (blank("mc_number_raw"), "mc_number"),
        (blank("dot_number_raw"), "dot_number"),
        (F.col("insurance_expiry").isNull(), "insurance_expiry"),
        (unknown(cand.authority_result(F.col("authority_status"))), "authority_status"),
        (unknown(cand.safety_result(F.col("safety_rating"))), "safety_rating"),
        (F.col("onboarded").isNull(), "onboarding"),
        (blank("company_name"), "company_name"),
    ]
    named = F.array(*[F.when(missing, F.lit(name)) for missing, name in gaps])
    return F.filter(named, lambda g: g.isNotNull())


def carrier_profile(carriers: DataFrame, contacts: DataFrame, as_of: Column) -> DataFrame:
    """Policy readings, insurance against the as-of date, gaps and the contact to show."""
    shown = contacts.groupBy("carrier_id").agg(
        F.min(
            F.struct(F.when(F.col("is_primary"), 0).otherwise(1), "contact_id")
        ).getField("contact_id").alias("contact_id")
    )
    insurance = cand.insurance_result(F.col("insurance_expiry"), as_of)
    return carriers.join(shown, "carrier_id", "left").select(
        "carrier_id", "company_name", "contact_id",
        cand.authority_result(F.col("authority_status")).alias("authority_result"),
        cand.safety_result(F.col("safety_rating")).alias("safety_result"),
        F.when(insurance == "pass", "valid").when(insurance == "fail", "expired")
        .otherwise("unknown").alias("insurance_verdict"),
        F.when(F.col("onboarded"), "complete").when(~F.col("onboarded"), "required")
        .otherwise("unknown").alias("onboarding_verdict"),
        profile_gaps().alias("gaps"),
    )


def carrier_facts(carriers: DataFrame) -> DataFrame:
    return carriers.select(
        "carrier_id", "company_name", F.col("mc_number_raw").alias("mc_number"),
        F.col("dot_number_raw").alias("dot_number"), "authority_status", "safety_rating",
        "insurance_expiry", "onboarded", "reliability_score", "loads_completed",
        "avg_response_time_hours",
    )


def carrier_candidacies(assessed: DataFrame) -> DataFrame:
    """Every candidacy by carrier. The rows are stored before they are sorted: a sort reads its input
    twice, first for the borders of its ranges, and would assess all candidates each time."""
    rows = assessed.select(
        "carrier_id", "load_id", "pickup_date", "final_status",
        cand.open_reasons().alias("open_reasons"),
        F.col("current_quote.quote_id").alias("quote_id"),
    )
    return stored(rows, "candidacies").orderBy("carrier_id", F.col("pickup_date").asc_nulls_last(), "load_id")


# -- histories ------------------------------------------------------------------------------------


def _newest_first() -> list[Column]:
    return [
        F.col("occurred_at").desc_nulls_first(), F.col("received_at").desc_nulls_first(),
        F.col("inquiry_id").asc(),
    ]


def load_timeline(inquiries: DataFrame, load_id: str | None = None) -> DataFrame:
    rows = inquiries.where(F.col("load_id").isNotNull())
    rows = rows if load_id is None else rows.where(F.col("load_id") == load_id)
    return rows.orderBy("load_id", *_newest_first())


def load_unmatched(inquiries: DataFrame) -> DataFrame:
    return inquiries.where("load_id IS NOT NULL AND carrier_id IS NULL").orderBy(
        "load_id", F.col("created_at").desc_nulls_first(), "inquiry_id"
    )


def newest_per_key(inquiries: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest inquiries of each key that are not rejected. The limit on ``row_number`` is
    pushed below the shuffle, so a hot key sends at most ``limit`` rows per input partition."""
    newest = Window.partitionBy(key).orderBy(
        F.col("created_at").desc_nulls_first(), F.col("inquiry_id").asc()
    )
    return (
        inquiries.where(F.col(key).isNotNull() & (F.col("review_status") != "rejected"))
        .withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= limit)
    )


def carrier_timeline(inquiries: DataFrame) -> DataFrame:
    return inquiries.where("carrier_id IS NOT NULL").orderBy("carrier_id", *_newest_first())


def carrier_history(inquiries: DataFrame, limit: int = vocab.HISTORY_LIMIT) -> DataFrame:
    return newest_per_key(inquiries, "carrier_id", limit)


def load_inquiries(
    inquiries: DataFrame, quotes: DataFrame, limit: int = vocab.SEARCH_LIMIT
) -> DataFrame:
    current = quotes.where("is_current").groupBy("inquiry_id").agg(
        F.min(F.struct("quote_id", "amount", "rate_basis", "quote_type")).alias("current_quote")
    )
    return newest_per_key(inquiries, "load_id", limit).join(current, "inquiry_id", "left")


def search_inquiries(
    inquiries: DataFrame, carriers: DataFrame, query: str, load_id: str | None = None,
    limit: int = vocab.SEARCH_LIMIT,
) -> DataFrame:
    rows = inquiries.where("review_status <> 'rejected'")
    if load_id is not None:
        rows = rows.where(F.col("load_id") == load_id)
    rows = rows.join(carriers.select("carrier_id", "company_name"), "carrier_id", "left")
    hit = F.lit(False)
    for column in ("summary", "company_name", "load_id", "primary_intent"):
        hit = hit | icontains(F.col(column), query)
    return (
        rows.where(hit)
        .orderBy(F.col("created_at").desc_nulls_first(), "inquiry_id")
        .limit(limit)
    )


# -- one inquiry in full ---------------------------------------------------------------------------


def inquiry_detail(
    inquiries: DataFrame, assessments: DataFrame, quotes: DataFrame, reasons: DataFrame,
) -> DataFrame:
    """Counts and states shown with each inquiry: assessments by status, quotes, pending,
    warning and resolved reasons, and its siblings in the same event.

    Every part is aggregated to one row per key before it is joined.
    """
    by_status = assessments.groupBy("inquiry_id").agg(
        *[
            F.count_if(F.col("evidence_status") == s).alias(f"{s}_fields")
            for s in ("explicit", "inferred", "missing")
        ]
    )
    quoted = quotes.groupBy("inquiry_id").agg(
        F.count("*").alias("quote_count"), F.count_if("is_current").alias("current_quotes")
    )
    review = F.col("severity") == "review"
    raised = reasons.groupBy("inquiry_id").agg(
        F.count_if(review & F.col("resolved_at").isNull()).alias("pending_reasons"),
        F.count_if(F.col("severity") == "informational").alias("warning_reasons"),
        F.count_if(review & F.col("resolved_at").isNotNull()).alias("resolved_reasons"),
    )
    family = inquiries.groupBy("event_id").agg((F.count("*") - 1).alias("sibling_count"))
    rows = inquiries.select("inquiry_id", "event_id", "sequence_number", "primary_intent")
    for part in (by_status, quoted, raised):
        rows = rows.join(part, "inquiry_id", "left")
    rows = rows.join(family, "event_id")
    counts = [c for c in rows.columns if c.endswith(("_fields", "_count", "_quotes", "_reasons"))]
    return rows.fillna(0, counts)


# -- drafting -------------------------------------------------------------------------------------


def draft_context(
    inquiries: DataFrame, carriers: DataFrame, contacts: DataFrame, quotes: DataFrame,
    context: DataFrame, words: bool = True,
) -> DataFrame:
    """The facts handed to a draft, one struct per topic; internal notes are left out.

    ``context`` holds the loads with their market. Inquiries meet their quotes by inquiry, then are
    dealt once by load; windows over the candidate give each inquiry the facts that
    ``candidates.assess`` gives the candidate, so assessments are neither made nor joined apart.
    Between the two the rows are stored, so that the disk holds one shuffle of them at a time. A stored
    column is written whether or not it is asked for: without ``words`` the summary and the
    availability as it was stated are left out.
    """
    words = ["availability_status", "summary"] if words else []
    counted = F.struct(*cand.QUOTE)
    low, high = F.col("_low"), F.col("_high")
    summed = (
        quotes.where("is_current")
        .select(
            "inquiry_id", *cand.QUOTE, F.coalesce(cand.usable_quote(), F.lit(False)).alias("_usable")
        )
        .repartition("inquiry_id")  # each quote is sent once, not as three partial results
        .groupBy("inquiry_id").agg(
            F.min(counted).alias("_first"), F.min(F.when(F.col("_usable"), counted)).alias("_low"),
            F.max(F.when(F.col("_usable"), counted)).alias("_high"),
        )
        .select(
            "inquiry_id", low.isNotNull().alias("_usable"),
            # mostly one quote is all three
            F.when(low != F.col("_first"), low).alias("_low"), F.when(high != low, high).alias("_high"),
            "_first.*",
        )
    )
    load_part = context.select(
        F.col("load_id").alias("_load"), "band_position",
        F.struct(
            "load_id", "origin_state", "destination_state",
            F.coalesce("equipment_raw", "equipment_code").alias("equipment"), "pickup_date",
            "weight_lbs", "offered_rate_usd", "distance_miles",
        ).alias("load"),
        F.col("equipment_code").alias("load_equipment"),
    )
    primary = contacts.where("is_primary").groupBy("carrier_id").agg(
        F.min("name").alias("contact_name")
    )
    carrier_part = at_hand(carriers.join(primary, "carrier_id", "left").select(
        "carrier_id", "company_name", "mc_number_raw", "contact_name", "authority_status",
        "safety_rating", "insurance_expiry", "onboarded",
    ).withColumnRenamed("carrier_id", "_carrier"))
    stated = inquiries.select("inquiry_id", "load_id", "carrier_id", *cand.stated_facts(), *words)
    met = stated.join(summed, "inquiry_id", "left").select(
        # an inquiry without a load has a key of its own
        F.coalesce("load_id", F.concat(F.lit("\0"), "inquiry_id")).alias("_load"), "carrier_id",
        "inquiry_id", "occurred_at", "_live", "_verified", "_said", "_truck", *words, *cand.QUOTE,
        "_usable", "_low", "_high",
    )
    rows = stored(met, "drafted").join(load_part.hint("merge"), "_load", "left").withColumn(
        "load_id", F.when(~F.startswith("_load", F.lit("\0")), F.col("_load"))
    )
    # the same struct as candidates keep, in whose order quotes are compared
    whole = lambda of: F.struct(*of, F.lit("explicit").alias("evidence_status"))
    inner = lambda c: whole([F.col(f"{c}.{name}").alias(name) for name in cand.QUOTE])
    first = F.when(F.col("_low").isNull(), whole(cand.QUOTE)).otherwise(inner("_low"))
    last = F.when(F.col("_high").isNull(), first).otherwise(inner("_high"))
    aggs = cand.fact_aggs(first, last, F.coalesce("_usable", F.lit(False)))
    candidate = Window.partitionBy("_load", "carrier_id")
    rows = rows.withColumns({name: agg.over(candidate) for name, agg in aggs.items()})
    rows = rows.join(carrier_part, F.col("carrier_id") == F.col("_carrier"), "left").select(
        "inquiry_id", "load_id", "carrier_id", *words, "load", "band_position", "_carrier",
        F.when(F.col("quote_id").isNotNull(), F.struct("quote_id", "amount", "rate_basis", "quote_type"))
        .alias("quote"),
        F.when(F.col("_carrier").isNotNull(), F.struct(
            F.col("_carrier").alias("carrier_id"), "company_name", "mc_number_raw", "contact_name"
        )).alias("carrier"),
        "authority_status", "safety_rating", "insurance_expiry", "onboarded",
        F.col("load.pickup_date").alias("pickup_date"), "load_equipment", "identity_verified",
        *cand.fact_results(),
    )
    known = F.col("_carrier").isNotNull() & F.col("load").isNotNull()
    per_mile = money.quote_as_per_mile(
        F.col("quote.amount"), F.col("quote.rate_basis"), F.col("load.distance_miles")
    )
    said = [F.col("summary"), F.col("availability_status").alias("availability")] if words else []
    return cand.decided(rows).select(
        "load_id", "carrier_id", "inquiry_id", *said, "band_position", "load", "carrier",
        F.when(known, F.struct(
            cand.candidate_id().alias("candidate_id"), "final_status", cand.open_reasons().alias("reasons")
        )).alias("eligibility"),
        "quote", per_mile.alias("quote_per_mile"),
    )


def draft_links(context: DataFrame) -> DataFrame:
    """(fact, type, stable id) for every fact a draft was given."""

    def link(fact: str, kind: str, ident: Column) -> Column:
        return F.when(
            ident.isNotNull(),
            F.struct(
                F.lit(fact).alias("fact"), F.lit(kind).alias("kind"),
                F.concat(F.lit(f"{kind}:"), ident).alias("stable_id"),
            ),
        )

    links = F.array(
        link("load", "load", F.col("load.load_id")),
        link("carrier", "carrier", F.col("carrier.carrier_id")),
        link("current_quote", "quote", F.col("quote.quote_id")),
        link("eligibility_assessment", "assessment", F.col("eligibility.candidate_id")),
    )
    return context.select("inquiry_id", F.inline(F.filter(links, lambda x: x.isNotNull())))
