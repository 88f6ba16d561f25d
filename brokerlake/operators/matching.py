"""Resolve inquiries to carriers and loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions.text import casefold, digits, icontains, strip
from brokerlake.operators.similarity import contained, inside, lifted, name_ratio, top_similar
from brokerlake.scale import durable

# signal kinds in the order in which a match method is recorded
_KINDS = ("mc_number", "dot_number", "email", "phone")


# -- exact identity ---------------------------------------------------------------------------


def carrier_index(carriers: DataFrame, contacts: DataFrame) -> DataFrame:
    """(snapshot_id, kind, value, carrier_id): every exact signal a carrier answers to."""

    def signal(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(
            "snapshot_id", F.lit(kind).alias("kind"), F.col(column).alias("value"), "carrier_id"
        )

    reachable = contacts.join(carriers.select("carrier_id", "snapshot_id"), "carrier_id")
    return (
        signal(carriers, "mc_number", "mc_number_normalized")
        .unionByName(signal(carriers, "dot_number", "dot_number_normalized"))
        .unionByName(signal(reachable, "email", "email_normalized"))
        .unionByName(signal(reachable, "phone", "phone_normalized"))
        .distinct()
    )


def carrier_signals(inquiries: DataFrame) -> DataFrame:
    """Explode an inquiry's identity hints to (inquiry_id, kind, value); one NULL row if none.

    Expects mc_number, dot_number, contact_email, contact_phone and the envelope's
    sender_email_normalized.
    """

    def hint(kind: str, value: Column) -> Column:
        return F.when(
            F.length(value) > 0,
            F.struct(F.lit(kind).alias("kind"), value.alias("value")),
        )

    hints = F.array(
        hint("mc_number", digits(F.col("mc_number"))),
        hint("dot_number", digits(F.col("dot_number"))),
        hint("email", F.col("sender_email_normalized")),
        hint("email", casefold(strip(F.col("contact_email")))),
        hint("phone", digits(F.col("contact_phone"))),
    )
    known = F.array_distinct(F.filter(hints, lambda h: h.isNotNull()))
    return inquiries.select("inquiry_id", "snapshot_id", F.inline_outer(known))


def _priority(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in _KINDS]), kind)


def match_carrier_exact(inquiries: DataFrame, index: DataFrame) -> DataFrame:
    """One row per inquiry: verified, conflicting or none, with carrier and method.

    The index is reduced to its smallest and largest carrier per signal first, so a signal
    shared by many carriers is known to conflict without listing pairs.
    """
    answers = index.groupBy("snapshot_id", "kind", "value").agg(
        F.min("carrier_id").alias("_lo"), F.max("carrier_id").alias("_hi")
    )
    signals = carrier_signals(inquiries)
    # hintless inquiries keep a key of their own, so NULLs do not meet in one partition
    signals = signals.withColumn("kind", F.coalesce("kind", F.lit("none"))).withColumn(
        "value", F.coalesce("value", F.col("inquiry_id"))
    )
    hits = signals.join(answers, ["snapshot_id", "kind", "value"], "left")
    found = F.col("_lo").isNotNull()
    grouped = hits.groupBy("inquiry_id").agg(
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.min(F.when(found, F.struct(_priority(F.col("kind")), F.col("kind")))).alias("_first"),
    )
    verified = F.col("_lo") == F.col("_hi")
    return grouped.select(
        "inquiry_id",
        F.when(F.col("_lo").isNull(), "none").when(verified, "verified").otherwise("conflicting")
        .alias("identity"),
        F.when(verified, F.col("_lo")).alias("carrier_id"),
        F.when(verified, F.col("_first.kind")).alias("primary_method"),
    )


def match_carrier_conflict(
    inquiries: DataFrame, index: DataFrame, matches: DataFrame
) -> DataFrame:
    """Every carrier that a signal of a conflicting inquiry names, one row per inquiry and carrier.

    The rule is one for signals of one carrier and of many, so ``shared_signal`` is NULL and
    ``group_size`` 1 on every row. Signals of inquiries that do not conflict are not multiplied.
    """
    conflicting = matches.where("identity = 'conflicting'").select("inquiry_id")
    hits = (
        carrier_signals(inquiries)
        .where("kind IS NOT NULL")
        .join(conflicting, "inquiry_id", "left_semi")
        .join(index, ["snapshot_id", "kind", "value"])
    )
    return hits.groupBy("inquiry_id", "carrier_id").agg(
        F.min(F.struct(_priority(F.col("kind")), F.col("kind"))).getField("kind")
        .alias("primary_method")
    ).select(
        "inquiry_id", "carrier_id", F.lit(None).cast("string").alias("shared_signal"),
        "primary_method", F.lit(1).cast("bigint").alias("group_size"),
        F.lit("conflicting").alias("match_tier"),
    )


# -- weak name similarity -----------------------------------------------------------------------


def match_carrier_weak(
    requests: DataFrame,
    carriers: DataFrame,
    threshold: float = vocab.NAME_SIMILARITY_THRESHOLD,
    keep: int = 3,
    exact: DataFrame | None = None,
) -> DataFrame:
    """Up to three proposed carriers per inquiry by name similarity; never selected.

    ``requests``: inquiry_id, carrier_name, manual_hint. Where both tables have snapshot_id, only
    carriers of the inquiry's own snapshot are proposed. ``exact`` is the result of
    ``match_carrier_exact``: inquiries that it resolves or finds conflicting get no proposal. Equal
    names are compared once, and the top three are taken per distinct set of names before they are
    given to inquiries. Equal scores go by carrier_id.
    """
    if exact is not None:
        undecided = exact.where("identity = 'none'").select("inquiry_id")
        requests = requests.join(undecided, "inquiry_id", "left_semi")
    scoped = "snapshot_id" in requests.columns and "snapshot_id" in carriers.columns
    scope = F.coalesce("snapshot_id", F.lit("")) if scoped else F.lit("")
    named = requests.select(
        "inquiry_id", scope.alias("scope"),
        F.nullif(casefold(strip(F.col("carrier_name"))), F.lit("")).alias("n1"),
        F.nullif(casefold(strip(F.col("manual_hint"))), F.lit("")).alias("n2"),
    ).where("n1 IS NOT NULL OR n2 IS NOT NULL")
    named = durable(named.withColumn(
        "ask", F.concat_ws("\x00", "scope", F.coalesce("n1", F.lit("")), F.coalesce("n2", F.lit("")))
    ))
    asks = named.select("ask", "scope", "n1", "n2").distinct()
    sources = asks.select("ask", "scope", F.explode(F.array("n1", "n2")).alias("name")).where(
        "name IS NOT NULL"
    )
    directory = carriers.where("company_name IS NOT NULL").select(
        "carrier_id", scope.alias("scope"), casefold(F.col("company_name")).alias("company")
    )
    # carriers sharing one company name tie; only the first few by id can be among the top
    first_ids = directory.withColumn(
        "_n", F.row_number().over(Window.partitionBy("scope", "company").orderBy("carrier_id"))
    ).where(F.col("_n") <= keep).drop("_n")
    companies = directory.groupBy("scope", F.col("company").alias("id")).agg(
        F.min("carrier_id").alias("first")
    )
    names = sources.select("scope", F.col("name").alias("id")).distinct()
    similar = top_similar(names, companies, threshold, keep).where(F.col("ratio") >= threshold)
    best = Window.partitionBy("ask").orderBy(F.col("ratio").desc(), "carrier_id")
    top = (
        sources.join(similar, ["scope", "name"])
        .groupBy("ask", "scope", "company").agg(F.max("ratio").alias("ratio"))
        .join(first_ids, ["scope", "company"])
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= keep)
        .join(asks.select("ask", "n1", "n2"), "ask")
    )

    def signal(name: str, code: str) -> Column:
        ratio = lifted(name_ratio(F.coalesce(name, F.lit("")), F.col("company")), inside(name))
        return F.when(F.col(name).isNotNull() & (ratio >= threshold), F.lit(code))

    codes = F.array(signal("n2", "manual_hint"), signal("n1", "name_similarity"))
    top = top.withColumn("signal_codes", F.filter(codes, lambda c: c.isNotNull())).select(
        "ask", "carrier_id", "company", "ratio", "signal_codes", "rank"
    )
    return (
        named.select("inquiry_id", "ask").join(top, "ask").drop("ask")
        .withColumn("match_tier", F.lit("weak"))
        .withColumn("primary_method", F.lit("name_similarity"))
    )


# -- loads -----------------------------------------------------------------------------------


def match_load(inquiries: DataFrame, loads: DataFrame) -> DataFrame:
    """Resolve the stated load reference; a manual hint can propose but never verify.

    ``inquiries``: inquiry_id, snapshot_id, load_reference, load_hint.
    """
    known = loads.select("snapshot_id", F.col("load_id").alias("_ref"))
    # no reference: a key of its own that no load has
    lonely = F.concat(F.lit("\x00"), F.col("inquiry_id"))
    rows = (
        inquiries.withColumn("reference", digits(F.col("load_reference")))
        .withColumn("hint", digits(F.col("load_hint")))
        .withColumn("_ref", F.coalesce("reference", lonely))
        .join(known.withColumn("_stated", F.lit(True)), ["snapshot_id", "_ref"], "left")
        .drop("_ref")
    )
    stated = F.coalesce("_stated", F.lit(False))
    has_text = F.coalesce(F.length("load_reference") > 0, F.lit(False))
    proposes = ~stated & ~has_text & F.col("hint").isNotNull()
    rows = (
        rows.withColumn("_verified", stated)
        .withColumn("_proposes", proposes)
        .withColumn("_ref", F.when(proposes, F.col("hint")).otherwise(lonely))
        .join(known.withColumn("_hinted", F.lit(True)), ["snapshot_id", "_ref"], "left")
        .drop("_ref")
    )
    verified, hinted = F.col("_verified"), F.coalesce("_hinted", F.lit(False))
    diverges = verified & F.col("hint").isNotNull() & (F.col("hint") != F.col("reference"))
    return rows.select(
        "inquiry_id",
        F.when(verified, F.col("reference")).alias("load_id"),
        F.when(verified, "verified").otherwise("unmatched").alias("load_resolution_status"),
        F.when(verified, "exact").when(hinted, "weak").alias("match_tier"),
        F.when(verified, "external_load_id").when(hinted, "corrected_reference")
        .alias("primary_method"),
        F.when(hinted, F.col("hint")).alias("proposed_load_id"),
        F.when(diverges, "conflicting_load_reference")
        .when(~verified & has_text, "ambiguous_load_reference")
        .when(F.col("_proposes"), "ambiguous_load_reference")
        .alias("reason_code"),
    )


# -- reasons -----------------------------------------------------------------------------------


def metadata_conflicts(inquiries: DataFrame) -> DataFrame:
    """Fields in which the untrusted annotation differs from the extraction.

    Expects equipment, mc_number, load_reference and noted_equipment, noted_mc, noted_load.
    """

    def differs(name: str, noted: Column, found: Column) -> Column:
        return F.when(noted != found, F.lit(name))

    filled = lambda c: F.when(F.length(c) > 0, c)
    fold = lambda c: casefold(strip(filled(F.col(c))))
    conflicts = F.array(
        differs("equipment", fold("noted_equipment"), fold("equipment")),
        differs("mc_number", digits(F.col("noted_mc")), digits(F.col("mc_number"))),
        differs("load_reference", digits(F.col("noted_load")), digits(F.col("load_reference"))),
    )
    return inquiries.withColumn(
        "metadata_conflicts", F.filter(conflicts, lambda c: c.isNotNull())
    )


def review_reasons(resolved: DataFrame) -> DataFrame:
    """All reasons of each inquiry with severity, raised from flags on one row.

    Expects identity, weak_found, mc_number, load_reason, metadata_conflicts, low_confidence.
    """
    unmatched = (F.col("identity") == "none") & ~F.col("weak_found")
    no_mc = F.coalesce(F.length("mc_number") == 0, F.lit(True))

    def reason(when: Column, code: Column, severity: str) -> Column:
        return F.when(when, F.struct(code.alias("code"), F.lit(severity).alias("severity")))

    options = F.array(
        reason(F.col("identity") == "conflicting", F.lit("conflicting_carrier_identity"), "review"),
        reason((F.col("identity") == "none") & F.col("weak_found"), F.lit("weak_carrier_match"),
               "review"),
        reason(unmatched, F.when(no_mc, "missing_mc").otherwise("weak_carrier_match"), "review"),
        reason(F.col("load_reason").isNotNull(), F.col("load_reason"), "review"),
        reason(F.size("metadata_conflicts") > 0, F.lit("metadata_content_conflict"),
               "informational"),
        reason(F.col("low_confidence"), F.lit("low_confidence_transcript_evidence"), "review"),
    )
    return resolved.select(
        "inquiry_id", F.inline(F.filter(options, lambda r: r.isNotNull()))
    )


def review_status_derive(
    inquiries: DataFrame, reasons: DataFrame, otherwise: str = "unreviewed"
) -> DataFrame:
    """needs_review while an unresolved review reason is left, else the given status."""
    pending = (
        reasons.where("severity = 'review' AND resolved_at IS NULL")
        .select("inquiry_id").distinct().withColumn("_pending", F.lit(True))
    )
    return inquiries.join(pending, "inquiry_id", "left").withColumn(
        "review_status", F.when(F.col("_pending"), "needs_review").otherwise(otherwise)
    ).drop("_pending")


def match_listing(matches: DataFrame) -> DataFrame:
    """Matches in display order: selected first, then tier, then creation."""
    return matches.orderBy(
        "inquiry_id", F.col("is_selected").desc(), "match_tier", "created_at", "match_id"
    )


# -- lookups and searches ------------------------------------------------------------------------


def load_lookup(requests: DataFrame, loads: DataFrame) -> DataFrame:
    """found, scope_denied or not_found for each requested reference (digits, else as given)."""
    wanted = F.coalesce(digits(F.col("reference")), F.col("reference"))
    rows = requests.withColumn("load_id", wanted)
    known = loads.select("load_id", F.lit(True).alias("_found"))
    denied = F.col("scope_load_id").isNotNull() & (F.col("scope_load_id") != F.col("load_id"))
    return (
        rows.join(known, "load_id", "left")
        .withColumn(
            "outcome",
            F.when(denied, "scope_denied").when(F.col("_found"), "found").otherwise("not_found"),
        )
        .drop("_found")
    )


def carrier_lookup(requests: DataFrame, carriers: DataFrame) -> DataFrame:
    """First carrier by MC digits, else by equal name, else by a name that contains the request.

    ``requests``: request_id, mc_number, company_name. Each tier reduces to the smallest carrier
    per requested value before it meets the requests.
    """
    asked = requests.withColumn("_mc", digits(F.col("mc_number"))).withColumn(
        "_name", F.nullif(F.upper(strip(F.col("company_name"))), F.lit(""))
    )
    lonely = F.concat(F.lit("\x00"), F.col("request_id"))
    by_mc = carriers.where("mc_number_normalized IS NOT NULL").groupBy(
        F.col("mc_number_normalized").alias("_mc_key")
    ).agg(F.min("carrier_id").alias("_by_mc"))
    companies = carriers.where("company_name IS NOT NULL").groupBy(
        F.upper("company_name").alias("company")
    ).agg(F.min("carrier_id").alias("carrier_id"))
    names = asked.where("_name IS NOT NULL").select(F.col("_name").alias("id")).distinct()
    container = (
        contained(names, companies.select(F.col("company").alias("id")), "_name_key", "company")
        .join(companies, "company")
        .groupBy("_name_key")
        .agg(
            F.min(F.when(F.col("company") == F.col("_name_key"), F.col("carrier_id")))
            .alias("_by_name"),
            F.min("carrier_id").alias("_by_part"),
        )
    )
    rows = (
        asked.withColumn("_mc_key", F.coalesce("_mc", lonely))
        .withColumn("_name_key", F.coalesce("_name", lonely))
        .join(by_mc, "_mc_key", "left")
        .join(container, "_name_key", "left")
    )
    return rows.select(
        "request_id",
        F.coalesce("_by_mc", "_by_name", "_by_part").alias("carrier_id"),
        F.when(F.col("_by_mc").isNotNull(), "mc_number")
        .when(F.col("_by_name").isNotNull(), "name")
        .when(F.col("_by_part").isNotNull(), "name_part")
        .otherwise("not_found").alias("matched_by"),
    )


def carrier_search(
    carriers: DataFrame, contacts: DataFrame, query: str, limit: int = 8
) -> DataFrame:
    """Name or contact address contains the query, or MC/DOT digits equal it; top by name."""
    wanted = digits(F.lit(query))
    reachable = contacts.where(icontains(F.col("email_normalized"), casefold(F.lit(query)))).select(
        "carrier_id"
    ).distinct().withColumn("_reached", F.lit(True))
    hit = (
        icontains(F.col("company_name"), query)
        | F.coalesce("_reached", F.lit(False))
        | F.coalesce(F.col("mc_number_normalized") == wanted, F.lit(False))
        | F.coalesce(F.col("dot_number_normalized") == wanted, F.lit(False))
    )
    return (
        carriers.join(reachable, "carrier_id", "left").where(hit).drop("_reached")
        .orderBy(F.col("company_name").asc_nulls_last(), "carrier_id").limit(limit)
    )
