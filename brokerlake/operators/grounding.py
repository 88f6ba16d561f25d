"""Tie each extracted fact to an exact span of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions.text import nth_occurrence

EMAIL_PARTS = ("subject", "body")
_NO_REF = "struct<source_part:string,excerpt:string,occurrence:string,segment_sequence:string>"


def _ref_columns(ref: Column) -> list[Column]:
    whole = lambda c: c.try_cast("decimal(30,4)").try_cast("bigint")
    given = F.when(ref["occurrence"].isNull(), F.lit(1)).otherwise(whole(ref["occurrence"]))
    return [
        ref["source_part"].alias("source_part"),
        ref["excerpt"].alias("excerpt"),
        F.when(ref.isNotNull(), given.cast("bigint")).alias("occurrence"),
        whole(ref["segment_sequence"]).alias("segment_sequence"),
    ]


def field_mentions(inquiries: DataFrame) -> DataFrame:
    """One row per assessed field of each inquiry, with its value and evidence reference."""

    def mention(name: str, value: Column, ref: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), value.alias("value"), ref.alias("ref"))

    no_ref = F.lit(None).cast(_NO_REF)
    availability = F.when(F.col("availability") != "not_stated", F.col("availability"))
    mentions = F.array(
        mention("carrier_identity", F.col("carrier_name"), F.col("carrier_name_evidence")),
        mention("load_reference", F.col("load_reference"), F.col("load_reference_evidence")),
        mention("equipment", F.col("equipment"), F.col("equipment_evidence")),
        mention("availability", availability, F.col("availability_evidence")),
        mention("intent", F.col("primary_intent"), no_ref),
        F.when(
            F.length("conditions") > 0,
            mention("conditions", F.col("conditions"), F.col("conditions_evidence")),
        ),
    )
    rows = inquiries.select(
        "event_id", "inquiry_id", F.inline(F.filter(mentions, lambda m: m.isNotNull()))
    )
    return rows.select(
        "event_id", "inquiry_id", "field_name", "value", *_ref_columns(F.col("ref"))
    )


def rate_mentions(inquiries: DataFrame) -> DataFrame:
    """One row per rate in document order; the carrier's own positions are chained.

    ``supersedes`` is the index of the carrier position before this one and ``last_position``
    that of the inquiry's last one, both found on the row's own array.
    """
    roles = F.array(*[F.lit(r) for r in vocab.CARRIER_ROLES])
    marked = F.transform(
        F.col("rates"),
        lambda r, i: F.when(F.array_contains(roles, r["role"]), i),
    )
    exploded = inquiries.select(
        "event_id", "inquiry_id", F.filter(marked, lambda x: x.isNotNull()).alias("_carrier"),
        F.posexplode("rates").alias("rate_index", "rate"),
    )
    is_carrier = F.array_contains("_carrier", F.col("rate_index"))
    earlier = F.filter(F.col("_carrier"), lambda x: x < F.col("rate_index"))
    return exploded.select(
        "event_id", "inquiry_id", "rate_index",
        F.concat_ws("/", "inquiry_id", F.col("rate_index").cast("string")).alias("quote_id"),
        F.col("rate.amount").try_cast("decimal(38,10)").try_cast("decimal(12,2)").alias("amount"),
        F.coalesce("rate.currency", F.lit("USD")).alias("currency"),
        F.col("rate.role").alias("quote_type"),
        F.col("rate.basis").alias("rate_basis"),
        F.when(is_carrier, F.array_max(earlier)).alias("supersedes"),
        F.array_max("_carrier").alias("last_position"),
        *_ref_columns(F.col("rate.evidence")),
    )


def ground(rows: DataFrame, emails: DataFrame, segments: DataFrame) -> DataFrame:
    """Locate each reference in the block it names; NULL span columns where it is not there.

    ``emails``: event_id, subject, body_text. ``segments``: event_id, sequence, text,
    start_seconds, end_seconds, confidence. The distinct references travel to the texts: each text
    is shuffled once, by the block that it is, and only offsets leave that stage.
    """
    blocks = emails.select("event_id", F.inline(F.array(
        F.struct(F.lit("subject").alias("source_part"), F.col("subject").alias("_text")),
        F.struct(F.lit("body").alias("source_part"), F.col("body_text").alias("_text")),
    ))).withColumn("_segment", F.lit(-1).cast("bigint")).unionByName(
        segments.select(
            "event_id", F.lit("transcript").alias("source_part"),
            F.col("sequence").cast("bigint").alias("_segment"), F.col("text").alias("_text"),
            "start_seconds", "end_seconds", F.col("confidence").alias("segment_confidence"),
        ), allowMissingColumns=True,
    )
    segment = F.when(F.col("source_part") == "transcript", F.col("segment_sequence"))
    keyed = rows.withColumn("_segment", F.coalesce(segment, F.lit(-1)).cast("bigint"))
    block, reference = ["event_id", "source_part", "_segment"], ["excerpt", "occurrence"]
    asked = keyed.where(F.col("source_part").isin(*EMAIL_PARTS, "transcript")).select(
        *block, *reference
    ).distinct()
    found = asked.join(blocks, block).select(
        *[F.col(c).alias(f"_{c}") for c in (*block, *reference)],
        nth_occurrence(F.col("_text"), F.col("excerpt"), F.col("occurrence")).alias("_start"),
        "start_seconds", "end_seconds", "segment_confidence",
    )
    # rows that name no block keep their event in the key, so missing keys do not pile up
    same = [keyed[c].eqNullSafe(found[f"_{c}"]) for c in (*block, *reference)]
    joined = keyed.join(found, same, "left").drop(*[found[f"_{c}"] for c in (*block, *reference)])
    located = F.col("_start").isNotNull()
    in_email = located & F.col("source_part").isin(*EMAIL_PARTS)
    in_call = located & (F.col("source_part") == "transcript")
    end = F.col("_start") + F.char_length("excerpt")
    span_id = F.when(
        in_email,
        F.concat("event_id", F.lit("#"), "source_part", F.lit(":"), F.col("_start").cast("string"),
                 F.lit("-"), end.cast("string")),
    ).when(
        in_call,
        F.concat("event_id", F.lit("#"), F.col("start_seconds").cast("string"), F.lit("-"),
                 F.col("end_seconds").cast("string")),
    )
    return (
        joined.withColumn("start_offset", F.when(in_email, F.col("_start")))
        .withColumn("end_offset", F.when(in_email, end))
        .withColumn("span_id", span_id)
        .withColumn("start_seconds", F.when(in_call, F.col("start_seconds")))
        .withColumn("end_seconds", F.when(in_call, F.col("end_seconds")))
        .drop("_segment", "_start")
    )


def evidence_spans(grounded: DataFrame) -> DataFrame:
    """Distinct spans: one row per event and stable id."""
    return (
        grounded.where("span_id IS NOT NULL")
        .groupBy("event_id", "span_id")
        .agg(
            F.min(
                F.struct("source_part", "excerpt", "start_offset", "end_offset", "start_seconds",
                         "end_seconds", "segment_sequence")
            ).alias("_s")
        )
        .select("event_id", "span_id", "_s.*")
    )


def field_assessments(grounded_fields: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("value").isNull(), "missing")
        .when(F.col("span_id").isNotNull(), "explicit")
        .otherwise("inferred")
    )
    return grounded_fields.select(
        "inquiry_id", "field_name", status.alias("evidence_status"),
        F.col("value").alias("value_snapshot"),
        F.when(F.col("value").isNotNull(), F.col("span_id")).alias("span_id"),
    )


def quote_supersession(grounded_rates: DataFrame) -> DataFrame:
    """Quotes with their evidence; only the last carrier position can be current."""
    status = F.when(F.col("span_id").isNotNull(), "explicit").otherwise("inferred")
    current = F.coalesce(F.col("rate_index") == F.col("last_position"), F.lit(False))
    return grounded_rates.select(
        "inquiry_id", "rate_index", "quote_id", "amount", "currency", "quote_type", "rate_basis",
        "supersedes", status.alias("evidence_status"),
        (current & F.col("span_id").isNotNull()).alias("is_current"),
        current.alias("is_last_position"),
    )


def rate_assessment(inquiries: DataFrame, quotes: DataFrame) -> DataFrame:
    """The ``rate`` field: the last carrier position, or missing."""
    last = quotes.where("is_last_position").select(
        "inquiry_id", "evidence_status", F.col("amount").cast("string").alias("value_snapshot")
    )
    return inquiries.select("inquiry_id").join(last, "inquiry_id", "left").select(
        "inquiry_id", F.lit("rate").alias("field_name"),
        F.coalesce("evidence_status", F.lit("missing")).alias("evidence_status"),
        "value_snapshot",
    )


def low_confidence(grounded_fields: DataFrame) -> DataFrame:
    """Inquiries where a critical field cites an uncertain transcript segment."""
    critical = F.col("field_name").isin(
        "carrier_identity", "load_reference", "equipment", "availability"
    )
    unsure = (F.col("source_part") == "transcript") & (
        F.col("segment_confidence") < vocab.LOW_CONFIDENCE
    )
    return grounded_fields.where(critical & unsure).select("inquiry_id").distinct()


# -- intervals ------------------------------------------------------------------------------


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of touching or overlapping intervals per key.

    Equal starts are folded first, map-side, so a key holds at most one row per offset of its
    text in the window below, however often passages are cited.
    """
    by_start = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    ordered = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    return (
        by_start.withColumn("_reach", reach)
        .withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(ordered))
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def text_pieces(texts: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """Cut each text into cited and uncited pieces, in order.

    ``spans``: key, start_offset, end_offset. Spans are clipped to the text first.
    """
    lengths = texts.select(key, F.char_length(text).alias("_length"))
    clipped = (
        spans.where("start_offset IS NOT NULL AND end_offset IS NOT NULL")
        .join(lengths, key)
        .select(
            key,
            F.greatest(F.lit(0), F.col("start_offset")).alias("_from"),
            F.least(F.col("_length"), F.col("end_offset")).alias("_to"),
        )
        .where("_to > _from")
    )
    hits = merge_intervals(clipped, [key], "_from", "_to")
    # a text has at most one merged hit per two characters, so this array is bounded by its text
    per_text = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_h"))
    cut = texts.select(key, text).join(per_text, key, "left")
    none = F.array().cast("array<struct<_from:int,_to:int>>")
    hit = F.coalesce(F.col("_h"), none)
    before = F.transform(
        hit,
        lambda h, i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(hit, i)["_to"]).alias("a"),
            h["_from"].alias("b"), F.lit(False).alias("hit"),
        ),
    )
    inside = F.transform(
        hit, lambda h: F.struct(h["_from"].alias("a"), h["_to"].alias("b"), F.lit(True).alias("hit"))
    )
    tail_from = F.when(F.size(hit) == 0, F.lit(0)).otherwise(F.try_element_at(hit, F.lit(-1))["_to"])
    tail = F.array(
        F.struct(tail_from.alias("a"), F.char_length(text).alias("b"), F.lit(False).alias("hit"))
    )
    pieces = F.filter(F.concat(before, inside, tail), lambda p: p["b"] > p["a"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("hit")))
    shown = F.when(F.size(pieces) > 0, pieces).otherwise(whole)
    return cut.select(key, text, F.inline(shown)).select(
        key, F.col("a").alias("start_offset"), F.col("b").alias("end_offset"), "hit",
        F.substring(F.col(text), F.col("a") + 1, F.col("b") - F.col("a")).alias("piece"),
    )


def segment_flags(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments with ``uncertain`` and ``cited`` marks."""
    cited = spans.where("segment_sequence IS NOT NULL").select(
        "event_id", F.col("segment_sequence").cast("int").alias("sequence"),
        F.lit(True).alias("_cited"),
    ).distinct()
    return (
        segments.join(cited, ["event_id", "sequence"], "left")
        .withColumn("cited", F.coalesce("_cited", F.lit(False)))
        .withColumn(
            "uncertain",
            F.coalesce(F.col("confidence") < vocab.LOW_CONFIDENCE, F.lit(False)),
        )
        .drop("_cited")
    )


def segment_order_check(segments: DataFrame, block: int = 4096) -> DataFrame:
    """Transcripts whose segments are empty or go back in time.

    Neighbours are compared inside blocks of sequence numbers first, then between blocks, so
    no task holds a whole transcript.
    """
    rows = segments.withColumn("_block", F.expr(f"sequence div {int(block)}"))
    inside = Window.partitionBy("transcript_id", "_block").orderBy("sequence")
    back = F.col("start_seconds") < F.lag("start_seconds").over(inside)
    blocks = (
        rows.withColumn("_back", F.coalesce(back, F.lit(False)))
        .groupBy("transcript_id", "_block")
        .agg(
            F.bool_or("_back").alias("_back"),
            F.min_by("start_seconds", "sequence").alias("_first"),
            F.max_by("start_seconds", "sequence").alias("_last"),
            F.sum(F.length(F.coalesce("text", F.lit("")))).alias("_chars"),
            F.count("*").alias("_n"),
        )
    )
    across = Window.partitionBy("transcript_id").orderBy("_block")
    step = F.col("_first") < F.lag("_last").over(across)
    return (
        blocks.withColumn("_step", F.coalesce(step, F.lit(False)))
        .groupBy("transcript_id")
        .agg(
            F.sum("_n").alias("segment_count"),
            F.bool_or(F.col("_back") | F.col("_step")).alias("unordered"),
            (F.sum("_chars") == 0).alias("empty"),
        )
        .withColumn(
            "outcome",
            F.when(F.col("unordered") | F.col("empty"), "transcription_failed").otherwise("ok"),
        )
    )
