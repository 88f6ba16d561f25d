"""The broker's review log applied to inquiries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.operators import statefold

# A state is the review status (0-3, in vocabulary order) and three bits for review reasons that
# are still open: carrier, load and other.
_STATUS = vocab.REVIEW_STATUS
_CARRIER, _LOAD, _OTHER = 1, 2, 4
_ACTION_COUNT = len(vocab.REVIEW_ACTIONS)


def _step(action: str, same_snapshot: bool, status: str, open_bits: int):
    """(status, open bits) after a valid action, or None when the action is refused."""
    if action == "approve_extraction":
        return ("approved", 0) if status in ("unreviewed", "needs_review") else None
    if action == "reject_extraction":
        return ("rejected", 0) if status != "rejected" else None
    if action == "reopen_review":
        return ("needs_review", open_bits) if status in ("approved", "rejected") else None
    if status == "rejected" or not same_snapshot:
        return None
    left = open_bits & ~(_CARRIER if action == "correct_carrier" else _LOAD)
    return ("needs_review" if left else "approved", left)


def transition_table() -> np.ndarray:
    """table[action + 5 * other_snapshot, status * 8 + bits] = (next state, accepted)."""
    table = np.zeros((2 * _ACTION_COUNT, 32, 2), dtype=np.int64)
    for foreign in (0, 1):
        for number, action in enumerate(vocab.REVIEW_ACTIONS):
            for state in range(32):
                after = _step(action, not foreign, _STATUS[state // 8], state % 8)
                code = number + foreign * _ACTION_COUNT
                table[code, state] = (
                    (state, 0) if after is None
                    else (_STATUS.index(after[0]) * 8 + after[1], 1)
                )
    return table


def _index_of(column: Column, options) -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in options]), column).cast("int") - 1


def review_audit(inquiries: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per action: outcome and the inquiry's state before and after it.

    ``inquiries``: inquiry_id, review_status, carrier_pending, load_pending, other_pending,
    carrier_id, load_id, carrier_resolution_status, load_resolution_status.
    ``actions``: inquiry_id, action_id, action_type, target_id, same_snapshot, created_at.
    """
    bit = lambda name, value: F.when(F.col(name), value).otherwise(0)
    initial = inquiries.select(
        "inquiry_id",
        (
            _index_of(F.col("review_status"), _STATUS) * 8
            + bit("carrier_pending", _CARRIER) + bit("load_pending", _LOAD)
            + bit("other_pending", _OTHER)
        ).alias("start_state"),
        F.array("carrier_id", "load_id").alias("start_slots"),
    )
    correction = F.col("action_type").isin("correct_carrier", "correct_load")
    foreign = correction & ~F.col("same_snapshot")
    code = _index_of(F.col("action_type"), vocab.REVIEW_ACTIONS) + F.when(
        foreign, _ACTION_COUNT
    ).otherwise(0)
    slot = (
        F.when(F.col("action_type") == "correct_carrier", 0)
        .when(F.col("action_type") == "correct_load", 1).otherwise(-1)
    )
    folded = statefold.fold(
        actions, "inquiry_id", [F.col("created_at").asc(), F.col("action_id").asc()], code,
        transition_table(), initial, slot=slot, value=F.col("target_id"), slots=2,
    )
    status = lambda c: F.element_at(
        F.array(*[F.lit(s) for s in _STATUS]), (F.floor(F.col(c) / 8) + 1).cast("int")
    )
    before = {"carrier": F.col("slots_before")[0], "load": F.col("slots_before")[1]}
    took = lambda kind: F.col("accepted") & (F.col("action_type") == f"correct_{kind}")
    refused = F.when(
        F.col("action_type").isin("correct_carrier", "correct_load")
        & (status("state_before") != "rejected"),
        "snapshot_mismatch",
    ).otherwise("invalid_state")
    return folded.select(
        "inquiry_id", "action_id", "action_type", "target_id", "created_at",
        F.when(F.col("accepted"), "applied").otherwise(refused).alias("outcome"),
        status("state_before").alias("status_before"),
        status("state_after").alias("status_after"),
        before["carrier"].alias("carrier_before"),
        F.when(took("carrier"), F.col("target_id")).otherwise(before["carrier"])
        .alias("carrier_after"),
        before["load"].alias("load_before"),
        F.when(took("load"), F.col("target_id")).otherwise(before["load"]).alias("load_after"),
        (F.col("state_after") % 8).alias("open_after"),
    )


def apply_review_actions(inquiries: DataFrame, audit: DataFrame) -> DataFrame:
    """Inquiries after their whole log. Max-by combines map-side, so hot inquiries are fine."""
    order = F.struct("created_at", "action_id")
    last = audit.groupBy("inquiry_id").agg(
        F.max_by(
            F.struct("status_after", "carrier_after", "load_after", "open_after"), order
        ).alias("_end"),
        F.count_if(F.col("outcome") == "applied").alias("applied_count"),
        F.bool_or((F.col("outcome") == "applied") & (F.col("action_type") == "correct_carrier"))
        .alias("carrier_verified"),
        F.bool_or((F.col("outcome") == "applied") & (F.col("action_type") == "correct_load"))
        .alias("load_verified"),
    )
    acted = F.col("_end").isNotNull()
    keep = lambda new, old: F.when(acted, new).otherwise(old)
    end_open = F.col("_end.open_after")
    pending = lambda name, bit: keep(
        end_open.bitwiseAND(F.lit(bit)) > 0, F.col(name)
    )
    return inquiries.join(last, "inquiry_id", "left").select(
        "inquiry_id",
        keep(F.col("_end.status_after"), F.col("review_status")).alias("review_status"),
        keep(F.col("_end.carrier_after"), F.col("carrier_id")).alias("carrier_id"),
        keep(F.col("_end.load_after"), F.col("load_id")).alias("load_id"),
        pending("carrier_pending", _CARRIER).alias("carrier_pending"),
        pending("load_pending", _LOAD).alias("load_pending"),
        pending("other_pending", _OTHER).alias("other_pending"),
        F.coalesce("carrier_verified", F.lit(False)).alias("carrier_verified"),
        F.coalesce("load_verified", F.lit(False)).alias("load_verified"),
        F.coalesce("applied_count", F.lit(0)).alias("applied_count"),
    )


def match_selection_update(matches: DataFrame, audit: DataFrame, kind: str) -> DataFrame:
    """Match rows after the log's corrections: the last pick is selected, others it replaced are
    rejected, and a carrier or load never proposed before becomes a new broker-confirmed row.

    ``matches``: inquiry_id, target_id, match_tier, primary_method, status, is_selected,
    selection_source.
    """
    picked = audit.where(
        (F.col("outcome") == "applied") & (F.col("action_type") == f"correct_{kind}")
    )
    final = picked.groupBy("inquiry_id").agg(
        F.max_by("target_id", F.struct("created_at", "action_id")).alias("chosen")
    )
    ever = picked.select("inquiry_id", "target_id").distinct().withColumn("_picked", F.lit(True))
    method = "broker_confirmed" if kind == "carrier" else "corrected_reference"
    joined = matches.withColumn("_known", F.lit(True)).join(
        ever, ["inquiry_id", "target_id"], "full"
    ).join(final, "inquiry_id", "left")
    chosen = F.coalesce(F.col("target_id") == F.col("chosen"), F.lit(False))
    was = F.coalesce("is_selected", F.lit(False)) | F.coalesce("_picked", F.lit(False))
    replaced = F.col("chosen").isNotNull() & was & ~chosen
    return joined.select(
        "inquiry_id", "target_id",
        F.coalesce("match_tier", F.lit("exact")).alias("match_tier"),
        F.coalesce("primary_method", F.lit(method)).alias("primary_method"),
        F.when(chosen, "verified").when(replaced, "rejected").otherwise(F.col("status"))
        .alias("status"),
        F.when(F.col("chosen").isNotNull(), chosen)
        .otherwise(F.coalesce("is_selected", F.lit(False))).alias("is_selected"),
        F.when(F.coalesce("_picked", F.lit(False)), "broker").otherwise(F.col("selection_source"))
        .alias("selection_source"),
    )


def candidate_reconcile(audit: DataFrame) -> DataFrame:
    """(carrier, load) pairs to reassess because the log touched them, with the reason."""
    applied = audit.where("outcome = 'applied'")
    both = lambda c, l: F.when(
        c.isNotNull() & l.isNotNull(), F.struct(c.alias("carrier_id"), l.alias("load_id"))
    )
    before = both(F.col("carrier_before"), F.col("load_before"))
    after = both(F.col("carrier_after"), F.col("load_after"))
    correction = F.col("action_type").isin("correct_carrier", "correct_load")
    rejected = F.col("action_type") == "reject_extraction"
    revived = (F.col("action_type") == "reopen_review") & (F.col("status_before") == "rejected")
    moved = correction & after.isNotNull() & before.isNotNull() & (before != after)
    touched = F.array(
        F.when(moved, F.struct(F.lit("left").alias("why"), before.alias("pair"))),
        F.when(correction & after.isNotNull(),
               F.struct(F.lit("joined").alias("why"), after.alias("pair"))),
        F.when((rejected | revived) & before.isNotNull(),
               F.struct(F.lit("facts_changed").alias("why"), before.alias("pair"))),
    )
    rows = applied.select("inquiry_id", F.inline(F.filter(touched, lambda t: t.isNotNull())))
    return rows.select("why", "pair.*").groupBy("carrier_id", "load_id", "why").agg(
        F.count("*").alias("times")
    )


def draft_status(log: DataFrame) -> DataFrame:
    """Last writer wins per draft."""
    order = F.struct("at_time", "entry_id")
    return log.groupBy("draft_id").agg(F.max_by("status", order).alias("status"))
