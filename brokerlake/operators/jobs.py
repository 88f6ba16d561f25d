"""Job lifecycle: sweep, retry, fence, health, transitions and roll-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.operators import statefold

# -- batch operators --------------------------------------------------------------------------


def stale_code(now: Column) -> Column:
    """Error code with which a job is swept at ``now``, or NULL."""
    late = lambda column, seconds: (
        F.col(column) < now - F.expr(f"interval {seconds} seconds")
    )
    processing = (F.col("status") == "processing") & late(
        "started_at", vocab.STALE_PROCESSING_SECONDS
    )
    queued = (
        (F.col("status") == "queued")
        & (F.col("origin") == "manual")
        & late("submitted_at", vocab.STALE_QUEUED_SECONDS)
    )
    return F.when(processing, "stale_processing").when(queued, "queue_unavailable")


def stale_sweep(jobs: DataFrame, now: Column) -> DataFrame:
    """All jobs after the sweep, with ``swept`` marking those it failed."""
    code = stale_code(now)
    return (
        jobs.withColumn("_code", code)
        .withColumn("swept", F.col("_code").isNotNull())
        .withColumn("status", F.when(F.col("swept"), "failed").otherwise(F.col("status")))
        .withColumn("last_error_code", F.coalesce("_code", "last_error_code"))
        .withColumn("completed_at", F.when(F.col("swept"), now))
        .drop("_code")
    )


def dispatch_selection(jobs: DataFrame, snapshot_id: str) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & (F.col("snapshot_id") == snapshot_id))


def retryable() -> Column:
    permanent = F.coalesce(
        F.col("last_error_code").isin(*vocab.PERMANENT_ERROR_CODES), F.lit(False)
    )
    return (
        (F.col("status") == "failed") & ~permanent
        & (F.col("retry_count") < vocab.MAX_JOB_RETRIES)
    )


def retry_selection(
    jobs: DataFrame,
    snapshot_id: str | None = None,
    source_type: str | None = None,
    error_codes: tuple[str, ...] = (),
    max_jobs: int | None = None,
) -> DataFrame:
    """Failed jobs in submission order with ``decision`` selected or skipped_retry_limit.

    With ``max_jobs`` the scan ends at the first job that no longer fits. That job is found by a
    top-k, not by a global window.
    """
    chosen = jobs.where("status = 'failed'")
    if snapshot_id is not None:
        chosen = chosen.where(F.col("snapshot_id") == snapshot_id)
    if source_type is not None:
        chosen = chosen.where(F.col("source_type") == source_type)
    if error_codes:
        chosen = chosen.where(F.col("last_error_code").isin(*error_codes))
    else:
        chosen = chosen.where(
            ~F.coalesce(F.col("last_error_code").isin(*vocab.PERMANENT_ERROR_CODES), F.lit(False))
        )
    at_limit = F.col("retry_count") >= vocab.MAX_JOB_RETRIES
    decided = chosen.withColumn(
        "decision", F.when(at_limit, "skipped_retry_limit").otherwise("selected")
    ).withColumn("code", F.coalesce("last_error_code", F.lit("unknown")))
    if max_jobs is None:
        return decided
    order = F.struct("submitted_at", "job_id")
    first = decided.where("decision = 'selected'").orderBy("submitted_at", "job_id")
    # one row: how many could be taken, and the first job that no longer fits
    bound = first.limit(max_jobs + 1).agg(
        F.max(order).alias("_stop"), F.count("*").alias("_n"), F.lit(1).alias("_one")
    )
    within = (F.col("_n") <= max_jobs) | (order < F.col("_stop"))
    return (
        decided.withColumn("_one", F.lit(1)).join(F.broadcast(bound), "_one").where(within)
        .drop("_one", "_stop", "_n")
    )


def retry_counts(selection: DataFrame) -> DataFrame:
    return selection.groupBy("decision", "code").agg(F.count("*").alias("jobs"))


def retry_jobs(selection: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs after requeueing the selected ones that are still failed and under the limit."""
    picked = selection.where("decision = 'selected'").select("job_id").distinct().withColumn(
        "_picked", F.lit(True)
    )
    may = (
        F.coalesce("_picked", F.lit(False))
        & (F.col("status") == "failed")
        & (F.col("retry_count") < vocab.MAX_JOB_RETRIES)
    )
    return (
        jobs.join(picked, "job_id", "left")
        .withColumn("retried", may)
        .withColumn("status", F.when(may, "queued").otherwise(F.col("status")))
        .withColumn("retry_count", F.col("retry_count") + F.when(F.col("retried"), 1).otherwise(0))
        .drop("_picked")
    )


def generation_fence(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mark which results still count: job processing and same retry generation."""
    holders = jobs.where("status = 'processing'").select(
        "job_id", F.col("retry_count").alias("generation"), F.lit(True).alias("_holds")
    )
    return (
        results.join(holders, ["job_id", "generation"], "left")
        .withColumn("fence_holds", F.coalesce("_holds", F.lit(False)))
        .drop("_holds")
    )


def current_pointer(fenced: DataFrame, key: str) -> DataFrame:
    """All runs with ``is_current``: the newest valid, fence-holding run of its key."""
    counts = F.col("fence_holds") & (F.col("validation_status") == "valid")
    newest = (
        fenced.where(counts).groupBy(key)
        .agg(F.max(F.struct("created_at", "run_id")).getField("run_id").alias("_current"))
    )
    return (
        fenced.join(newest, key, "left")
        .withColumn(
            "is_current", counts & F.coalesce(F.col("run_id") == F.col("_current"), F.lit(False))
        )
        .drop("_current")
    )


def extraction_reuse(events: DataFrame, runs: DataFrame) -> DataFrame:
    """``plan``: reuse for events whose current valid run matches the wanted configuration.

    ``events``: event_id, schema_version, prompt_version, model, transcript_id (NULL for emails).
    """
    keys = ["event_id", "schema_version", "prompt_version", "model"]
    usable = (
        runs.where("is_current AND validation_status = 'valid'")
        .select(*keys, F.col("transcript_id").alias("_of"), F.lit(True).alias("_has"))
    )
    joined = events.join(usable, keys, "left")
    same = F.col("transcript_id").isNull() | F.coalesce(
        F.col("transcript_id") == F.col("_of"), F.lit(False)
    )
    fits = F.coalesce("_has", F.lit(False)) & same
    wanted = events.columns
    return joined.groupBy(*wanted).agg(
        F.when(F.bool_or(fits), "reuse").otherwise("work").alias("plan")
    )


def job_health(jobs: DataFrame, swept: DataFrame | None = None) -> DataFrame:
    """Zero-filled counts by state and the overall health, as one row."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in vocab.JOB_STATUS]
    sweep = F.count_if(F.col("swept")) if "swept" in jobs.columns else F.lit(0)
    row = jobs.agg(*counts, sweep.cast("long").alias("swept_count"))
    return row.withColumn(
        "processing_health",
        F.when((F.col("failed") > 0) | (F.col("swept_count") > 0), "attention_required")
        .when((F.col("queued") > 0) | (F.col("processing") > 0), "processing")
        .otherwise("ready"),
    )


def job_review_rollup(jobs: DataFrame, inquiries: DataFrame) -> DataFrame:
    """completed and needs_review follow the event's inquiries; other states stay."""
    flagged = inquiries.groupBy("event_id").agg(
        F.bool_or(F.col("review_status") == "needs_review").alias("_flag")
    )
    terminal = F.col("status").isin("completed", "needs_review")
    target = F.when(F.coalesce("_flag", F.lit(False)), "needs_review").otherwise("completed")
    return (
        jobs.join(flagged, "event_id", "left")
        .withColumn("rolled_status", F.when(terminal, target).otherwise(F.col("status")))
        .drop("_flag")
    )


# -- transitions as a fold ------------------------------------------------------------------------

TRANSITIONS = ("claim", "complete", "needs_review", "fail", "retry")


def next_state(transition: str, status: str, retries: int):
    """(status, retry count) after a legal transition, else None."""
    if transition == "claim":
        return ("processing", retries) if status == "queued" else None
    if transition == "retry":
        may = status == "failed" and retries < vocab.MAX_JOB_RETRIES
        return ("queued", retries + 1) if may else None
    if status != "processing":
        return None
    return {"complete": "completed", "needs_review": "needs_review", "fail": "failed"}[
        transition
    ], retries


def transition_table() -> np.ndarray:
    """table[transition, status * 4 + retries] = (next, accepted)."""
    width = len(vocab.JOB_STATUS) * (vocab.MAX_JOB_RETRIES + 1)
    step = vocab.MAX_JOB_RETRIES + 1
    table = np.zeros((len(TRANSITIONS), width, 2), dtype=np.int64)
    for code, name in enumerate(TRANSITIONS):
        for state in range(width):
            after = next_state(name, vocab.JOB_STATUS[state // step], state % step)
            table[code, state] = (
                (state, 0) if after is None
                else (vocab.JOB_STATUS.index(after[0]) * step + after[1], 1)
            )
    return table


def job_state(transitions: DataFrame, order: list[Column]) -> DataFrame:
    """Final status, retry count and ignored transitions of each job from its transition log."""
    initial = transitions.select("job_id").distinct().select(
        "job_id", F.lit(0).alias("start_state"),
        F.array().cast("array<string>").alias("start_slots"),
    )
    names = F.array(*[F.lit(n) for n in TRANSITIONS])
    folded = statefold.fold(
        transitions, "job_id", order, F.array_position(names, F.col("transition")) - 1,
        transition_table(), initial,
    )
    step = vocab.MAX_JOB_RETRIES + 1
    place = F.struct("at_time", "seq_key")
    statuses = F.array(*[F.lit(s) for s in vocab.JOB_STATUS])
    return (
        folded.groupBy("job_id")
        .agg(
            F.max_by("state_after", place).alias("_end"),
            F.count_if(~F.col("accepted")).alias("ignored_count"),
            F.count("*").alias("transition_count"),
        )
        .select(
            "job_id",
            F.element_at(statuses, (F.floor(F.col("_end") / step) + 1).cast("int"))
            .alias("status"),
            (F.col("_end") % step).alias("retry_count"),
            "ignored_count", "transition_count",
        )
    )


def conversation_history(messages: DataFrame, limit: int = vocab.CONVERSATION_LIMIT) -> DataFrame:
    """The first completed messages of each conversation, in order."""
    # a limit on row_number is applied before the shuffle too, so long threads stay cheap
    place = Window.partitionBy("conversation_id").orderBy("sequence")
    return (
        messages.where("status = 'completed'")
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= limit)
    )


