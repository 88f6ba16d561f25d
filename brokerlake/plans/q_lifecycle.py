"""Queries: job lifecycle, review log, AI operations, evaluation, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brokerlake import schemas
from brokerlake.operators import aiops, jobs as life, matching, review
from brokerlake.plans import q_boards, q_resolution
from brokerlake.plans.oracles import half_even
from brokerlake.plans.q_boards import _EVENTS, _EVENT_ROLES
from brokerlake.plans.q_functions import COSTED, FINGERPRINTS
from brokerlake.plans.q_resolution import _LOAD_MATCH, _SIGNALS, _VALID
from brokerlake.plans.registry import query, scratch
from brokerlake.plans.tables import Tables
from brokerlake.streaming import ingest, job_state as stream_state

NOW = "2024-01-15 12:00:00"


# -- lifecycle ------------------------------------------------------------------------------------


@query("stale_sweep", f""", s AS (
  SELECT *, CASE WHEN status = 'processing' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1800 SECOND
      THEN 'stale_processing'
    WHEN status = 'queued' AND origin = 'manual'
      AND submitted_at < TIMESTAMP '{NOW}' - INTERVAL 900 SECOND THEN 'queue_unavailable' END AS code
  FROM jobs)
SELECT job_id, CASE WHEN code IS NULL THEN status ELSE 'failed' END AS status,
  code IS NOT NULL AS swept, coalesce(code, last_error_code) AS last_error_code FROM s""", ("jobs",))
def stale_sweep(t: Tables) -> DataFrame:
    return life.stale_sweep(t.jobs, F.lit(NOW).cast("timestamp")).select(
        "job_id", "status", "swept", "last_error_code"
    )


@query("dispatch_selection", """
SELECT job_id FROM jobs WHERE status = 'queued' AND snapshot_id = 'snap-1'""", ("jobs",))
def dispatch_selection(t: Tables) -> DataFrame:
    return life.dispatch_selection(t.jobs, "snap-1").select("job_id")


_FAILED = """, failed AS (
  SELECT job_id, coalesce(last_error_code, 'unknown') AS code, retry_count, submitted_at,
    CASE WHEN retry_count >= 3 THEN 'skipped_retry_limit' ELSE 'selected' END AS decision
  FROM jobs WHERE status = 'failed' AND source_type = 'email'
    AND coalesce(last_error_code, '') NOT IN ('unsupported_media', 'invalid_source')
), ordered AS (
  SELECT *, count(*) FILTER (WHERE decision = 'selected') OVER (ORDER BY submitted_at, job_id)
    AS taken FROM failed
), selection AS (
  SELECT * FROM ordered WHERE taken <= 120)
"""


def selection(t: Tables) -> DataFrame:
    return life.retry_selection(t.jobs, snapshot_id="snap-1", source_type="email", max_jobs=120)


@query("retry_selection", _FAILED + "SELECT job_id, decision, code FROM selection", ("jobs",))
def retry_selection(t: Tables) -> DataFrame:
    return selection(t).select("job_id", "decision", "code")


@query("retry_jobs", _FAILED + """
SELECT j.job_id, s.job_id IS NOT NULL AS retried, CASE WHEN s.job_id IS NOT NULL THEN 'queued'
  ELSE j.status END AS status, j.retry_count + cast(s.job_id IS NOT NULL AS integer) AS retry_count
FROM jobs j LEFT JOIN ordered s ON s.job_id = j.job_id AND s.decision = 'selected'""", ("jobs",))
def retry_jobs(t: Tables) -> DataFrame:
    every = life.retry_selection(t.jobs, snapshot_id="snap-1", source_type="email")
    return life.retry_jobs(every, t.jobs).select(
        "job_id", "retried", "status", "retry_count"
    )


@query("job_health", f"""
SELECT count(*) FILTER (WHERE status = 'queued') AS queued,
  count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE status = 'failed') AS failed, cast(0 AS bigint) AS swept_count,
  CASE WHEN bool_or(status = 'failed') THEN 'attention_required'
    WHEN bool_or(status IN ('queued', 'processing')) THEN 'processing' ELSE 'ready' END
    AS processing_health FROM jobs""", ("jobs",))
def job_health(t: Tables) -> DataFrame:
    return life.job_health(t.jobs)


_RESULTS = """, results AS (
  SELECT job_id, user_id, retry_count + n AS generation, job_id || '/' || n AS run_id,
    submitted_at AS created_at, CASE WHEN job_key % 4 = 0 THEN 'invalid' ELSE 'valid' END
    AS validation_status FROM jobs CROSS JOIN (VALUES (0), (1)) v(n)
), fenced AS (
  SELECT r.*, j.job_id IS NOT NULL AS fence_holds FROM results r LEFT JOIN jobs j
    ON j.job_id = r.job_id AND j.retry_count = r.generation AND j.status = 'processing')
"""


def fenced(t: Tables) -> DataFrame:
    results = t.jobs.select(
        "job_id", "user_id", "retry_count",
        F.when(F.col("job_key") % 4 == 0, "invalid").otherwise("valid").alias("validation_status"),
        F.col("submitted_at").alias("created_at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"),
    ).select(
        "job_id", "user_id", (F.col("retry_count") + F.col("n")).alias("generation"),
        F.concat_ws("/", "job_id", "n").alias("run_id"), "created_at", "validation_status",
    )
    return life.generation_fence(results, t.jobs)


@query("generation_fence", _RESULTS + """
SELECT run_id, generation, fence_holds FROM fenced""", ("jobs",))
def generation_fence(t: Tables) -> DataFrame:
    return fenced(t).select("run_id", "generation", "fence_holds")


@query("current_pointer", _RESULTS + """, newest AS (
  SELECT user_id, arg_max(run_id, created_at) AS run_id FROM fenced
  WHERE fence_holds AND validation_status = 'valid' GROUP BY 1)
SELECT f.run_id, n.run_id IS NOT NULL AS is_current FROM fenced f
LEFT JOIN newest n ON n.run_id = f.run_id""", ("jobs",))
def current_pointer(t: Tables) -> DataFrame:
    return life.current_pointer(fenced(t), "user_id").select("run_id", "is_current")


@query("extraction_reuse", """, runs AS (
  SELECT event_id, 'p' || (job_key % 3) AS prompt_version, CASE WHEN source_type = 'call'
    THEN 't' || (job_key % 2) END AS transcript_id, job_key % 5 <> 0 AS is_current,
    job_key % 7 <> 0 AS valid FROM jobs)
SELECT j.event_id, CASE WHEN r.event_id IS NULL THEN 'work' ELSE 'reuse' END AS plan
FROM jobs j LEFT JOIN runs r ON r.event_id = j.event_id AND r.is_current AND r.valid
  AND r.prompt_version = 'p1' AND (j.source_type = 'email' OR r.transcript_id = 't1')""", ("jobs",))
def extraction_reuse(t: Tables) -> DataFrame:
    call = F.col("source_type") == "call"
    events = t.jobs.select(
        "event_id", F.lit("extraction-v1").alias("schema_version"),
        F.lit("p1").alias("prompt_version"), F.lit("m").alias("model"),
        F.when(call, "t1").alias("transcript_id"),
    )
    runs = t.jobs.select(
        "event_id", F.lit("extraction-v1").alias("schema_version"),
        F.concat(F.lit("p"), F.col("job_key") % 3).alias("prompt_version"), F.lit("m").alias("model"),
        F.when(call, F.concat(F.lit("t"), F.col("job_key") % 2)).alias("transcript_id"),
        (F.col("job_key") % 5 != 0).alias("is_current"),
        F.when(F.col("job_key") % 7 != 0, "valid").otherwise("invalid").alias("validation_status"),
    )
    return life.extraction_reuse(events, runs).select("event_id", "plan")


@query("conversation_history", """
SELECT conversation_id, sequence, place FROM (SELECT *, row_number() OVER (
  PARTITION BY conversation_id ORDER BY sequence) AS place FROM messages
  WHERE status = 'completed') WHERE place <= 12""", ("messages",))
def conversation_history(t: Tables) -> DataFrame:
    return life.conversation_history(t.messages).select(
        "conversation_id", "sequence", F.col("place").cast("bigint")
    )


# -- review log -----------------------------------------------------------------------------------

_AUDIT = """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY inquiry_id ORDER BY created_at, action_id) AS n
  FROM review_actions
), folded AS (
  WITH RECURSIVE f AS (
    SELECT inquiry_id, cast(0 AS bigint) AS n, cast(NULL AS varchar) AS action_id,
      cast(NULL AS varchar) AS action_type, cast(NULL AS varchar) AS target_id,
      cast(NULL AS varchar) AS outcome, review_status AS status_before,
      review_status AS status_after, carrier_id AS carrier_before, carrier_id AS carrier_after,
      load_id AS load_before, load_id AS load_after, carrier_pending AS pc, load_pending AS pl,
      other_pending AS po
    FROM review_inquiries
    UNION ALL
    SELECT inquiry_id, n, action_id, action_type, target_id, outcome, status_before,
      CASE WHEN outcome <> 'applied' THEN status_before
        WHEN action_type = 'approve_extraction' THEN 'approved'
        WHEN action_type = 'reject_extraction' THEN 'rejected'
        WHEN action_type = 'reopen_review' THEN 'needs_review'
        WHEN (pc AND action_type <> 'correct_carrier') OR (pl AND action_type <> 'correct_load')
          OR po THEN 'needs_review' ELSE 'approved' END,
      carrier_before, CASE WHEN outcome = 'applied' AND action_type = 'correct_carrier'
        THEN target_id ELSE carrier_before END,
      load_before, CASE WHEN outcome = 'applied' AND action_type = 'correct_load'
        THEN target_id ELSE load_before END,
      pc AND NOT (outcome = 'applied'
        AND action_type IN ('approve_extraction', 'reject_extraction', 'correct_carrier')),
      pl AND NOT (outcome = 'applied'
        AND action_type IN ('approve_extraction', 'reject_extraction', 'correct_load')),
      po AND NOT (outcome = 'applied'
        AND action_type IN ('approve_extraction', 'reject_extraction'))
    FROM (
      SELECT a.inquiry_id, a.n, a.action_id, a.action_type, a.target_id, f.pc, f.pl, f.po,
        f.status_after AS status_before, f.carrier_after AS carrier_before,
        f.load_after AS load_before,
        CASE a.action_type
          WHEN 'approve_extraction' THEN CASE WHEN f.status_after IN ('unreviewed', 'needs_review')
            THEN 'applied' ELSE 'invalid_state' END
          WHEN 'reject_extraction' THEN CASE WHEN f.status_after <> 'rejected' THEN 'applied'
            ELSE 'invalid_state' END
          WHEN 'reopen_review' THEN CASE WHEN f.status_after IN ('approved', 'rejected')
            THEN 'applied' ELSE 'invalid_state' END
          ELSE CASE WHEN f.status_after = 'rejected' THEN 'invalid_state'
            WHEN NOT a.same_snapshot THEN 'snapshot_mismatch' ELSE 'applied' END END AS outcome
      FROM f JOIN numbered a ON a.inquiry_id = f.inquiry_id AND a.n = f.n + 1) x
  ) SELECT * FROM f
), audit AS (SELECT * FROM folded WHERE n > 0)
"""
_REVIEW_ROLES = ("review_inquiries", "review_actions")


def audit(t: Tables) -> DataFrame:
    return review.review_audit(t.review_inquiries, t.review_actions)


@query("review_audit", _AUDIT + """
SELECT inquiry_id, action_id, outcome, status_before, status_after, carrier_before, carrier_after,
  load_before, load_after FROM audit""", _REVIEW_ROLES)
def review_audit(t: Tables) -> DataFrame:
    return audit(t).select(
        "inquiry_id", "action_id", "outcome", "status_before", "status_after", "carrier_before",
        "carrier_after", "load_before", "load_after",
    )


@query("apply_review_actions", _AUDIT + """, ended AS (
  SELECT *, row_number() OVER (PARTITION BY inquiry_id ORDER BY n DESC) AS back FROM folded)
SELECT e.inquiry_id, status_after AS review_status, carrier_after AS carrier_id,
  load_after AS load_id, pc AS carrier_pending, pl AS load_pending, po AS other_pending,
  coalesce(x.cv, false) AS carrier_verified, coalesce(x.lv, false) AS load_verified,
  coalesce(x.applied, 0) AS applied_count
FROM ended e LEFT JOIN (SELECT inquiry_id, count(*) FILTER (WHERE outcome = 'applied') AS applied,
  bool_or(outcome = 'applied' AND action_type = 'correct_carrier') AS cv,
  bool_or(outcome = 'applied' AND action_type = 'correct_load') AS lv FROM audit GROUP BY 1) x
  USING (inquiry_id)
WHERE back = 1""", _REVIEW_ROLES)
def apply_review_actions(t: Tables) -> DataFrame:
    return review.apply_review_actions(t.review_inquiries, audit(t))


@query("match_selection_update", _AUDIT + """, base AS (
  SELECT inquiry_id, carrier_id AS target_id, true AS sel FROM review_inquiries
  UNION ALL SELECT inquiry_id, 'car:5', false FROM review_inquiries WHERE carrier_id <> 'car:5'
), picks AS (
  SELECT inquiry_id, target_id, max(n) AS n FROM audit
  WHERE outcome = 'applied' AND action_type = 'correct_carrier' GROUP BY 1, 2
), final AS (SELECT inquiry_id, arg_max(target_id, n) AS chosen FROM picks GROUP BY 1
), every AS (SELECT inquiry_id, target_id FROM base UNION SELECT inquiry_id, target_id FROM picks)
SELECT e.inquiry_id, e.target_id, CASE WHEN b.target_id IS NULL THEN 'broker_confirmed'
    WHEN b.sel THEN 'mc_number' ELSE 'name_similarity' END AS primary_method,
  CASE WHEN e.target_id = f.chosen THEN 'verified'
    WHEN f.chosen IS NOT NULL AND (p.target_id IS NOT NULL OR b.sel) THEN 'rejected'
    WHEN b.sel THEN 'verified' ELSE 'proposed' END AS status,
  CASE WHEN f.chosen IS NULL THEN b.sel ELSE e.target_id = f.chosen END AS is_selected
FROM every e LEFT JOIN base b ON b.inquiry_id = e.inquiry_id AND b.target_id = e.target_id
LEFT JOIN picks p ON p.inquiry_id = e.inquiry_id AND p.target_id = e.target_id
LEFT JOIN final f ON f.inquiry_id = e.inquiry_id""", _REVIEW_ROLES)
def match_selection_update(t: Tables) -> DataFrame:
    own = t.review_inquiries.select(
        "inquiry_id", F.col("carrier_id").alias("target_id"), F.lit("exact").alias("match_tier"),
        F.lit("mc_number").alias("primary_method"), F.lit("verified").alias("status"),
        F.lit(True).alias("is_selected"), F.lit("deterministic").alias("selection_source"),
    )
    weak = t.review_inquiries.where("carrier_id <> 'car:5'").select(
        "inquiry_id", F.lit("car:5").alias("target_id"), F.lit("weak").alias("match_tier"),
        F.lit("name_similarity").alias("primary_method"), F.lit("proposed").alias("status"),
        F.lit(False).alias("is_selected"), F.lit(None).cast("string").alias("selection_source"),
    )
    rows = review.match_selection_update(own.unionByName(weak), audit(t), "carrier")
    return rows.select("inquiry_id", "target_id", "primary_method", "status", "is_selected")


@query("candidate_reconcile", _AUDIT + """, touched AS (
  SELECT carrier_before AS carrier_id, load_before AS load_id, 'left' AS why FROM audit
  WHERE outcome = 'applied' AND action_type IN ('correct_carrier', 'correct_load')
    AND carrier_before IS NOT NULL AND load_before IS NOT NULL AND carrier_after IS NOT NULL
    AND load_after IS NOT NULL AND (carrier_before <> carrier_after OR load_before <> load_after)
  UNION ALL SELECT carrier_after, load_after, 'joined' FROM audit WHERE outcome = 'applied'
    AND action_type IN ('correct_carrier', 'correct_load') AND carrier_after IS NOT NULL
    AND load_after IS NOT NULL
  UNION ALL SELECT carrier_before, load_before, 'facts_changed' FROM audit
  WHERE outcome = 'applied' AND carrier_before IS NOT NULL AND load_before IS NOT NULL
    AND (action_type = 'reject_extraction'
      OR (action_type = 'reopen_review' AND status_before = 'rejected')))
SELECT carrier_id, load_id, why, count(*) AS times FROM touched GROUP BY ALL""", _REVIEW_ROLES)
def candidate_reconcile(t: Tables) -> DataFrame:
    return review.candidate_reconcile(audit(t))


@query("draft_status", """
SELECT cast(user_id AS varchar) AS draft_id, arg_max(CASE event_type WHEN 'view' THEN 'edited'
  WHEN 'click' THEN 'copied' ELSE 'discarded' END, ts) AS status FROM events GROUP BY 1""")
def draft_status(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "edited").when(
        F.col("event_type") == "click", "copied"
    ).otherwise("discarded")
    log = t.base("events").select(
        F.col("user_id").cast("string").alias("draft_id"), status.alias("status"),
        F.col("ts").alias("at_time"), F.col("event_id").alias("entry_id"),
    )
    return review.draft_status(log)


# -- AI operations ----------------------------------------------------------------------------------


@query("op_rollup", """
SELECT operation_id, count(*) AS call_count, cast(sum(prompt_tokens) AS bigint) AS prompt_tokens,
  cast(sum(completion_tokens) AS bigint) AS completion_tokens,
  cast(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS bigint) AS total_tokens,
  cast(sum(audio_seconds) AS bigint) AS audio_seconds,
  cast(sum(cost_micros) AS bigint) AS cost_micros,
  (epoch_us(max(completed_at)) - epoch_us(min(started_at))) // 1000 AS latency_ms,
  arg_max_null(error_code, sequence) AS last_error_code FROM provider_calls GROUP BY 1""",
       ("provider_calls",))
def op_rollup(t: Tables) -> DataFrame:
    micros = F.col("cost_micros").cast("decimal(14,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    calls = t.provider_calls.withColumn("estimated_cost", micros.cast("decimal(12,6)"))
    return aiops.op_rollup(calls).withColumn(
        "cost_micros", (F.col("estimated_cost") * 1_000_000).cast("bigint")
    ).drop("estimated_cost")


_TOTAL = "(SELECT sum(cost_micros) FROM work)"
_COUNT = "(SELECT count(*) FROM inquiries)"


@query("ai_summary", COSTED + f""", work AS (SELECT * FROM costed WHERE usage_category <> 'evaluation'
), lat AS (
  SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r, count(*) OVER () AS n
  FROM work WHERE latency_ms IS NOT NULL)
SELECT count(*) AS total_inputs, count(*) FILTER (WHERE status = 'needs_review') AS review_count,
  round(100.0 * count(*) FILTER (WHERE status IN ('completed', 'needs_review'))
    / count(*) FILTER (WHERE status IN ('completed', 'needs_review', 'failed')), 6) AS success_rate,
  (SELECT round(avg(latency_ms), 6) FROM work) AS avg_latency_ms,
  (SELECT latency_ms FROM lat WHERE r = (95 * (n - 1)) // 100) AS p95_latency_ms,
  cast({_TOTAL} AS bigint) AS cost_micros, {_COUNT} AS inquiry_count,
  cast({half_even(_TOTAL, f'{_COUNT} * 100')} AS bigint) AS per_inquiry_ten_thousandths,
  (SELECT string_agg(DISTINCT 'extract@' || retry_count, ',' ORDER BY 'extract@' || retry_count)
    FROM jobs WHERE status <> 'failed') AS prompt_versions,
  (SELECT arg_max(job_id, submitted_at) FROM jobs WHERE status = 'completed') AS latest_evaluation
FROM jobs""", ("ai_operations", "jobs", "inquiries"))
def ai_summary(t: Tables) -> DataFrame:
    runs = t.jobs.select(
        (F.col("status") != "failed").alias("is_current"), F.lit("extract").alias("prompt_name"),
        F.col("retry_count").cast("string").alias("prompt_version"),
    )
    evaluations = t.jobs.select(
        F.col("job_id").alias("evaluation_id"), "status",
        F.col("submitted_at").alias("completed_at"),
    )
    row = aiops.ai_summary(
        t.jobs, aiops.op_cost(t.operations), t.inquiries, runs, evaluations
    )
    return row.select(
        "total_inputs", "review_count", F.round("success_rate", 6).alias("success_rate"),
        F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "p95_latency_ms",
        (F.col("total_cost") * 1_000_000).cast("bigint").alias("cost_micros"), "inquiry_count",
        (F.col("cost_per_inquiry") * 10_000).cast("bigint").alias("per_inquiry_ten_thousandths"),
        F.array_join("prompt_versions", ",").alias("prompt_versions"), "latest_evaluation",
    )


_ASSISTANT = """, runs AS (
  SELECT DISTINCT cast(user_id AS varchar) AS run_id, CASE WHEN user_id % 5 = 0 THEN 'failed'
    ELSE 'completed' END AS status FROM events
), tools AS (
  SELECT cast(user_id AS varchar) AS run_id, regexp_extract(props, '[0-9]+', 0) AS source_id,
    CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events
  WHERE event_type IN ('view', 'click', 'error') AND user_id % 8 <> 1
), cites AS (
  SELECT cast(user_id AS varchar) AS run_id, regexp_extract(props, '[0-9]+', 0) AS source_id
  FROM events WHERE event_type = 'purchase' AND user_id % 10 <> 3)
"""


def assistant_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = t.base("events").withColumn("run_id", F.col("user_id").cast("string")).withColumn(
        "source_id", F.regexp_extract("props", "[0-9]+", 0)
    )
    runs = rows.select(
        "run_id", F.when(F.col("user_id") % 5 == 0, "failed").otherwise("completed").alias("status")
    ).distinct()
    tools = rows.where("event_type IN ('view', 'click', 'error') AND user_id % 8 <> 1").select(
        "run_id", "source_id",
        F.when(F.col("event_id") % 4 == 0, "failed").otherwise("completed").alias("status"),
    )
    cites = rows.where("event_type = 'purchase' AND user_id % 10 <> 3").select(
        "run_id", "source_id"
    )
    return runs, tools, cites


@query("citation_validate", _ASSISTANT + """, bad AS (
  SELECT run_id, count(*) AS n FROM cites c WHERE NOT EXISTS (SELECT 1 FROM tools t
    WHERE t.run_id = c.run_id AND t.source_id = c.source_id AND t.status = 'completed') GROUP BY 1)
SELECT r.run_id, coalesce(b.n, 0) AS invalid_citations,
  (SELECT count(*) FROM cites c WHERE c.run_id = r.run_id) AS citations,
  CASE WHEN b.n > 0 OR (EXISTS (SELECT 1 FROM tools t WHERE t.run_id = r.run_id
      AND t.status = 'completed') AND NOT EXISTS (SELECT 1 FROM cites c WHERE c.run_id = r.run_id))
    THEN 'unsupported_citation' ELSE 'ok' END AS outcome
FROM runs r LEFT JOIN bad b USING (run_id)""")
def citation_validate(t: Tables) -> DataFrame:
    return aiops.check_citations(*assistant_tables(t))


@query("assistant_scores", _ASSISTANT + """
SELECT r.run_id, CASE WHEN r.status = 'completed' THEN 1.0::double ELSE 0.0::double END
    AS answer_supported,
  coalesce(round((SELECT count(*) FILTER (WHERE t.status = 'completed') / nullif(count(*), 0) FROM tools t
    WHERE t.run_id = r.run_id), 9), 1.0::double) AS tool_success_rate,
  (SELECT count(*) FROM cites c WHERE c.run_id = r.run_id)::double AS citation_count
FROM runs r""")
def assistant_scores(t: Tables) -> DataFrame:
    return aiops.assistant_scores(*assistant_tables(t)).withColumn(
        "tool_success_rate", F.round("tool_success_rate", 9)
    )


@query("runtime_scores", _EVENTS + """, marks AS (
  SELECT event_id, 'explicit' AS s FROM ev_inq UNION ALL
  SELECT event_id, CASE WHEN review_status = 'unreviewed' THEN 'inferred' ELSE 'missing' END
  FROM ev_inq UNION ALL SELECT event_id, 'inferred' FROM ev_inq WHERE sequence_number = 2
), m AS (
  SELECT event_id, count(*) FILTER (WHERE s = 'explicit') / count(*) AS rate FROM marks
  WHERE s <> 'missing' GROUP BY 1
), q AS (
  SELECT event_id, bool_or(review_status = 'unreviewed') AS c, bool_or(sequence_number = 1) AS l
  FROM ev_inq GROUP BY 1)
SELECT j.event_id AS job_id, cast(e.num % 3 <> 1 AND e.num % 7 <> 2 AS double) AS extraction_valid,
  coalesce(round(m.rate, 9), 0.0::double) AS grounding_rate,
  cast(coalesce(q.c, false) AS double) AS carrier_resolved,
  cast(coalesce(q.l, false) AS double) AS load_resolved,
  cast(j.status = 'needs_review' AS double) AS routed_to_review
FROM ev_jobs j JOIN ev e USING (event_id) LEFT JOIN m USING (event_id) LEFT JOIN q USING (event_id)
WHERE j.status IN ('completed', 'needs_review')""", _EVENT_ROLES)
def runtime_scores(t: Tables) -> DataFrame:
    events, jobs, inquiries = q_boards.event_tables(t)
    runs = events.select(
        "event_id", (F.col("num") % 3 != 1).alias("is_current"),
        F.when(F.col("num") % 7 == 2, "invalid").otherwise("valid").alias("validation_status"),
    )
    fresh = F.col("review_status") == "unreviewed"
    resolved = inquiries.withColumn(
        "carrier_resolution_status", F.when(fresh, "verified").otherwise("needs_review")
    ).withColumn(
        "load_resolution_status",
        F.when(F.col("sequence_number") == 1, "verified").otherwise("unmatched"),
    )
    marks = F.array(
        F.lit("explicit"), F.when(fresh, "inferred").otherwise("missing"),
        F.when(F.col("sequence_number") == 2, "inferred").otherwise("missing"),
    )
    fields = inquiries.select("inquiry_id", F.explode(marks).alias("evidence_status"))
    scores = aiops.runtime_scores(
        jobs.withColumn("job_id", F.col("event_id")), runs, resolved, fields
    )
    return scores.withColumn("grounding_rate", F.round("grounding_rate", 9))


# -- evaluation ---------------------------------------------------------------------------------------


@query("gold_join", """, ev AS (
  SELECT 'CE' || doc_id AS external_source_id, 'email' AS channel, event_id, doc_id FROM emails
  WHERE doc_id % 6 <> 0
)
SELECT g.case_id, e.event_id, CASE WHEN e.event_id IS NOT NULL AND g.doc_id % 5 <> 0
  THEN e.event_id || '#1' END AS inquiry_id,
  CASE WHEN e.event_id IS NULL THEN 'errored' ELSE 'graded' END AS case_state
FROM gold g LEFT JOIN ev e USING (external_source_id, channel)""", ("gold", "emails"))
def gold_join(t: Tables) -> DataFrame:
    events = t.emails.select(
        "event_id", "external_source_id", F.lit("email").alias("channel"), "doc_id"
    )
    inquiries = events.where("doc_id % 5 <> 0").select(
        "event_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("sequence_number")
    ).withColumn("inquiry_id", F.concat_ws("#", "event_id", "sequence_number"))
    return aiops.gold_cases(t.gold, events.drop("doc_id"), inquiries).select(
        "case_id", "event_id", "inquiry_id", "case_state"
    )


def graded(t: Tables) -> DataFrame:
    gold = t.gold.select(
        "case_id", F.concat(F.lit("email:"), "doc_id", F.lit("#1")).alias("inquiry_id"),
        *[F.col(c).alias(f"gold_{c}") for c in (
            "primary_intent", "availability", "equipment_code", "load_reference_digits",
            "mc_number_digits", "mc_garbled", "position_amount", "position_role")],
    )
    return gold.join(q_resolution.inquiries(t), "inquiry_id")


_SCORED = _VALID + """, pred AS (
  SELECT g.*, v.intent, v.availability AS said, v.equipment, v.mc_number,
    nullif(regexp_replace(v.load_reference, '[^0-9]', '', 'g'), '') AS ref_digits, v.load_reference,
    regexp_replace(v.mc_number, '[^0-9]', '', 'g') AS mc_digits,
    CASE WHEN v.doc_id % 3 = 1 THEN v.base_rate + 25.5 ELSE v.base_rate + 40 END AS last_amount,
    CASE WHEN v.doc_id % 3 = 1 THEN 'carrier_quote' ELSE 'carrier_counteroffer' END AS last_role,
    CASE lower(trim(v.equipment)) WHEN 'box truck' THEN 'box_truck'
      WHEN 'sprinter van' THEN 'sprinter_van' WHEN 'flatbed' THEN 'flatbed' END AS equipment_found
  FROM gold g JOIN valid v USING (doc_id)
), checked AS (
  SELECT *, [x FOR x IN [CASE WHEN mc_number_digits IS NOT NULL AND mc_number IS NOT NULL THEN 0 END,
    CASE WHEN load_reference_digits IS NOT NULL AND load_reference IS NOT NULL THEN 1 END,
    CASE WHEN equipment_code IS NOT NULL AND equipment IS NOT NULL THEN 1 END,
    CASE WHEN availability <> 'not_stated' AND said <> 'not_stated' THEN 0 END]
    IF x IS NOT NULL] AS checks FROM pred
), scored AS (
  SELECT case_id, 0 AS seq, 'intent' AS metric, 'intent_classification' AS category,
    intent = primary_intent AS passed, cast(NULL AS double) AS value FROM checked
  UNION ALL SELECT case_id, 1, 'availability', 'availability', said = availability, NULL FROM checked
  UNION ALL SELECT case_id, 2, 'equipment', 'equipment_normalization',
    equipment_found IS NOT DISTINCT FROM equipment_code, NULL FROM checked
  UNION ALL SELECT case_id, 3, 'load_reference', 'identifier_extraction',
    ref_digits IS NOT DISTINCT FROM load_reference_digits, NULL FROM checked
  UNION ALL SELECT case_id, 4, 'mc_number', 'identifier_extraction', CASE WHEN NOT mc_garbled
    THEN mc_digits IS NOT DISTINCT FROM mc_number_digits END, NULL FROM checked
  UNION ALL SELECT case_id, 5, 'rate_value', 'rate_extraction',
    position_amount IS NOT NULL AND last_amount = cast(position_amount AS double), NULL FROM checked
  UNION ALL SELECT case_id, 6, 'rate_role', 'rate_role_confusion', CASE WHEN position_amount
    IS NOT NULL AND last_amount = cast(position_amount AS double) THEN last_role = position_role END,
    NULL FROM checked
  UNION ALL SELECT case_id, 7, 'grounding_rate', 'evidence_grounding', CASE WHEN len(checks) > 0
    THEN list_sum(checks) / len(checks) >= 0.75 END,
    CASE WHEN len(checks) > 0 THEN round(list_sum(checks) / len(checks), 9) END FROM checked)
"""
_SCORE_ROLES = ("gold", "extraction_parts")


def scores(t: Tables) -> DataFrame:
    return aiops.evaluate_extraction(graded(t))


@query("evaluate_extraction", _SCORED + """
SELECT case_id, seq, metric, category, passed, value FROM scored""", _SCORE_ROLES)
def evaluate_extraction(t: Tables) -> DataFrame:
    return scores(t).select(
        "case_id", "seq", "metric", "category", "passed", F.round("value", 9).alias("value")
    )


@query("eval_metrics", _SCORED + """, m AS (
  SELECT metric, count(*) FILTER (WHERE passed) AS passed,
    count(*) FILTER (WHERE NOT passed) AS failed,
    count(*) FILTER (WHERE passed IS NULL) AS not_applicable FROM scored GROUP BY 1
), a AS (
  SELECT *, CASE WHEN passed + failed > 0 THEN round_even(passed / (passed + failed), 4) END
    AS accuracy FROM m)
SELECT *, (SELECT round_even(avg(accuracy), 4) FROM a) AS score FROM a""", _SCORE_ROLES)
def eval_metrics(t: Tables) -> DataFrame:
    # one row per metric: at most ten rows meet in this window
    average = F.avg("accuracy").over(Window.partitionBy())
    return aiops.eval_metrics(scores(t)).withColumn("score", F.bround(average, 4))


@query("eval_case_rollup", _SCORED + """
SELECT case_id, CASE WHEN bool_or(NOT passed) THEN 'failed' ELSE 'passed' END AS status,
  coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (WHERE NOT passed))), ','),
    '') AS failure_categories,
  coalesce(string_agg(metric, '; ' ORDER BY seq) FILTER (WHERE NOT passed), '') AS failed_metrics
FROM scored GROUP BY 1""", _SCORE_ROLES)
def eval_case_rollup(t: Tables) -> DataFrame:
    return aiops.eval_cases(scores(t)).select(
        "case_id", "status", "failure_categories",
        F.regexp_replace("failure_analysis", ": expected .*?(?=; [a-z_]+: expected |$)", "")
        .alias("failed_metrics"),
    )


_RUN = _SCORED + """, run AS (
  SELECT g.case_id, CASE WHEN count(s.case_id) = 0 THEN 'errored'
    WHEN bool_or(NOT s.passed) THEN 'failed' ELSE 'passed' END AS status,
    coalesce(array_to_string(list_sort(list_distinct(list(s.category) FILTER (WHERE NOT s.passed))),
      ','), '') AS failure_categories
  FROM gold g LEFT JOIN scored s USING (case_id) GROUP BY 1)
"""


def run_cases(t: Tables) -> DataFrame:
    return aiops.eval_run_cases(t.gold, aiops.eval_cases(scores(t)))


@query("eval_run_cases", _RUN + "SELECT * FROM run", _SCORE_ROLES)
def eval_run_cases(t: Tables) -> DataFrame:
    """Every gold case; ``eval_case_rollup`` has those with a valid extraction."""
    return run_cases(t).select("case_id", "status", "failure_categories")


@query("eval_run_totals", _RUN + """
SELECT count(*) AS cases_total, count(*) FILTER (WHERE status = 'passed') AS cases_passed,
  count(*) FILTER (WHERE status = 'failed') AS cases_failed,
  count(*) FILTER (WHERE status = 'errored') AS cases_errored FROM run""", _SCORE_ROLES)
def eval_run_totals(t: Tables) -> DataFrame:
    return aiops.eval_run_totals(run_cases(t))


@query("evaluate_resolution", _SIGNALS + _LOAD_MATCH + """, cases AS (
  SELECT g.*, coalesce(i.n, 0) = 1 AS carrier_ok, m.load_resolution_status AS load_status,
    EXISTS (SELECT 1 FROM carriers c WHERE regexp_replace(c.mc_number_raw, '[^0-9]', '', 'g')
      = g.mc_number_digits) AS mc_known,
    EXISTS (SELECT 1 FROM loads l WHERE l.load_id = g.load_reference_digits) AS load_known
  FROM gold g JOIN load_match m ON m.inquiry_id = 'email:' || g.doc_id
  LEFT JOIN ident i ON i.inquiry_id = m.inquiry_id)
SELECT case_id, 'carrier_resolution' AS metric, CASE WHEN mc_known THEN carrier_ok END AS passed
FROM cases
UNION ALL SELECT case_id, 'load_resolution', CASE WHEN load_reference_digits IS NULL
    THEN load_status = 'unmatched' WHEN load_known THEN load_status = 'verified'
    ELSE load_status <> 'verified' END FROM cases""",
       ("gold", "extraction_parts", "carriers", "carrier_contacts", "loads"))
def evaluate_resolution(t: Tables) -> DataFrame:
    found = q_resolution.exact(t).select("inquiry_id", F.col("identity").alias("carrier_status"))
    placed = matching.match_load(q_resolution.proposed(t), t.loads).select(
        "inquiry_id", F.col("load_resolution_status").alias("load_status")
    )
    cases = t.gold.select(
        "case_id", F.concat(F.lit("email:"), "doc_id").alias("inquiry_id"),
        F.col("mc_number_digits").alias("gold_mc_number_digits"),
        F.col("load_reference_digits").alias("gold_load_reference_digits"),
    ).join(found, "inquiry_id").join(placed, "inquiry_id")
    return aiops.evaluate_resolution(cases, q_resolution.directory(t), t.loads).select(
        "case_id", "metric", "passed"
    )


# -- streaming ----------------------------------------------------------------------------------------


@query("stream_ingest", FINGERPRINTS + """
SELECT content_fingerprint, cast(1 AS bigint) AS copies FROM printed GROUP BY 1""", ("emails",))
def stream_ingest(t: Tables) -> DataFrame:
    """Emails delivered twice as files; every content is taken in once."""
    folder = scratch(t.spark)
    sent = t.emails.select(
        "event_id", "sender_email_raw", "subject", "body_text",
        F.col("received_at").alias("submitted_at"),
    )
    # one batch per delivery, however many files it has
    for _ in range(2):
        sent.write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(schemas.SUBMISSION).parquet(f"{folder}/in")
        ingest.start_ingest(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out/events").groupBy("content_fingerprint").agg(
        F.count("*").alias("copies")
    )


_JOB_FOLD = """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_time, seq_key) AS n
  FROM job_transitions
), folded AS (
  WITH RECURSIVE f AS (
    SELECT DISTINCT job_id, cast(0 AS bigint) AS n, 'queued' AS status, 0 AS retry_count,
      cast(0 AS bigint) AS ignored_count FROM job_transitions
    UNION ALL
    SELECT job_id, n, CASE WHEN NOT ok THEN status WHEN transition = 'claim' THEN 'processing'
        WHEN transition = 'complete' THEN 'completed' WHEN transition = 'needs_review'
        THEN 'needs_review' WHEN transition = 'fail' THEN 'failed' ELSE 'queued' END,
      retry_count + CASE WHEN ok AND transition = 'retry' THEN 1 ELSE 0 END,
      ignored_count + CASE WHEN ok THEN 0 ELSE 1 END
    FROM (SELECT a.job_id, a.n, a.transition, f.status, f.retry_count, f.ignored_count,
        CASE a.transition WHEN 'claim' THEN f.status = 'queued'
          WHEN 'retry' THEN f.status = 'failed' AND f.retry_count < 3
          ELSE f.status = 'processing' END AS ok
      FROM f JOIN numbered a ON a.job_id = f.job_id AND a.n = f.n + 1) x
  ) SELECT * FROM f
), ended AS (
  SELECT job_id, arg_max(status, n) AS status, arg_max(retry_count, n) AS retry_count,
    arg_max(ignored_count, n) AS ignored_count, max(n) AS transition_count FROM folded GROUP BY 1)
"""


@query("job_state_fold", _JOB_FOLD + "SELECT * FROM ended", ("job_transitions",))
def job_state_fold(t: Tables) -> DataFrame:
    return life.job_state(t.job_transitions, [F.col("at_time").asc(), F.col("seq_key").asc()])


@query("stream_job_state", _JOB_FOLD + "SELECT job_id, status, retry_count FROM ended",
       ("job_transitions",))
def stream_job_state(t: Tables) -> DataFrame:
    """The log in three deliveries, a transition up to half the lateness out of order in them."""
    folder = scratch(t.spark)
    log = t.job_transitions.select("job_id", "transition", "at_time", "seq_key")
    start, end = log.agg(
        F.min(F.unix_seconds("at_time")), F.max(F.unix_seconds("at_time"))
    ).first()
    lateness, deliveries = 86_400, 3
    width = (end or 0) - (start or 0) + lateness // 2 + 1
    sent = F.unix_seconds("at_time") + F.pmod(F.xxhash64("seq_key"), F.lit(lateness // 2))
    part = F.coalesce(F.floor((sent - F.lit(start)) * deliveries / width), F.lit(0))

    def store(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    # each run of the query goes on from its checkpoint
    for number in range(deliveries):
        log.where(part == number).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(schemas.JOB_TRANSITION).parquet(f"{folder}/in")
        (
            stream_state.job_state_stream(stream, None, lateness).writeStream.foreachBatch(store)
            .outputMode("update").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start().awaitTermination()
        )
    states = t.spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return stream_state.latest_states(states).select("job_id", "status", "retry_count")
