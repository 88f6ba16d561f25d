"""Cost accounting, usage summaries and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake import vocab
from brokerlake.functions import money
from brokerlake.functions.text import casefold, digits, strip
from brokerlake.scale import lower_nearest_rank

# -- cost ---------------------------------------------------------------------------------------


def op_cost(calls: DataFrame) -> DataFrame:
    """Add ``estimated_cost`` from the price list; an unpriced model or unknown length is NULL.

    The price list is a handful of constants, so it is a CASE and needs no join.
    """
    model = F.col("model")
    cost = F.lit(None).cast("decimal(12,6)")
    for name, (per_in, per_out) in vocab.TOKEN_PRICES.items():
        cost = F.when(
            model == name,
            money.token_cost(
                F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(per_in), F.lit(per_out)
            ),
        ).otherwise(cost)
    for name, per_minute in vocab.AUDIO_PRICES.items():
        cost = F.when(
            model == name, money.audio_cost(F.col("audio_seconds"), F.lit(per_minute))
        ).otherwise(cost)
    return calls.withColumn("estimated_cost", cost)


def op_rollup(calls: DataFrame) -> DataFrame:
    """Per operation: calls, tokens, seconds of audio, cost, whole milliseconds, the last call's error."""
    started, completed = F.min("started_at"), F.max("completed_at")
    micros = F.unix_micros(completed) - F.unix_micros(started)
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return calls.groupBy("operation_id").agg(
        F.count("*").alias("call_count"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(tokens).alias("total_tokens"),
        F.sum("estimated_cost").alias("estimated_cost"),
        (micros - micros % 1000).alias("_micros"),
        # calls of one place are told apart by their times, then by the error itself
        F.max_by("error_code", F.struct("sequence", "started_at", "completed_at", "error_code"))
        .alias("last_error_code"),
        F.sum("audio_seconds").alias("audio_seconds"),
    ).withColumn("latency_ms", F.expr("_micros div 1000")).drop("_micros")


def ai_summary(
    jobs: DataFrame, operations: DataFrame, inquiries: DataFrame,
    runs: DataFrame | None = None, evaluations: DataFrame | None = None,
) -> DataFrame:
    """One row of key figures; a figure without data is NULL, never zero."""
    one = F.lit(1).alias("_one")
    done = F.col("status").isin("completed", "needs_review")
    terminal = done | (F.col("status") == "failed")
    job_row = jobs.agg(
        F.count("*").alias("total_inputs"),
        F.count_if(done).alias("_done"),
        F.count_if(terminal).alias("_terminal"),
        F.count_if(F.col("status") == "needs_review").alias("review_count"),
    ).select("*", one)
    work = operations.where("usage_category <> 'evaluation'")
    op_row = work.agg(
        F.avg("latency_ms").alias("avg_latency_ms"), F.sum("estimated_cost").alias("total_cost")
    ).select("*", one)
    p95 = lower_nearest_rank(work, "latency_ms", 95).select(
        F.col("latency_ms").alias("p95_latency_ms"), one
    )
    count_row = inquiries.agg(F.count("*").alias("inquiry_count")).select("*", one)
    row = job_row.join(op_row, "_one").join(p95, "_one", "left").join(count_row, "_one")
    if runs is not None:
        used = runs.where("is_current").agg(
            F.array_sort(F.collect_set(F.concat_ws("@", "prompt_name", "prompt_version")))
            .alias("prompt_versions")
        ).select("*", one)
        row = row.join(used, "_one")
    if evaluations is not None:
        last = evaluations.where("status = 'completed'").agg(
            F.max_by("evaluation_id", "completed_at").alias("latest_evaluation")
        ).select("*", one)
        row = row.join(last, "_one")
    per_inquiry = F.bround(
        F.try_divide(F.col("total_cost"), F.col("inquiry_count").cast("decimal(18,0)")), 4
    )
    return (
        row.withColumn("success_rate", F.try_divide(F.col("_done") * F.lit(100.0), "_terminal"))
        .withColumn("cost_per_inquiry", per_inquiry)
        .drop("_one", "_done", "_terminal")
    )


# -- evaluation -----------------------------------------------------------------------------------


def normalize_equipment(raw: Column) -> Column:
    """First code any of whose synonyms occurs in the label."""
    text = casefold(strip(raw))
    code = F.lit(None).cast("string")
    for name, words in reversed(vocab.EQUIPMENT_SYNONYMS.items()):
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        code = F.when(hit, name).otherwise(code)
    return code


def gold_cases(gold: DataFrame, events: DataFrame, inquiries: DataFrame) -> DataFrame:
    """Gold cases with their event and its first inquiry; a missing event is an errored case."""
    first = inquiries.groupBy("event_id").agg(
        F.min_by("inquiry_id", "sequence_number").alias("inquiry_id")
    )
    found = events.select("event_id", "external_source_id", "channel")
    return (
        gold.join(found, ["external_source_id", "channel"], "left")
        .join(first, "event_id", "left")
        .withColumn(
            "case_state", F.when(F.col("event_id").isNull(), "errored").otherwise("graded")
        )
    )


def _score(metric: str, passed: Column, expected: Column, actual: Column, value=None) -> Column:
    none_text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.struct(
        F.lit(metric).alias("metric"),
        F.lit(vocab.METRIC_CATEGORY[metric]).alias("category"),
        passed.alias("passed"),
        none_text(expected).alias("expected"),
        none_text(actual).alias("actual"),
        (F.lit(None).cast("double") if value is None else value).alias("value"),
    )


def evaluate_extraction(cases: DataFrame) -> DataFrame:
    """Eight scores per case, built on the row.

    Prediction columns: intents, availability, equipment, load_reference, mc_number, rates and the
    ``*_evidence`` structs. Gold columns carry the ``gold_`` prefix.
    """
    same = lambda a, b: a.eqNullSafe(b)
    gold = lambda name: F.col(f"gold_{name}")
    filled = lambda name: F.coalesce(F.length(name) > 0, F.lit(False))
    roles = F.array(*[F.lit(r) for r in vocab.CARRIER_ROLES])
    positions = F.filter("rates", lambda r: F.array_contains(roles, r["role"]))
    last = F.try_element_at(positions, F.lit(-1))
    equipment = normalize_equipment(F.col("equipment"))
    intent = F.try_element_at("intents", F.lit(1))
    no_position = gold("position_amount").isNull()
    amount = lambda c: c.try_cast("decimal(38,10)")
    value_ok = F.coalesce(amount(last["amount"]) == amount(gold("position_amount")), F.lit(False))
    evidence_checks = F.filter(
        F.array(
            F.when(gold("mc_number_digits").isNotNull() & filled("mc_number"),
                   F.col("mc_number_evidence").isNotNull()),
            F.when(gold("load_reference_digits").isNotNull() & filled("load_reference"),
                   F.col("load_reference_evidence").isNotNull()),
            F.when(gold("equipment_code").isNotNull() & filled("equipment"),
                   F.col("equipment_evidence").isNotNull()),
            F.when((gold("availability") != "not_stated")
                   & (F.col("availability") != "not_stated"),
                   F.col("availability_evidence").isNotNull()),
        ),
        lambda c: c.isNotNull(),
    )
    share = F.try_divide(
        F.size(F.filter(evidence_checks, lambda c: c)).cast("double"), F.size(evidence_checks)
    )
    role_ok = F.when(~no_position & value_ok, same(last["role"], gold("position_role")))
    scores = F.array(
        _score("intent", same(intent, gold("primary_intent")), gold("primary_intent"), intent),
        _score("availability", same(F.col("availability"), gold("availability")),
               gold("availability"), F.col("availability")),
        _score("equipment", same(equipment, gold("equipment_code")), gold("equipment_code"),
               equipment),
        _score("load_reference",
               same(digits(F.col("load_reference")), gold("load_reference_digits")),
               gold("load_reference_digits"), F.col("load_reference")),
        _score("mc_number",
               F.when(~gold("mc_garbled"),
                      same(digits(F.col("mc_number")), gold("mc_number_digits"))),
               gold("mc_number_digits"), F.col("mc_number")),
        _score("rate_value", F.when(no_position, F.size(positions) == 0).otherwise(value_ok),
               gold("position_amount"), last["amount"]),
        _score("rate_role", role_ok, gold("position_role"), last["role"]),
        _score("grounding_rate", F.when(share.isNotNull(), share >= vocab.GROUNDING_PASS),
               F.lit(f">= {vocab.GROUNDING_PASS}"), F.format_string("%.2f", share), share),
    )
    return cases.select("case_id", F.posexplode(scores).alias("seq", "s")).select(
        "case_id", "seq", "s.*"
    )


def evaluate_resolution(cases: DataFrame, carriers: DataFrame, loads: DataFrame) -> DataFrame:
    """Did stated identifiers resolve the way the directory says they must?

    Expects carrier_status, load_status, gold_mc_number_digits, gold_load_reference_digits.
    """
    lonely = F.concat(F.lit("\x00"), F.col("case_id"))
    known_mc = carriers.where("mc_number_normalized IS NOT NULL").select(
        F.col("mc_number_normalized").alias("_mc"), F.lit(True).alias("_mc_known")
    ).distinct()
    known_load = loads.select(
        F.col("load_id").alias("_load"), F.lit(True).alias("_load_known")
    ).distinct()
    rows = (
        cases.withColumn("_mc", F.coalesce("gold_mc_number_digits", lonely))
        .withColumn("_load", F.coalesce("gold_load_reference_digits", lonely))
        .join(known_mc, "_mc", "left")
        .join(known_load, "_load", "left")
    )
    verified = lambda c: F.coalesce(F.col(c) == "verified", F.lit(False))
    stated = F.col("gold_load_reference_digits").isNotNull()
    load_ok = (
        F.when(stated & F.col("_load_known"), verified("load_status"))
        .when(stated, ~verified("load_status"))
        .otherwise(F.coalesce(F.col("load_status") == "unmatched", F.lit(False)))
    )
    expected = (
        F.when(stated & F.col("_load_known"), "verified")
        .when(stated, "not verified (reference unknown)").otherwise("unmatched")
    )
    scores = F.array(
        _score("carrier_resolution", F.when(F.col("_mc_known"), verified("carrier_status")),
               F.when(F.col("_mc_known"), "verified").otherwise("n/a"), F.col("carrier_status")),
        _score("load_resolution", load_ok, expected, F.col("load_status")),
    )
    return rows.select("case_id", F.posexplode(scores).alias("seq", "s")).select(
        "case_id", (F.col("seq") + 8).alias("seq"), "s.*"
    )


def eval_metrics(scores: DataFrame) -> DataFrame:
    """Per metric: passed, failed, not applicable and accuracy."""
    return scores.groupBy("metric").agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("not_applicable"),
    ).withColumn(
        "accuracy",
        F.bround(F.try_divide(F.col("passed").cast("double"), F.col("passed") + F.col("failed")), 4),
    )


def eval_score(metrics: DataFrame) -> DataFrame:
    """Macro average of the rounded accuracies."""
    return metrics.agg(F.bround(F.avg("accuracy"), 4).alias("score"))


def eval_cases(scores: DataFrame) -> DataFrame:
    """Per case: outcome, failed categories, analysis text and advice.

    A case has one score per metric, so its failed metrics are ten aggregates, not a collected
    group.
    """
    def failed(metric: str) -> Column:
        wrong = (F.col("metric") == metric) & ~F.col("passed")
        text = F.concat(
            F.lit(f"{metric}: expected "), "expected", F.lit(", got "), "actual"
        )
        return F.max(F.when(wrong, F.struct("seq", "category", text.alias("text")))).alias(
            f"_{metric}"
        )

    grouped = scores.groupBy("case_id").agg(*[failed(m) for m in vocab.METRIC_CATEGORY])
    found = F.array_sort(
        F.filter(F.array(*[F.col(f"_{m}") for m in vocab.METRIC_CATEGORY]), lambda s: s.isNotNull())
    )
    advice = F.create_map(*[F.lit(x) for pair in vocab.IMPROVEMENTS.items() for x in pair])
    return grouped.withColumn("_f", found).select(
        "case_id",
        F.when(F.size("_f") > 0, "failed").otherwise("passed").alias("status"),
        F.array_join(
            F.array_sort(F.array_distinct(F.transform("_f", lambda s: s["category"]))), ","
        ).alias("failure_categories"),
        F.array_join(F.transform("_f", lambda s: s["text"]), "; ").alias("failure_analysis"),
        F.array_join(
            F.array_distinct(
                F.transform("_f", lambda s: F.try_element_at(advice, s["category"]))
            ), " ",
        ).alias("suggested_improvement"),
    )


def eval_run_cases(gold: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases`` of ``eval_cases`` for every gold case; one without scores has errored."""
    missing = F.col("status").isNull()
    text = lambda c, other: F.when(missing, other).otherwise(F.col(c)).alias(c)
    return gold.select("case_id").join(cases, "case_id", "left").select(
        "case_id", text("status", "errored"), text("failure_categories", ""),
        text("failure_analysis", "no valid extraction"), text("suggested_improvement", ""),
    )


def eval_run_totals(cases: DataFrame) -> DataFrame:
    """One row: cases in all, passed, failed and errored."""
    return cases.agg(
        F.count("*").alias("cases_total"),
        *(F.count_if(F.col("status") == s).alias(f"cases_{s}") for s in ("passed", "failed", "errored")),
    )


def runtime_scores(
    jobs: DataFrame, runs: DataFrame, inquiries: DataFrame, assessments: DataFrame
) -> DataFrame:
    """Quality proxies of every finished job."""
    one_or_zero = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    terminal = jobs.where(F.col("status").isin("completed", "needs_review"))
    valid = runs.where("is_current").groupBy("event_id").agg(
        F.bool_or(F.col("validation_status") == "valid").alias("_valid")
    )
    resolved = inquiries.groupBy("event_id").agg(
        F.bool_or(F.col("carrier_resolution_status") == "verified").alias("_carrier"),
        F.bool_or(F.col("load_resolution_status") == "verified").alias("_load"),
    )
    grounded = (
        assessments.where("evidence_status <> 'missing'")
        .join(inquiries.select("inquiry_id", "event_id"), "inquiry_id")
        .groupBy("event_id")
        .agg(
            F.count_if(F.col("evidence_status") == "explicit").alias("_explicit"),
            F.count("*").alias("_graded"),
        )
    )
    rows = terminal.join(valid, "event_id", "left").join(resolved, "event_id", "left").join(
        grounded, "event_id", "left"
    )
    share = F.try_divide(F.col("_explicit").cast("double"), F.col("_graded"))
    return rows.select(
        "job_id",
        one_or_zero(F.col("_valid")).alias("extraction_valid"),
        F.coalesce(share, F.lit(0.0)).alias("grounding_rate"),
        one_or_zero(F.col("_carrier")).alias("carrier_resolved"),
        one_or_zero(F.col("_load")).alias("load_resolved"),
        one_or_zero(F.col("status") == "needs_review").alias("routed_to_review"),
    )


def assistant_scores(runs: DataFrame, tools: DataFrame, citations: DataFrame) -> DataFrame:
    done = tools.groupBy("run_id").agg(
        F.count_if(F.col("status") == "completed").alias("_done"), F.count("*").alias("_all")
    )
    cited = citations.groupBy("run_id").agg(F.count("*").alias("_cited"))
    rows = runs.join(done, "run_id", "left").join(cited, "run_id", "left")
    rate = F.try_divide(F.col("_done").cast("double"), F.col("_all"))
    return rows.select(
        "run_id",
        F.when(F.col("status") == "completed", 1.0).otherwise(0.0).alias("answer_supported"),
        F.coalesce(rate, F.lit(1.0)).alias("tool_success_rate"),
        F.coalesce("_cited", F.lit(0)).cast("double").alias("citation_count"),
    )


def check_citations(runs: DataFrame, returned: DataFrame, citations: DataFrame) -> DataFrame:
    """unsupported when a run cites what its completed tools never returned, or cites nothing
    although they returned something."""
    known = returned.where("status = 'completed'").select("run_id", "source_id").distinct()
    unknown = citations.join(known, ["run_id", "source_id"], "left_anti").groupBy("run_id").agg(
        F.count("*").alias("_bad")
    )
    cited = citations.groupBy("run_id").agg(F.count("*").alias("_cited"))
    had = known.groupBy("run_id").agg(F.count("*").alias("_returned"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        runs.join(unknown, "run_id", "left").join(cited, "run_id", "left")
        .join(had, "run_id", "left")
        .select(
            "run_id", zero("_bad").alias("invalid_citations"), zero("_cited").alias("citations"),
            F.when(
                (zero("_bad") > 0) | ((zero("_returned") > 0) & (zero("_cited") == 0)),
                "unsupported_citation",
            ).otherwise("ok").alias("outcome"),
        )
    )
