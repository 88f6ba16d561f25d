"""Candidates, drafts and rankings: rows are dealt by inquiry and by load, and never again."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from brokerlake import scale
from brokerlake.operators import boards, candidates as cand
from brokerlake.plans.registry import PLANS
from brokerlake.plans.tables import Tables
import __spark_entry__  # noqa: F401  (registers the queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "workspace_candidates", "draft_context", "draft_evidence", "assessment_history", "load_facts",
    "candidate_assessment", "strongest_candidates", "best_rates", "assessment_reasons", "eligibility",
    "dashboard_counts", "carrier_candidacies"])
def test_candidates_are_dealt_by_load_alone(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = PLANS[name](Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert not [keys for keys in dealt if "carrier_id" in keys or "candidate_id" in keys]


def test_drafts_see_the_assessments(spark):
    """Inquiries with several quotes, repeated candidates, missing loads and carriers."""
    rng = random.Random(7)
    pick = rng.choice
    inquiries = spark.createDataFrame(
        [(f"i{n}", pick(["L1", "L2", "L9", None]), pick(["c1", "c2", "c9", None]), pick([None, 1, 2, 3]),
          pick(["confirmed", "unavailable", "not_stated"]), pick([None, "flatbed", "box_truck"]),
          "verified", pick(["verified", "unmatched"]), pick(["approved", "rejected"]), "s")
         for n in range(160)],
        "inquiry_id string, load_id string, carrier_id string, t int, availability_status string,"
        " equipment_code string, carrier_resolution_status string, load_resolution_status string,"
        " review_status string, summary string",
    ).withColumn("occurred_at", F.timestamp_seconds("t")).withColumns(
        {c: F.timestamp_seconds(F.lit(9)) for c in ("received_at", "created_at")})
    quotes = spark.createDataFrame(
        [(f"q{n:03d}", f"i{rng.randrange(160)}", "USD", pick(["carrier_quote", "ambiguous"]), "all_in",
          pick(["explicit", "inferred"]), rng.random() < 0.8, 100 + n) for n in range(150)],
        "quote_id string, inquiry_id string, currency string, quote_type string, rate_basis string,"
        " evidence_status string, is_current boolean, n int",
    ).withColumn("amount", F.col("n").cast("decimal(12,2)"))
    loads = spark.sql(
        "SELECT explode(array('L1', 'L2')) AS load_id, date '2026-05-25' AS pickup_date, 115 AS distance_miles,"
        " 'flatbed' AS equipment_code, 'PA' AS origin_state, 'NJ' AS destination_state, 'Flatbed' AS equipment_raw,"
        " 5 AS weight_lbs, cast(520 AS decimal(12,2)) AS offered_rate_usd, 'within_band' AS band_position")
    carriers = spark.sql(
        "SELECT explode(array('c1', 'c2')) AS carrier_id, 'Co' AS company_name, 'MC-1' AS mc_number_raw,"
        " 'ACTIVE' AS authority_status, 'Satisfactory' AS safety_rating, date '2026-06-01' AS insurance_expiry,"
        " true AS onboarded, 3.0 AS reliability_score, 1 AS loads_completed, 2.0 AS avg_response_time_hours")
    contacts = spark.createDataFrame([("c1", "Ann", True)], "carrier_id string, name string, is_primary boolean")
    assessed = cand.eligibility(cand.current_facts(inquiries, quotes), carriers, loads).select(
        "candidate_id", "final_status", cand.open_reasons().alias("reasons"))
    known = {r.candidate_id: (r.final_status, r.reasons) for r in assessed.collect()}
    at_once = cand.assess(inquiries, quotes, carriers, loads).select(
        "candidate_id", "final_status", cand.open_reasons().alias("reasons"), "latest_inquiry_id").collect()
    assert {r.candidate_id: (r.final_status, r.reasons) for r in at_once} == known and len(known) == 4
    current: dict = {}
    for r in quotes.where("is_current").orderBy("quote_id").collect():
        current.setdefault(r.inquiry_id, r.quote_id)
    drafts = boards.draft_context(inquiries, carriers, contacts, quotes, loads).collect()
    asked = {r.inquiry_id: r for r in inquiries.collect()}
    assert len(drafts) == len(asked) == 160
    for r in drafts:
        of = asked[r.inquiry_id]
        assert (r.load_id, r.carrier_id) == (of.load_id, of.carrier_id)
        assert (r.load is not None) == (of.load_id in ("L1", "L2"))
        assert (r.carrier is not None) == (of.carrier_id in ("c1", "c2"))
        assert (r.quote and r.quote.quote_id) == current.get(r.inquiry_id)
        found = known.get(f"{of.load_id}|{of.carrier_id}")
        assert (r.eligibility and (r.eligibility.final_status, r.eligibility.reasons)) == found


def test_texts_go_to_python_in_small_batches(spark):
    """A thousand texts of 100 kB are not one batch."""
    import pandas as pd

    from brokerlake.scale import tune

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    tune(spark)
    rows = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("é"), 100_000).alias("text"))
    assert rows.select(held("text").alias("n")).agg(F.max("n")).first()[0] < 8_000_000


def test_candidacies_are_assessed_once_for_their_sort(spark):
    """A sort reads its input twice; that input is a table, not the assessment."""
    plan = PLANS["carrier_candidacies"](Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["assessment_history", "load_facts", "best_rates"])
def test_shuffles_do_not_hang_on_the_number_of_cores(spark, name):
    """Four partitions are asked for here; rows are dealt to many, and small ones are read together."""
    rows = PLANS[name](Tables(spark, FOLDER))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = {int(n) for n in re.findall(r"Exchange hashpartitioning\((?:inquiry_id|load_id)[^,]*, (\d+)\)", plan)}
    assert dealt == {1000}
    assert rows.rdd.getNumPartitions() <= 16


def test_smaller_settings_are_kept(spark):
    from brokerlake.scale import small_splits

    dealt, read = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = {name: spark.conf.get(name, None) for name in (dealt, read)}
    try:
        spark.conf.set(dealt, "7")
        spark.conf.set(read, "8m")
        small_splits(spark)
        assert [spark.conf.get(name) for name in (dealt, read)] == ["7", "8m"]
        spark.conf.unset(dealt)
        spark.conf.unset(read)
        small_splits(spark)
        assert [spark.conf.get(name) for name in (dealt, read)] == ["1000", "16m"]
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _shuffles(plan):
    """Rows that each shuffle of a finished plan wrote, by the expression it deals by."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if "QueryStage" in kind else [
        plan.children().apply(n) for n in range(plan.children().size())]
    own = [(plan.outputPartitioning().toString(), plan.metrics().apply("shuffleRecordsWritten").value())] if (
        kind == "ShuffleExchangeExec") else []
    return own + [found for below in inner for found in _shuffles(below)]


@pytest.mark.parametrize("name", ["load_facts", "best_rates"])
def test_best_rates_deal_only_inquiries_that_bear_on_them(spark, name):
    """Rejected inquiries stay at home; of carriers that are never eligible only quotes are dealt by load."""
    t = Tables(spark, FOLDER)
    linked = t.inquiries.where("load_id IS NOT NULL AND carrier_id IS NOT NULL")
    live = linked.where("review_status <> 'rejected'").count()
    quoted = t.quotes.where(cand.usable_quote()).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = PLANS[name](t)
        rows.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = _shuffles(rows._jdf.queryExecution().executedPlan())
    by_inquiry = [n for key, n in dealt if "(inquiry_id" in key]
    by_load = [n for key, n in dealt if "(load_id" in key]
    assert sorted(by_inquiry) == sorted([live, quoted])
    loads = t.loads.count()
    assert max([n for n in by_load if n != loads]) < 0.7 * live


def _offers(spark, seed):
    rng = random.Random(seed)
    pick = rng.choice
    inquiries = spark.createDataFrame(
        [(f"i{n}", pick(["L1", "L2", "L3", "L9", None]), pick(["c1", "c2", "c3", "c4", "c5", "c9", None]),
          pick([None, 1, 2, 3]), pick(["confirmed", "confirmed", "unavailable", "not_stated", None]),
          pick([None, "flatbed", "flatbed", "box_truck"]), pick(["verified", "verified", "needs_review", None]),
          "verified", pick(["approved", "approved", "approved", "rejected", None]))
         for n in range(60)],
        "inquiry_id string, load_id string, carrier_id string, t int, availability_status string,"
        " equipment_code string, carrier_resolution_status string, load_resolution_status string,"
        " review_status string",
    ).withColumn("occurred_at", F.timestamp_seconds("t")).withColumns(
        {c: F.timestamp_seconds(F.lit(9)) for c in ("received_at", "created_at")})
    quotes = spark.createDataFrame(
        [(f"q{n:03d}", f"i{rng.randrange(60)}", pick(["USD", "USD", "CAD"]),
          pick(["carrier_quote", "carrier_counteroffer", "ambiguous"]), pick(["all_in", "per_mile", "hourly"]),
          pick(["explicit", "explicit", "inferred"]), rng.random() < 0.8, 100 + rng.randrange(9)) for n in range(40)],
        "quote_id string, inquiry_id string, currency string, quote_type string, rate_basis string,"
        " evidence_status string, is_current boolean, n int",
    ).withColumn("amount", F.col("n").cast("decimal(12,2)"))
    loads = spark.createDataFrame(
        [("L1", "2026-05-25", 115, "flatbed"), ("L2", "2026-05-25", None, "flatbed"), ("L3", "2026-07-01", 9, "flatbed")],
        "load_id string, day string, distance_miles long, equipment_code string",
    ).withColumn("pickup_date", F.col("day").cast("date"))
    carriers = spark.createDataFrame(
        [("c1", "ACTIVE", "Satisfactory", "2026-06-01", True), ("c2", "ACTIVE", "Satisfactory", "2026-09-01", True),
         ("c3", "INACTIVE", "Satisfactory", "2026-06-01", True), ("c4", "ACTIVE", None, "2026-06-01", True),
         ("c5", "ACTIVE", "Satisfactory", "2026-09-01", None)],
        "carrier_id string, authority_status string, safety_rating string, day string, onboarded boolean",
    ).selectExpr("*", "'Co' AS company_name", "cast(day AS date) AS insurance_expiry", "3.0 AS reliability_score",
                 "1 AS loads_completed", "2.0 AS avg_response_time_hours")
    return inquiries, quotes, carriers, loads


@pytest.mark.parametrize("at_hand", [cand.AT_HAND, 0])
def test_candidates_with_quotes_have_the_prices_and_eligibility_of_all(spark, monkeypatch, at_hand):
    """Carriers known by broadcast and by shuffle; conflicts, rejected inquiries, facts that are missing."""
    monkeypatch.setattr(cand, "AT_HAND", at_hand)
    eligible = priced = 0
    for seed in range(4):
        offers = _offers(spark, seed)

        def told(assessed):
            rows = cand.with_comparable_quote(assessed).where("current_quote IS NOT NULL").select(
                "candidate_id", "load_id", "quote_id", "all_in", "per_mile",
                F.expr("coalesce(final_status = 'eligible', false)"))
            return sorted(map(tuple, rows.collect()))

        got = told(cand.assess_quoted(*offers))
        assert got == told(cand.assess(*offers))
        eligible += sum(row[-1] for row in got)
        priced += sum(row[3] is not None for row in got)
    assert eligible and priced > eligible


def test_market_weeks_are_those_of_the_role(spark):
    t = Tables(spark, FOLDER)
    columns = ["snapshot_id", "week_start", "origin_state", "destination_state", "equipment_code", "load_volume"]
    rates = ["minimum_rate_per_mile", "average_rate_per_mile", "maximum_rate_per_mile"]
    role = t.role("market_rates").select(*columns, *[F.col(c).cast("long") for c in ("min_cents", "avg_cents", "max_cents")])
    got = t.market_rates.select(*columns, *[(F.col(c) * 100).cast("long") for c in rates])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, role.collect()))


def test_a_line_meets_its_order_in_one_narrow_shuffle(spark):
    """Lines are dealt by order as week and rate; neither customers nor suppliers deal them again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Tables(spark, FOLDER).market_rates
        rows.collect()
        dealt = _shuffles(rows._jdf.queryExecution().executedPlan())
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert [key.split("#")[0] for key, n in dealt if n == lines] == ["hashpartitioning(l_orderkey"]
    assert plan.count("l_extendedprice") and "min(l_extendedprice" not in plan and "min(line_cents" in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = scale.stored(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k").groupBy("k").count())
    until = time.monotonic() + 20  # they are deleted in the background
    while _shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert {r.k: r["count"] for r in rows.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    assert spark.conf.get(scale._CLEANUP) == "false"


@pytest.mark.parametrize("name", ["draft_context", "draft_evidence"])
def test_drafts_hold_one_shuffle_of_the_inquiries(spark, name):
    """The meeting with the quotes is over, and its files can go, when rows are dealt by load."""
    rows = PLANS[name](Tables(spark, FOLDER))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_load" in plan and "hashpartitioning(inquiry_id" not in plan
    assert "summary" not in plan and "availability_status" not in plan


def test_drafts_tell_the_words_if_asked(spark):
    inquiries, quotes, carriers, loads = _offers(spark, 1)
    inquiries = inquiries.withColumn("summary", F.concat(F.lit("about "), "inquiry_id"))
    loads = loads.selectExpr("*", "'PA' AS origin_state", "'NJ' AS destination_state", "'Flatbed' AS equipment_raw",
                             "5 AS weight_lbs", "cast(520 AS decimal(12,2)) AS offered_rate_usd", "'low' AS band_position")
    carriers = carriers.selectExpr("*", "'MC-1' AS mc_number_raw")
    contacts = spark.createDataFrame([("c1", "Ann", True)], "carrier_id string, name string, is_primary boolean")
    told = boards.draft_context(inquiries, carriers, contacts, quotes, loads)
    asked = {r.inquiry_id: r.availability_status for r in inquiries.collect()}
    assert {r.inquiry_id: (r.availability, r.summary) for r in told.collect()} == {
        i: (said, f"about {i}") for i, said in asked.items()}
    short = boards.draft_context(inquiries, carriers, contacts, quotes, loads, words=False)
    assert short.columns == [c for c in told.columns if c not in ("summary", "availability")]
    assert sorted(short.collect(), key=repr) == sorted(told.select(short.columns).collect(), key=repr)
