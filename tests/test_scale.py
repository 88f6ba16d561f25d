"""Hot keys: results must not change, and the key must be spread over several ranges."""

import random

import pytest

from pyspark.sql import functions as F

from brokerlake import scale
from brokerlake.operators import jobs, review


def _uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_positions_with_a_hot_key(spark):
    _uncoalesced(spark)
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
        (F.col("id") * 7919 % 104729).alias("score"), "id",
    )
    ranged = scale.sorted_ranges(rows, ["key"], [F.col("score").desc(), F.col("id").asc()])
    assert ranged.where("key = 'hot'").select("_part").distinct().count() > 1
    got = scale.positions(rows, ["key"], [F.col("score").desc(), F.col("id").asc()])
    expected = rows.selectExpr(
        "*", "row_number() over (partition by key order by score desc, id) as position"
    )
    assert got.select("key", "score", "id", "position").exceptAll(expected).count() == 0
    assert got.count() == 20_000


def test_lower_nearest_rank_over_many_values(spark):
    values = [random.Random(3).randrange(0, 5_000_000) for _ in range(4000)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    known = sorted(v for v in values if v is not None)
    for percent in (0, 50, 95, 100):
        got = scale.lower_nearest_rank(frame, "v", percent).first()[0]
        assert got == known[int(percent / 100 * (len(known) - 1))]
    assert scale.lower_nearest_rank(frame.where("v is null"), "v", 95).first()[0] is None


def test_review_fold_with_a_hot_inquiry(spark):
    _uncoalesced(spark)
    rng = random.Random(11)
    kinds = ["approve_extraction", "reject_extraction", "reopen_review", "correct_carrier",
             "correct_load"]
    actions = []
    for n in range(6000):
        inquiry = "hot" if rng.random() < 0.6 else f"i{rng.randrange(40)}"
        kind = rng.choice(kinds)
        target = f"{kind[-4:]}{rng.randrange(9)}" if kind.startswith("correct") else None
        actions.append((inquiry, f"{n:06d}", kind, target, rng.random() > 0.1, n))
    start = [(k, "needs_review", True, True, n % 2 == 0, "c0", "l0")
             for n, k in enumerate(["hot", *[f"i{i}" for i in range(40)]])]
    inquiries = spark.createDataFrame(
        start, "inquiry_id string, review_status string, carrier_pending boolean,"
        " load_pending boolean, other_pending boolean, carrier_id string, load_id string")
    log = spark.createDataFrame(
        actions, "inquiry_id string, action_id string, action_type string, target_id string,"
        " same_snapshot boolean, n int").withColumn(
            "created_at", F.timestamp_seconds("n")).repartition(4)
    audit = review.review_audit(inquiries, log)
    got = {r.action_id: (r.outcome, r.status_before, r.status_after, r.carrier_after, r.load_after)
           for r in audit.collect()}
    state = {r[0]: [r[1], r[2], r[3], r[4], r[5], r[6]] for r in start}
    expected = {}
    for inquiry, ident, kind, target, same, _ in actions:
        s = state[inquiry]
        before, outcome = s[0], "applied"
        if kind == "approve_extraction":
            if before in ("unreviewed", "needs_review"):
                s[:4] = ["approved", False, False, False]
            else:
                outcome = "invalid_state"
        elif kind == "reject_extraction":
            if before != "rejected":
                s[:4] = ["rejected", False, False, False]
            else:
                outcome = "invalid_state"
        elif kind == "reopen_review":
            if before in ("approved", "rejected"):
                s[0] = "needs_review"
            else:
                outcome = "invalid_state"
        elif before == "rejected":
            outcome = "invalid_state"
        elif not same:
            outcome = "snapshot_mismatch"
        else:
            which = 1 if kind == "correct_carrier" else 2
            s[which], s[which + 3] = False, target
            s[0] = "needs_review" if any(s[1:4]) else "approved"
        expected[ident] = (outcome, before, s[0], s[4], s[5])
    assert got == expected
    final = {r.inquiry_id: (r.review_status, r.carrier_id, r.load_id)
             for r in review.apply_review_actions(inquiries, audit).collect()}
    assert final == {k: (v[0], v[4], v[5]) for k, v in state.items()}


def test_job_fold_with_a_hot_job(spark):
    _uncoalesced(spark)
    rng = random.Random(5)
    log = [("hot" if rng.random() < 0.7 else f"j{rng.randrange(30)}", rng.choice(jobs.TRANSITIONS), n)
           for n in range(4000)]
    frame = spark.createDataFrame(log, "job_id string, transition string, seq_key long").withColumn(
        "at_time", F.timestamp_seconds("seq_key")).repartition(4)
    got = {r.job_id: (r.status, r.retry_count, r.ignored_count)
           for r in jobs.job_state(frame, [F.col("at_time").asc()]).collect()}
    state = {}
    for job, name, _ in log:
        status, retries, ignored = state.get(job, ("queued", 0, 0))
        after = jobs.next_state(name, status, retries)
        state[job] = (*after, ignored) if after else (status, retries, ignored + 1)
    assert got == state


def test_null_corrections_cross_ranges(spark):
    """A correction to NULL holds until the next one, whatever the ranges and the characters."""
    _uncoalesced(spark)
    targets = [None if n % 3 else f"a\x1fb\x00{n}" for n in range(600)]
    inquiries = spark.createDataFrame(
        [("hot", "needs_review", True, True, True, "c0", "l0")],
        "inquiry_id string, review_status string, carrier_pending boolean, load_pending boolean,"
        " other_pending boolean, carrier_id string, load_id string")
    log = spark.createDataFrame(
        [("hot", f"{n:06d}", "correct_carrier", t, True, n) for n, t in enumerate(targets)],
        "inquiry_id string, action_id string, action_type string, target_id string,"
        " same_snapshot boolean, n int").withColumn("created_at", F.timestamp_seconds("n"))
    for parts in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        audit = review.review_audit(inquiries, log.repartition(4)).collect()
        before = [r.carrier_before for r in sorted(audit, key=lambda r: r.action_id)]
        assert before == ["c0", *targets[:-1]]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, **conf):
            self.conf, self.sparkContext = {k.replace("_", "."): v for k, v in conf.items()}, Context(master)

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scale.shared_root(Session(master))
        assert scale.shared_root(Session(master, spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    for master in ("local", "local[8]", "local[*]", "local[2,3]"):
        assert "brokerlake-" in scale.shared_root(Session(master))


def test_positions_rank_hot_keys_over_ranges_and_others_where_they_are(spark, monkeypatch):
    _uncoalesced(spark)
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
        (F.col("id") * 7919 % 104729).alias("score"), "id",
    )
    order = [F.col("score").desc(), F.col("id").asc()]
    expected = rows.selectExpr(
        "*", "cast(row_number() over (partition by key order by score desc, id) as bigint) as position"
    )
    dealt = rows.repartition("key")
    plain = scale.positions(dealt, ["key"], order)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    monkeypatch.setattr(scale, "HOT", 1_000)
    for got in (plain, scale.positions(rows, ["key"], order),
                scale.positions(rows, ["key"], order, bound=rows.unionByName(rows))):
        assert got.count() == 9_000 and got.exceptAll(expected).count() == 0


def test_tasks_read_small_splits(spark):
    from brokerlake.plans.tables import Tables

    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for given, want in [("128MB", "16m"), ("134217728b", "16m"), ("1g", "16m"), ("1m", "1m"), ("4096", "4096")]:
            spark.conf.set("spark.sql.files.maxPartitionBytes", given)
            Tables(spark, "/root/testdata/sf0.001")
            got = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
