"""Results that must hold every row, on literal cases."""

from brokerlake.operators import aiops, matching


def test_conflict_lists_every_carrier_of_a_shared_signal(spark):
    asked = spark.createDataFrame(
        [("i1", "s", "77", None, None, None, "x@y.z"), ("i2", "s", None, None, None, "555", None),
         ("i3", "s", "88", None, None, None, None)],
        "inquiry_id string, snapshot_id string, mc_number string, dot_number string, contact_email string, "
        "contact_phone string, sender_email_normalized string",
    )
    index = spark.createDataFrame(
        [("s", "mc_number", "77", "A"), ("s", "email", "x@y.z", "A"), ("s", "email", "x@y.z", "B"),
         ("s", "email", "x@y.z", "C"), ("s", "phone", "555", "D"), ("s", "phone", "555", "E"),
         ("s", "mc_number", "88", "A"), ("t", "phone", "555", "F")],
        "snapshot_id string, kind string, value string, carrier_id string",
    )
    exact = matching.match_carrier_exact(asked, index)
    rows = matching.match_carrier_conflict(asked, index, exact).collect()
    assert sorted((r.inquiry_id, r.carrier_id, r.primary_method) for r in rows) == [
        ("i1", "A", "mc_number"), ("i1", "B", "email"), ("i1", "C", "email"),
        ("i2", "D", "phone"), ("i2", "E", "phone"),
    ]


def test_gold_cases_without_an_extraction_count_as_errored(spark):
    gold = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    scores = spark.createDataFrame(
        [("a", 0, "intent", "intent_classification", True, "x", "x"),
         ("b", 0, "intent", "intent_classification", False, "x", "y")],
        "case_id string, seq int, metric string, category string, passed boolean, expected string, actual string",
    )
    cases = aiops.eval_run_cases(gold, aiops.eval_cases(scores))
    assert {r.case_id: r.status for r in cases.collect()} == {"a": "passed", "b": "failed", "c": "errored"}
    assert aiops.eval_run_totals(cases).collect() == [(3, 1, 1, 1)]
    assert aiops.eval_run_totals(cases.limit(0)).collect() == [(0, 0, 0, 0)]
