"""Text identity, windows, grounding, the extraction contract and name similarity."""

import datetime as dt
import difflib
import hashlib
import json
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brokerlake.functions import text
from brokerlake.operators import extraction, grounding, ingestion, matching

SETTINGS = dict(deadline=None, suppress_health_check=list(HealthCheck))
MESSY = st.text(alphabet="aB é\t\r\n  　ﬁ½ßİḰß", max_size=14)


def _canonical(raw):
    value = unicodedata.normalize("NFKC", raw).replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(line.rstrip(" \t") for line in value.split("\n")).strip()


@settings(max_examples=5, **SETTINGS)
@given(st.lists(MESSY, min_size=40, max_size=60))
def test_canonical_forms_equal_python(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = frame.select(
        "v", text.canonical_text(F.col("v")).alias("t"),
        text.canonical_address(F.col("v")).alias("a"),
        text.email_fingerprint(F.col("v"), F.col("v"), F.col("v")).alias("f")).collect()
    for row in got:
        address = unicodedata.normalize("NFKC", row.v).strip().casefold()
        assert (row.t, row.a) == (_canonical(row.v), address)
        parts = "\0".join(["email:v1", address, _canonical(row.v), _canonical(row.v)])
        assert row.f == hashlib.sha256(parts.encode()).hexdigest()


def test_body_case_counts_but_line_ends_do_not(spark):
    rows = [("x", "Hi\r\nyou  \n"), ("x", "Hi\nyou"), ("x", "hi\nyou")]
    prints = [r[0] for r in spark.createDataFrame(rows, "s string, b string").select(
        text.email_fingerprint(F.lit("a@b"), F.col("s"), F.col("b"))).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_digits_keep_other_scripts(spark):
    row = spark.sql("select 'MC-٣12' a, 'none' b, '' c, cast(null as string) d").select(
        *[text.digits(F.col(c)) for c in "abcd"]).first()
    assert tuple(row) == ("٣12", None, None, None)


def test_strip_nul_leaves_escaped_backslashes(spark):
    values = [{"a": "x\x00y\x00\x00"}, {"a": "\\u0000"}, {"a": "\\\x00"}]
    frame = spark.createDataFrame([(json.dumps(v),) for v in values], "j string")
    got = [json.loads(r[0]) for r in frame.select(text.strip_nul(F.col("j"))).collect()]
    assert got == [{"a": "xy"}, {"a": "\\u0000"}, {"a": "\\"}]


@settings(max_examples=5, **SETTINGS)
@given(st.lists(st.tuples(st.text("abé", max_size=9), st.text("abé", min_size=1, max_size=3),
                          st.integers(1, 6)), min_size=40, max_size=60))
def test_nth_occurrence_equals_python_find(spark, cases):
    def find(hay, needle, n):
        at = -1
        for _ in range(n):
            at = hay.find(needle, at + 1)
            if at == -1:
                return None
        return at

    frame = spark.createDataFrame(cases, "h string, n string, k int")
    for r in frame.select(
            "*", text.nth_occurrence(F.col("h"), F.col("n"), F.col("k")).alias("at")).collect():
        assert r.at == find(r.h, r.n, r.k)


@pytest.mark.parametrize("raw,status", [
    ("08:00 - 12:00", "range"), ("8:00-8:00", "range"), ("9:30", "single_time"),
    ("12:00 - 8:00", "invalid"), ("24:00", "invalid"), ("9:60", "invalid"), ("morning", "qualitative"),
    ("  ", "missing"), (None, "missing")])
def test_pickup_window(spark, raw, status):
    row = spark.createDataFrame([(raw, dt.date(2026, 3, 8))], "w string, d date").select(
        *ingestion.pickup_window(F.col("w"), F.col("d"), F.lit("America/New_York"))).first()
    assert row.pickup_window_status == status
    if raw == "9:30":  # after the change to summer time that day
        assert row.pickup_start_at == row.pickup_end_at == dt.datetime(2026, 3, 8, 13, 30)


def test_aware_timestamps(spark):
    raw = ["2026-05-01T10:00:00Z", "2026-05-01T10:00:00+02:00", "2026-05-01T10:00:00", "soon"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(
        ingestion.aware_timestamp(F.col("r"))).collect()]
    assert got == [dt.datetime(2026, 5, 1, 10), dt.datetime(2026, 5, 1, 8), None, None]


def test_merge_and_pieces(spark):
    body = "abcdefghij"
    texts = spark.createDataFrame([("e", body), ("f", ""), ("g", "xy")], "event_id string, t string")
    spans = spark.createDataFrame(
        [("e", 1, 3), ("e", 3, 5), ("e", 8, 99), ("e", None, 4), ("e", 6, 6)],
        "event_id string, start_offset int, end_offset int")
    got = {}
    for r in grounding.text_pieces(texts, spans, "event_id", "t").orderBy("start_offset").collect():
        got.setdefault(r.event_id, []).append((r.piece, r.hit))
    assert got == {"e": [("a", False), ("bcde", True), ("fgh", False), ("ij", True)],
                   "f": [("", False)], "g": [("xy", False)]}


# -- contract ---------------------------------------------------------------------------------

GOOD = {
    "carrier_name": "Blue", "mc_number": None, "load_reference": "L1", "equipment": None,
    "availability": "confirmed", "intents": ["rate_quote"], "summary": "s", "questions": [],
    "rates": [{"amount": 240, "role": "broker_rate_reference", "basis": "all_in",
               "evidence": {"source_part": "body", "excerpt": "240"}},
              {"amount": "280.00", "role": "carrier_counteroffer", "basis": "all_in",
               "evidence": {"source_part": "body", "excerpt": "280", "occurrence": "1"}}],
}


def _with(**changes):
    return {"inquiries": [{**GOOD, **changes}]}


def _without(key):
    return {"inquiries": [{k: v for k, v in GOOD.items() if k != key}]}


EVIDENCE = {"source_part": "body", "excerpt": "x"}
CASES = [
    (_with(), True), (_with(carrier_name=None), True), (_without("carrier_name"), False),
    (_without("dot_number"), True), (_with(extra=1), False), ({"inquiries": []}, False),
    ({"inquiries": [GOOD], "x": 1}, False), ({}, False), ([], False), ("text", False),
    (_with(availability="conflicting"), False), (_with(intents=[]), False),
    (_with(intents=["nope"]), False), (_with(intents=None), False), (_with(rates=None), False),
    (_with(summary=None), False), (_with(summary=3), False), (_with(mc_number=12), False),
    (_with(carrier_name_evidence=None), True), (_with(carrier_name_evidence=EVIDENCE), True),
    (_with(carrier_name_evidence={**EVIDENCE, "excerpt": ""}), False),
    (_with(carrier_name_evidence={**EVIDENCE, "occurrence": 0}), False),
    (_with(carrier_name_evidence={**EVIDENCE, "occurrence": 1.5}), False),
    (_with(carrier_name_evidence={**EVIDENCE, "occurrence": None}), False),
    (_with(carrier_name_evidence={**EVIDENCE, "segment_sequence": None}), True),
    (_with(carrier_name_evidence={**EVIDENCE, "segment_sequence": "x"}), False),
    (_with(carrier_name_evidence={**EVIDENCE, "note": 1}), False),
    (_with(carrier_name_evidence={**EVIDENCE, "source_part": "title"}), False),
    (_with(carrier_name_evidence="body"), False),
    (_with(rates=[{"amount": -1, "role": "ambiguous", "basis": "all_in"}]), False),
    (_with(rates=[{"amount": True, "role": "ambiguous", "basis": "all_in"}]), False),
    (_with(rates=[{"amount": "abc", "role": "ambiguous", "basis": "all_in"}]), False),
    (_with(rates=[{"amount": 1.25, "role": "ambiguous", "basis": "hourly"}]), True),
    (_with(rates=[{"amount": 1, "role": "ambiguous", "basis": "hourly", "currency": None}]), False),
    (_with(questions=[{"category": "rate", "text": "how much?"}]), True),
    (_with(questions=[{"category": "rate", "text": ""}]), False),
    (_with(questions=[{"category": "price", "text": "a"}]), False),
    ({"inquiries": [GOOD, {**GOOD, "availability": "x"}]}, False),
]


def test_contract_decisions(spark):
    rows = [(str(n), json.dumps(c[0])) for n, c in enumerate(CASES)] + [("bad", "{oops")]
    frame = spark.createDataFrame(rows, "event_id string, raw_json string")
    got = {r.event_id: (r.validation_status == "valid", r.errors)
           for r in extraction.check_extractions(frame).collect()}
    assert not got["bad"][0]
    for n, (case, valid) in enumerate(CASES):
        assert got[str(n)][0] == valid, (case, got[str(n)])


def test_only_the_counteroffer_is_current(spark):
    raw = spark.createDataFrame([("email:1", json.dumps(_with()))], "event_id string, raw_json string")
    inquiries = extraction.explode_inquiries(extraction.validate_extractions(raw)[0])
    emails = spark.createDataFrame([("email:1", "s", "you said 240, we need 280")],
                                   "event_id string, subject string, body_text string")
    segments = spark.createDataFrame(
        [], "event_id string, sequence int, text string, start_seconds decimal(8,2),"
        " end_seconds decimal(8,2), confidence decimal(5,4)")
    quotes = grounding.quote_supersession(
        grounding.ground(grounding.rate_mentions(inquiries), emails, segments))
    got = {int(r.amount): (r.evidence_status, r.is_current) for r in quotes.collect()}
    assert got == {240: ("explicit", False), 280: ("explicit", True)}


def test_weak_names_equal_brute_force(spark):
    words = ["blue", "ridge", "transport", "llc", "acme", "haul", "ng", "straße", "go", "freightways"]
    companies = [f"{a} {b}".title() for a in words for b in words if a != b] + ["Go", "X"]
    names = ["Blue Ridge", " ridge blue ", "acme hauling", "STRASSE", "go", "zzz", "x", "transprt llc",
             "freight ways go", "", None]
    carriers = spark.createDataFrame(
        [(f"{n:03d}", c) for n, c in enumerate(companies)], "carrier_id string, company_name string")
    requests = spark.createDataFrame(
        [(str(n), v, "acme llc" if n % 2 else None) for n, v in enumerate(names)],
        "inquiry_id string, carrier_name string, manual_hint string")
    got = {}
    for r in matching.match_carrier_weak(requests, carriers).collect():
        got.setdefault(r.inquiry_id, {})[r["rank"]] = (r.carrier_id, round(r.ratio, 9),
                                                       tuple(r.signal_codes))
    for n, name in enumerate(names):
        asked = [((name or "").strip().casefold(), "name_similarity")]
        asked += [("acme llc", "manual_hint")] if n % 2 else []
        best = {}
        for k, company in enumerate(companies):
            company = company.casefold()
            for ask, signal in asked:
                if not ask:
                    continue
                ratio = difflib.SequenceMatcher(None, ask, company).ratio()
                if ask in company or company in ask:
                    ratio = max(ratio, 0.75)
                if ratio >= 0.6:
                    old, signals = best.get(k, (0, ()))
                    best[k] = (max(old, ratio), tuple(sorted({*signals, signal})))
        top = sorted(best.items(), key=lambda e: (-e[1][0], f"{e[0]:03d}"))[:3]
        want = {i + 1: (f"{k:03d}", round(v[0], 9), v[1]) for i, (k, v) in enumerate(top)}
        assert got.get(str(n), {}) == want, name


def test_texts_travel_once(spark):
    refs = spark.createDataFrame(
        [("e1", "body", "b", 2, None), ("e1", "body", "b", 2, None), ("e1", "subject", "zz", 1, None),
         ("c1", "transcript", "lo", 1, 0), ("c1", "transcript", "nope", 1, 0), ("c1", "transcript", "x", 1, 9),
         ("e2", "body", None, 1, None), ("e2", None, None, None, None), ("e1", "body", "b", None, None)],
        "event_id string, source_part string, excerpt string, occurrence bigint, segment_sequence bigint")
    emails = spark.createDataFrame([("e1", None, "abcabc"), ("e2", "s", "")],
                                   "event_id string, subject string, body_text string")
    segments = spark.createDataFrame([("c1", 0, "hello")], "event_id string, sequence int, text string").selectExpr(
        "*", "cast(1 as decimal(8,2)) start_seconds", "cast(2 as decimal(8,2)) end_seconds",
        "cast(0.5 as decimal(5,4)) confidence")
    found = grounding.ground(refs, emails, segments)
    got = sorted((r.event_id, r.excerpt or "", r.occurrence or 0, r.span_id or "", float(r.segment_confidence or 0))
                 for r in found.collect())
    assert got == sorted([
        ("e1", "b", 2, "e1#body:4-5", 0.0), ("e1", "b", 2, "e1#body:4-5", 0.0), ("e1", "zz", 1, "", 0.0),
        ("c1", "lo", 1, "c1#1.00-2.00", 0.5), ("c1", "nope", 1, "", 0.5), ("c1", "x", 1, "", 0.0),
        ("e2", "", 1, "", 0.0), ("e2", "", 0, "", 0.0), ("e1", "b", 0, "", 0.0)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = grounding.ground(refs, emails, segments)._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def exchanged(node):
        """The columns of each exchange of a plan."""
        names = [node.output().apply(i).name() for i in range(node.output().size())]
        own = [names] if node.nodeName() == "Exchange" else []
        children = node.children()
        return own + [x for i in range(children.size()) for x in exchanged(children.apply(i))]

    moved = exchanged(plan)
    texts = {"_text", "text", "subject", "body_text"}
    assert len(moved) > 2 and sum(bool(texts & set(names)) for names in moved) == 1
