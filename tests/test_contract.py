import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brokerlake.operators import contract, extraction

SIZES = contract.record(
    ("size", "names", "kind", "at"), ("size",),
    ("size", contract.amount()), ("kind", contract.choice(("a", "b"))),
    ("at", contract.whole("not_an_integer", least=1, nullable=True)),
    ("names", contract.each(contract.text(non_empty=True))),
)
errors_of = contract.document("boxes", SIZES)


def of(**box):
    return errors_of(json.dumps({"boxes": [box]}))


@pytest.mark.parametrize("raw", [
    None, "", " ", "{", "{'boxes': []}", '{"boxes": [],}', '{"boxes": NaN}', '{"boxes": []} x',
    '{"boxes": [], "boxes": []}', "[" * 100_000, '{"boxes": ["a\nb"]}', '{"boxes": [01]}',
])
def test_malformed(raw):
    assert errors_of(raw) == ["$: malformed"]


def test_shape_of_the_document():
    assert errors_of("[]") == errors_of("null") == errors_of("1") == ["$: not_an_object"]
    assert errors_of("{}") == ["boxes: missing"]
    assert errors_of('{"boxes": 1}') == ["boxes: not_a_list"]
    assert errors_of('{"boxes": [], "more": 1}') == ["$: unknown_key", "boxes: empty"]
    assert errors_of('{"boxes": [null]}') == ["boxes.0: not_an_object"]


def test_paths_and_kinds():
    assert of(size=1, kind="a", at=None, names=["x"]) == []
    assert of(more=1) == ["boxes.0: unknown_key", "boxes.0.size: missing"]
    assert of(size=1, kind=None) == ["boxes.0.kind: not_in_vocabulary"]
    assert of(size=1, names=["x", "", 3]) == ["boxes.0.names.1: empty", "boxes.0.names.2: not_text"]
    for good in (1, "1", " 2 ", "3.", 4.0, True, 1e3):
        assert of(size=1, at=good) == [], good
    for bad in (0, False, 1.5, "1.5", "1e3", "x", "", [], {}, "1_0", 1e30):
        assert of(size=1, at=bad) == ["boxes.0.at: not_an_integer"], bad


@pytest.mark.parametrize("size,good", [
    ("1", True), (" 1.50 ", True), ("1e3", True), (".5", True), (1e27, True), ("5e-11", True),
    ("0", False), (-1, False), (True, False), (None, False), ("", False), ("NaN", False),
    ("1e28", False), ("4e-11", False), ("1_0", False), ("Infinity", False), ("1e99999999999", False),
    ([], False),
])
def test_amounts(size, good):
    assert of(size=size) == ([] if good else ["boxes.0.size: not_a_positive_number"])


@settings(max_examples=200, deadline=None)
@given(st.decimals(min_value=Decimal("0.01"), max_value=Decimal("99999999.99"), places=2))
def test_every_positive_price_is_an_amount(price):
    assert of(size=str(price)) == of(size=float(price)) == []


@settings(max_examples=200, deadline=None)
@given(st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=5),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(
        st.sampled_from(["boxes", "size", "names", "kind", "at", "z"]), v, max_size=4),
    max_leaves=30,
))
def test_any_document_gets_a_verdict(value):
    errors = errors_of(json.dumps(value))
    assert len(errors) <= contract.REPORTED and all(": " in e for e in errors)


def test_reports_end_at_the_limit():
    many = errors_of(json.dumps({"boxes": [{}] * 100_000}))
    assert many == [f"boxes.{n}.size: missing" for n in range(contract.REPORTED)]


def test_only_the_document_travels_to_python(spark):
    rows = [(n, "x" * 50, None if n % 2 else "{}") for n in range(6)] + [(0, "x", "")]
    frame = spark.createDataFrame(rows, "i int, wide string, raw_json string")
    checked = extraction.check_extractions(frame)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "from_json" not in plan and "variant" not in plan
    got = sorted((r.i, r.wide, tuple(r.errors), r.validation_status) for r in checked.collect())
    want = sorted((i, w, ("inquiries: missing",) if t == "{}" else ("$: malformed",), "invalid")
                  for i, w, t in rows)
    assert got == want
    assert extraction.check_extractions(frame.limit(0)).count() == 0
