from brokerlake.operators import dq

RULES = (
    dq.unique("box", "box_name", "shelf", "name"),
    dq.unique("box", "one_open", "shelf", where="is_open"),
    dq.check("box", "size_positive", "size > 0"),
    dq.check("box", "size_small", "size < 100"),
    dq.reference("box", "shelf", "shelf", "id"),
    dq.reference("box", "inside", "box", "name"),
    dq.reference("box", "owner", "person", "id"),
)
BOX = "shelf long, name string, is_open boolean, size int, inside string, owner long, rule string, n int"
ROWS = [
    (1, "a", True, 5, None, None, "x", 1), (1, "a", False, None, "a", None, "x", 2),
    (1, "a", None, 0, "zz", 7, None, None), (2, "b", True, 500, "b", None, "x", 1),
    (2, "c", True, -1, "c", None, "x", 1), (None, "d", True, 1, "d", None, "x", 1),
    (None, "d", True, 1, "zz", None, "x", 1), (3, None, True, 1, None, None, "x", 1),
    (3, None, False, 1, None, None, "x", 1),
]
WANT = {"box_name": 1, "one_open": 1, "size_positive": 2, "size_small": 1, "box_shelf_fk": 2,
        "box_inside_fk": 2}


def tables(spark, rows, shelves):
    return {"box": spark.createDataFrame(rows, BOX),
            "shelf": spark.createDataFrame(shelves, "id long, key string")}


def test_counts_of_all_rules(spark):
    given = tables(spark, ROWS, [(1, "k"), (2, "k"), (2, "k"), (None, "k")])
    got = {r.rule: r.violations for r in dq.violations(given, RULES).collect()}
    assert got == WANT  # no table of persons, so nothing is said about owners
    for rule in RULES[:-1]:
        assert dq.rule_violations(rule, given).count() == WANT[rule.name], rule.name


def test_empty_tables_break_nothing(spark):
    got = {r.rule: r.violations for r in dq.violations(tables(spark, [], []), RULES).collect()}
    assert got == dict.fromkeys(WANT, 0)
    assert dq.violations({"other": spark.range(3)}, RULES).count() == 0


def test_each_table_is_read_once(spark, tmp_path):
    given = {}
    for name, frame in tables(spark, ROWS, [(1, "k")]).items():
        frame.write.parquet(f"{tmp_path}/{name}")
        given[name] = spark.read.parquet(f"{tmp_path}/{name}")
    plan = dq.violations(given, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    assert "ReadSchema: struct<id:bigint>" in plan  # the unused column is not read


def test_a_hot_key_is_few_rows_after_the_partial_sum(spark):
    rows = spark.range(0, 30_000, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 9 ELSE id END AS shelf", "cast(id AS string) AS name")
    given = {"box": rows, "shelf": spark.range(30_000).where("id <> 9")}
    only = (dq.reference("box", "shelf", "shelf", "id"), dq.unique("box", "by_shelf", "shelf"))
    got = {r.rule: r.violations for r in dq.violations(given, only).collect()}
    assert got == {"box_shelf_fk": 10_000, "by_shelf": 1}


def test_declared_references_are_distinct():
    names = [r.name for r in dq.RULES + dq.REFERENCES]
    assert len(names) == len(set(names)) and len(dq.REFERENCES) > 40


def test_a_column_states_its_keys_once_for_all_references(spark):
    rules = (dq.reference("box", "shelf", "shelf", "id"), dq.reference("box", "owner", "shelf", "id"),
             dq.reference("shelf", "key", "box", "name"), dq.unique("shelf", "shelf_id", "id"))
    given = tables(spark, ROWS, [(1, "a"), (2, "k"), (2, "k"), (None, None)])
    places = dq._places(list(rules))
    assert len(dq._facts("shelf", list(rules), places, 2)) == 3  # its id once, its reference, its rule
    got = {r.rule: r.violations for r in dq.violations(given, rules).collect()}
    assert got == {"box_shelf_fk": 2, "box_owner_fk": 1, "shelf_key_fk": 2, "shelf_id": 1}
    for rule in rules:
        assert dq.rule_violations(rule, given).count() == got[rule.name], rule.name
