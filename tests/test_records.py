"""Records of split files against reading each file as a whole."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from brokerlake import schemas
from brokerlake.operators import ingestion
from brokerlake.sources import files, records

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(params=["64m", "900b"])
def split(spark, request):
    """Whole files, and files cut into many ranges."""
    options = {SPLIT: request.param, "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {key: spark.conf.get(key, None) for key in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def garbage(rng, n):
    return "".join(rng.choices('ab,"\\{}[]\n é', k=rng.randint(0, n)))


def test_array_elements(spark, tmp_path, split):
    rng = random.Random(1)
    rows = [{"k": garbage(rng, 40), "n": [1, {"x": garbage(rng, 6)}]} for _ in range(60)]
    rows += [5, "str,]", None, [1, 2], {}, {"long": garbage(rng, 5000) + "x" * 4000}, {"last": "}"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(rows[::-1], ensure_ascii=False))
    found, marks = records.read_records(spark, str(tmp_path), records.JsonArray())
    got = {}
    for r in found.collect():
        got.setdefault(r.file[-6:], {})[r.ordinal] = json.loads(r.text)
    for name, want in (("a.json", rows), ("b.json", rows[::-1])):
        assert [got[name][i] for i in range(len(rows))] == want and len(got[name]) == len(rows)
    assert [(r.begin, r.end, r.junk) for r in marks.collect()] == [(1, 1, 0)] * 2
    tasks = records._pieces(spark, str(tmp_path / "a.json"), "}").rdd.getNumPartitions()
    assert tasks > 5 if split == "900b" else tasks == 1


def test_broken_arrays_are_refused_whole(spark, tmp_path, split):
    one = '{"company_name": "A"}'
    texts = {"good": f" [{one},\n{one} ] \n", "none": "[ ]", "object": one, "two": f"[{one}][{one}]",
             "open": f"[{one}, {one}", "comma": f"[{one},]", "tail": f"[{one}] x", "bare": f"[{one}, oops]",
             "quote": f'[{one}, "]', "brace": f"[{one}]}}", "bad\\esc": '[{"company_name": "\\}"}]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, problems = files.read_carriers(spark, str(tmp_path))
    assert sorted((r.ordinal, r.company_name) for r in rows.collect()) == [(0, "A"), (1, "A")]
    refused = sorted(r.detail for r in problems.collect())
    assert refused == sorted(f"{n}.json" for n in texts if n not in ("good", "none"))


def test_line_ordinals_do_not_depend_on_splits(spark, tmp_path, split):
    for name in "ab":
        lines = [json.dumps({"company_name": f"{name}{i}"}) for i in range(100)] + ["", "{"]
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    rows, problems = files.read_carriers(spark, str(tmp_path), lines=True)
    want = {i: f"a{i}" for i in range(100)} | {101 + i: f"b{i}" for i in range(100)}
    assert {r.ordinal: r.company_name for r in rows.collect()} == want
    assert sorted(int(r.detail) for r in problems.collect()) == [100, 201]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_the_one_task_read(spark, tmp_path, split, end):
    rng = random.Random(2)
    def field():
        return "".join(rng.choices(["a", "b", ",", '"', end, "x y", " ", "é"], k=rng.randint(0, 8)))

    rows = [[field() for _ in range(4)] for _ in range(80)] + [["x" * 3000 + end + "y", "", "1", "2"]]
    with open(tmp_path / "x.csv", "w", newline="") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["p", "q r", 's"t', "u"])
        writer.writerows(rows)
        out.write(f'a 5" pipe,b"c{end}{end}"only"{end}')  # quotes within bare fields, an empty line, a short row
    got = files._csv(spark, str(tmp_path / "x.csv"), ("p",), True)
    one = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    want = one.csv(str(tmp_path / "x.csv"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("week_start,x\n1,2\n")
    (tmp_path / "b.csv").write_text("x,week_start\n1,2\n")
    with pytest.raises(files.PackageError, match="different headers"):
        files.read_rates(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("")
    with pytest.raises(files.PackageError, match="missing required columns"):
        files.read_rates(spark, str(tmp_path / "empty"))


def test_numbers_beyond_int_reject_their_row(spark):
    aliases = spark.createDataFrame([("dataset", "box truck", "box_truck")],
                                    "source string, normalized_label string, equipment_code string")
    raw = spark.createDataFrame(
        [{c: {"load_id": str(n), "distance_miles": m, "weight_lbs": w, "pickup_date": "2026-05-01",
              "equipment_type": "Box Truck"}.get(c, "") for c in schemas.LOAD_COLUMNS}
         for n, (m, w) in enumerate([("10", "5"), ("3000000000", ""), ("", "3000000000"), ("9" * 30, "")])],
        ", ".join(f"{c} string" for c in schemas.LOAD_COLUMNS))
    loads, rejected = ingestion.import_loads(raw, aliases, "s", "UTC")
    assert [r.load_id for r in loads.collect()] == ["0"]
    assert sorted((r.load_id, r.p) for r in rejected.select("load_id", F.array_join("problems", ",").alias("p")).collect()) == [
        ("1", "distance_miles"), ("2", "weight_lbs"), ("3", "distance_miles")]


def test_csv_fields_are_cut_once(spark, tmp_path):
    """Filters on fields do not cut the record again, and the labels of all rows meet no shuffle."""
    row = lambda n: ",".join(f"2{n}" if c == "load_id" else "x" for c in schemas.LOAD_COLUMNS)
    (tmp_path / "x.csv").write_text("\n".join([",".join(schemas.LOAD_COLUMNS), row(1), row(2)]))
    aliases = spark.createDataFrame([("dataset", "x", "box_truck")],
                                    "source string, normalized_label string, equipment_code string")
    rows, problems = files.read_loads(spark, str(tmp_path / "x.csv"))
    loads, rejected = ingestion.import_loads(rows, aliases, "s", "UTC")
    for frame in (problems, loads, rejected):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "from_csv" not in plan and "SortMergeJoin" not in plan
    assert {r.load_id for r in rejected.collect()} == {"21", "22"} and loads.isEmpty()


def test_lines_are_cut_alike_however_they_arrive():
    """A reader that is given lines at once and one that is given each apart cut the same records."""
    rng = random.Random(5)
    for grammar in (records.Csv(), records.Lines()):
        for _ in range(3000):
            lines = "".join(rng.choices('ab,"\n\r', weights=[2, 1, 3, 4, 2, 1], k=rng.randint(0, 40))).split("\n")
            for inside in ((False, True) if isinstance(grammar, records.Csv) else (False,)):
                found = []
                for step in (1, 3, len(lines)):
                    reader = grammar.reader(inside, 0)
                    texts = [text for at in range(0, len(lines), step)
                             for text in reader.feed("\n".join(lines[at : at + step]), False)]
                    found.append((texts, reader.inside, reader.rest and "".join(reader.rest)))
                    assert grammar.walk("\n".join(lines), inside)[0] == reader.inside
                assert found[0] == found[1] == found[2]
