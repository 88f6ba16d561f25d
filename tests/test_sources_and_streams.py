"""Readers on generated packages, tables, evaluation figures and streaming."""

import hashlib
import io
import json
import random
import wave

import pytest
from pyspark.sql import functions as F

from brokerlake import schemas, vocab
from brokerlake.operators import aiops, ingestion, jobs
from brokerlake.plans import q_ingestion
from brokerlake.plans.tables import Tables
from brokerlake.sources import files, sinks
from brokerlake.streaming import ingest, job_state


def _wav(seconds=1.0, rate=8000, channels=1, width=2):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(b"\x01" * int(seconds * rate) * channels * width)
    return buffer.getvalue()


def test_recordings(spark, tmp_path):
    good = _wav(1.2345)
    late = good[:12] + b"LIST" + (9000).to_bytes(4, "little") + b"x" * 9000 + good[12:]
    late = late[:4] + (len(late) - 8).to_bytes(4, "little") + late[8:]
    cases = {"a": good, "b": b"", "c": b"RIFX" + good[4:], "d": good[:30], "e": _wav(0),
             "f": _wav(channels=3), "g": late, "h": b"RIFF", "i": _wav(601, rate=100, width=1),
             "j": good}
    for name, data in cases.items():
        (tmp_path / f"call_{name}.wav").write_bytes(data)
    (tmp_path / "notes.txt").write_text("x")
    rows, problems = files.read_calls(spark, str(tmp_path))
    got = {r.stem[-1]: r.error_code for r in rows.collect()}
    assert got == {"a": None, "b": "empty_file", "c": "invalid_signature", "d": "invalid_container",
                   "e": "no_audio", "f": "unsupported_channels", "g": None, "h": "invalid_signature",
                   "i": "too_long", "j": None}
    seconds = {r.stem[-1]: r.duration_seconds for r in rows.collect()}
    assert str(seconds["a"]) == str(seconds["g"]) == "1.23"
    found = {(r.problem, r.detail) for r in problems.collect()}
    assert ("unusable recording", "call_h.wav: invalid_signature") in found
    assert sum(p == "duplicate recording" for p, _ in found) == 1
    with pytest.raises(files.PackageError):
        files.require_clean(problems)


def _verdicts(spark, cases, **options):
    rows = spark.createDataFrame(
        [(f"/c/{name}.wav", f"{name}.wav", name, len(data), data) for name, data in cases],
        "path string, name string, stem string, length bigint, content binary")
    return sorted((r.stem, r.error_code) for r in files.validate_wav(rows, **options).collect())


def test_a_header_is_not_a_recording(spark):
    """Frames that are declared and not there, at the end of the file or of its RIFF chunk."""
    good = _wav(2.0)
    short = good[:4] + (len(good) - 9).to_bytes(4, "little") + good[8:]
    odd = good[:40] + (len(good) - 43).to_bytes(4, "little") + good[44:]  # a byte less than a frame more
    late = good[:36] + b"LIST" + (9000).to_bytes(4, "little") + b"x" * 9000 + good[36:]
    late = late[:4] + (len(late) - 8).to_bytes(4, "little") + late[8:]
    cases = [("cut", good[:-1]), ("frame", good[:-2]), ("header", good[:44]), ("late", late),
             ("late_cut", late[:-1]), ("odd", odd), ("riff", short), ("three", _wav(channels=3)[:-1]),
             ("whole", good)]
    broken = {"cut", "frame", "header", "late_cut", "riff", "three"}
    assert _verdicts(spark, cases) == [(n, "invalid_container" if n in broken else None) for n, _ in cases]
    # the importer counts declared frames
    assert _verdicts(spark, cases, whole=False) == [
        (n, "unsupported_channels" if n == "three" else None) for n, _ in cases]


def test_extensible_headers_name_pcm_in_full(spark):
    good = _wav()
    pcm = bytes.fromhex("0100000000001000800000aa00389b71")

    def extensible(sub):
        fmt = (b"\xfe\xff" + good[22:36] + (22).to_bytes(2, "little") + bytes(6) + sub)
        body = b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + good[36:]
        return b"RIFF" + len(body).to_bytes(4, "little") + body

    cases = [("other", extensible(pcm[:-1] + b"\x72")), ("pcm", extensible(pcm)), ("tag", extensible(b"\x01" + bytes(15)))]
    assert _verdicts(spark, cases) == [("other", "invalid_container"), ("pcm", None), ("tag", "invalid_container")]


def test_headers_are_those_of_the_wave_module():
    """Changed, cut and joined bytes: what Python's reader makes of them, and whether all frames are there."""
    rng = random.Random(5)
    seen = set()
    for _ in range(4000):
        data = bytearray(_wav(rng.choice([0, 0.001, 0.002]), channels=rng.choice([1, 2, 3]), width=rng.choice([1, 2, 3])))
        for _ in range(rng.choice([0, 0, 1, 2])):
            data[rng.choice([4, 16, 20, 22, 24, 34, 40, 41, rng.randrange(12, len(data))])] = rng.randrange(64)
        if rng.random() < 0.3:
            data[36:36] = b"LIST" + rng.choice([3, 4, 5]).to_bytes(4, "little") + b"abcdef"
        data = bytes(data[: rng.randrange(12, len(data) + 1)] if rng.random() < 0.3 else data)
        try:
            with wave.open(io.BytesIO(data)) as read:
                shape = (read.getnchannels(), read.getsampwidth(), read.getframerate(), read.getnframes())
                held = len(read.readframes(shape[3]))
                expected = (*shape, held == shape[0] * shape[1] * shape[3])
        except (wave.Error, EOFError, RuntimeError):
            expected = None
        assert files.wav_header(data) == expected, data
        seen.add(expected and expected[-1])
    assert seen == {None, True, False}


def test_oversize_recordings_are_not_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vocab, "MAX_WAV_BYTES", 1000)
    (tmp_path / "a.wav").write_bytes(_wav(0.01))
    (tmp_path / "b.wav").write_bytes(_wav(1))
    rows = files.read_recordings(spark, str(tmp_path))
    assert {r.stem: r.content is None for r in rows.collect()} == {"a": False, "b": True}
    assert {r.stem: (r.error_code, r.sha256 is None) for r in files.validate_wav(rows).collect()} == {
        "a": (None, False), "b": ("oversize", True)}


def test_recordings_are_validated_in_one_pass(spark):
    """No recording is read again by a join, and Python sees it once, also below a filter on the verdict."""
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = files.validate_wav(q_ingestion.recordings(t)).where("error_code IS NOT NULL")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_problems_of_recordings_store_nothing(spark):
    """Each of the importer's checks reads what it needs; a scan of the events is cheaper than a copy."""
    rows = q_ingestion.scan_calls_wav(Tables(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1
    assert plan.count("event_id") and plan.count("FileScan") <= 4


def test_generated_recordings(spark):
    """Bytes of the recordings that the queries read, header alone or with their audio."""
    t = Tables(spark, "/root/testdata/sf0.001")
    numbers = {r.event_id: r.user_id for r in t.base("events").collect()}
    whole = set()
    for audio in (False, True):
        for r in q_ingestion.recordings(t, audio).collect():
            event = int(r.stem[5:])
            kind, frames = event % 9, numbers[event] * 100 + event % 977 + 1
            assert (r.path, r.name, r.length) == (f"/calls/{r.stem}.wav", f"{r.stem}.wav", len(r.content))
            if kind not in (7, 8):
                continue
            made = io.BytesIO()
            with wave.open(made, "wb") as out:
                out.setparams((kind - 6, 2, 8000, frames, "NONE", ""))
                out.writeframes(b"a" * frames * 2 * (kind - 6))
            data = made.getvalue()
            if kind == 8:
                data = data[:36] + b"LIST" + (6000).to_bytes(4, "little") + b"x" * 6000 + data[36:]
            held = 2 * (kind - 6) * frames
            kept = held if audio and held <= 4096 else 0
            data = data[: len(data) - held + kept]
            size = len(data) - 8 - kept + (held if audio else 0)
            assert r.content == data[:4] + size.to_bytes(4, "little") + data[8:]
            whole.add(kept == held)
    assert whole == {True, False}


def test_loads_file(spark, tmp_path):
    header = ",".join(schemas.LOAD_COLUMNS)
    row = ('{id},"Erie, ""PA""",pa,16501,Newark, nj ,07101,{miles},Box Truck,,2026-05-01,{window},,'
           "520.00,open,,")
    lines = [header, row.format(id=1, miles=115, window="8:00 - 9:00"),
             row.format(id=2, miles="12.0", window=""), row.format(id=3, miles="", window="asap")]
    path = tmp_path / "loads.csv"
    path.write_text("\n".join(lines))
    rows, problems = files.read_loads(spark, str(path))
    files.require_clean(problems)
    aliases = spark.createDataFrame([("dataset", "box truck", "box_truck")],
                                    "source string, normalized_label string, equipment_code string")
    loads, rejected = ingestion.import_loads(rows, aliases, "s", "America/New_York")
    got = {r.load_id: r for r in loads.collect()}
    assert set(got) == {"1", "3"} and [r.load_id for r in rejected.collect()] == ["2"]
    assert got["1"].origin_city == 'Erie, "PA"' and got["1"].destination_state == "NJ"
    assert got["1"].equipment_code == "box_truck" and got["1"].weight_lbs is None
    assert got["3"].distance_miles is None and got["3"].pickup_window_status == "qualitative"
    path.write_text("\n".join([*lines, lines[1]]))
    with pytest.raises(files.PackageError, match="duplicate load_id"):
        files.require_clean(files.read_loads(spark, str(path))[1])
    path.write_text("load_id,status\n1,open\n")
    with pytest.raises(files.PackageError, match="missing required columns"):
        files.read_loads(spark, str(path))


def test_json_arrays(spark, tmp_path):
    carriers = [{"company_name": None, "mc_number": "1", "reliability_score": 4.5}, {"email": "x"}]
    (tmp_path / "c.json").write_text(json.dumps(carriers, indent=1))
    rows, problems = files.read_carriers(spark, str(tmp_path / "c.json"))
    assert [(r.ordinal, r.company_name, r.reliability_score) for r in rows.collect()] == [
        (0, None, "4.5"), (1, None, None)]
    assert [r.problem for r in problems.collect()] == ["missing required key"]
    email = {"email_id": "A", "timestamp": "2026-05-01T10:00:00Z", "from_email": "X@y.z",
             "to_email": "d", "subject": "s", "body": "b"}
    emails = [email, {**email, "timestamp": "2026-05-01 10:00", "body": "b \r\n"}]
    (tmp_path / "e.json").write_text(json.dumps(emails))
    rows, problems = files.read_emails(spark, str(tmp_path / "e.json"))
    assert {r.problem for r in problems.collect()} == {
        "duplicate email_id", "duplicate content", "timestamp without a zone"}
    (tmp_path / "bad.json").write_text("{}")
    assert files.read_emails(spark, str(tmp_path / "bad.json"))[1].first().problem == "not a JSON array"


@pytest.mark.parametrize("count", [0, 5, 150_000])
def test_listing_hash_has_one_rule(spark, count):
    listing = spark.range(count).select(F.concat(F.lit("f"), "id").alias("name"),
                                        F.sha2(F.col("id").cast("string"), 256).alias("checksum"))
    groups = {}
    for name in sorted(f"f{n}" for n in range(count)):
        pair = [name, hashlib.sha256(name[1:].encode()).hexdigest()]
        groups.setdefault(hashlib.sha256(name.encode()).hexdigest()[:4], []).append(pair)
    text = ",".join(
        f"{g}:{hashlib.sha256(json.dumps(p, separators=(',', ':')).encode()).hexdigest()}"
        for g, p in sorted(groups.items()))
    for n in (1, 3):
        got = files._listing_hash(listing.repartition(n)).first()[0]
        assert got == hashlib.sha256(text.encode()).hexdigest()


def test_csv_fields_may_hold_line_breaks(spark, tmp_path):
    names = files.schemas.LOAD_COLUMNS
    row = lambda n: ",".join(f'"two\nlines {n}"' if c == "load_id" else "x" for c in names)
    (tmp_path / "loads.csv").write_text("\n".join([",".join(names), row(1), row(2)]) + "\n")
    rows, problems = files.read_loads(spark, str(tmp_path / "loads.csv"))
    assert sorted(r.load_id for r in rows.collect()) == ["two\nlines 1", "two\nlines 2"]
    assert problems.isEmpty()


def test_upsert_is_idempotent(spark, tmp_path):
    schema = "carrier_id string, name string, snapshot_id string"
    rows = spark.createDataFrame([("1", "a", "s"), ("1", "b", "s"), ("2", "c", "s")], schema)
    for _ in range(2):
        sinks.upsert(rows, str(tmp_path), "carrier", ["carrier_id", "snapshot_id"], schema)
    assert sinks.load(spark, str(tmp_path), "carrier").count() == 2


@pytest.mark.parametrize("counts,score", [
    # --- fixed values: passed, failed, not applicable of two published runs ---
    ({"availability": (19, 15, 0), "equipment": (34, 0, 0), "grounding_rate": (34, 0, 0),
      "intent": (12, 22, 0), "load_reference": (34, 0, 0), "mc_number": (29, 1, 4),
      "rate_role": (16, 2, 16), "rate_value": (34, 0, 0)}, 0.8459),
    ({"availability": (16, 19, 0), "carrier_resolution": (14, 1, 20), "equipment": (34, 1, 0),
      "grounding_rate": (34, 0, 1), "intent": (23, 12, 0), "load_reference": (35, 0, 0),
      "load_resolution": (35, 0, 0), "mc_number": (30, 1, 4), "rate_role": (19, 0, 16),
      "rate_value": (35, 0, 0)}, 0.8987)])
def test_published_scores(spark, counts, score):
    rows = [(m, p) for m, c in counts.items() for p, n in zip((True, False, None), c)
            for _ in range(n)]
    metrics = aiops.eval_metrics(spark.createDataFrame(rows, "metric string, passed boolean"))
    assert aiops.eval_score(metrics).first().score == score


def test_manual_events_keep_local_time(spark):
    rows = spark.sql("""select 'e' event_id, 'manual' origin, 'email' channel,
        cast(null as string) external_source_id, cast(null as timestamp) source_occurred_at,
        timestamp'2026-07-01 03:15:00' received_at""")
    got = ingestion.event_identity(rows, "2026-05-25 16:00:00", "America/New_York").first()
    assert got.stable_evidence_id == "email:manual:e"
    assert str(got.occurred_at) == "2026-05-26 03:15:00"  # 23:15 local on the as-of date


def test_replayed_batch_has_no_second_effect(spark, tmp_path):
    batch = spark.createDataFrame(
        [("1", "a@b", "s", "x", "2026-01-01"), ("2", "A@b ", "s", "x \n", "2026-01-02"),
         ("3", "a@b", "s", "y", "2026-01-03")],
        "event_id string, sender_email_raw string, subject string, body_text string, t string"
    ).select("*", F.col("t").cast("timestamp").alias("submitted_at")).drop("t")
    handle = ingest.ingest_batch(str(tmp_path))
    for number in (0, 0, 1):
        handle(batch, number)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/events").collect()) == ["1", "3"]


def test_stalled_job_is_swept_by_a_timer(spark, tmp_path):
    spark.sql("select 'j' job_id, 'claim' transition, timestamp'2026-01-01' at_time, 1L seq_key"
              ).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.JOB_TRANSITION).parquet(f"{tmp_path}/in")
    query = (job_state.job_state_stream(stream, stale_seconds=1).writeStream.format("memory")
             .queryName("swept").outputMode("update").trigger(processingTime="1 second")
             .option("checkpointLocation", f"{tmp_path}/state").start())
    try:
        for _ in range(40):
            query.awaitTermination(1)
            rows = spark.sql("select * from swept where transition = 'sweep'").collect()
            if rows:
                break
    finally:
        query.stop()
    assert [(r.status, r.last_error_code) for r in rows] == [("failed", "stale_processing")]


def test_sweep_and_retry_rules(spark):
    frame = spark.sql("""select * from values
        ('a', 'processing', 'dataset', timestamp'2026-01-01 00:00:00', timestamp'2026-01-01 00:00:00', 0, null),
        ('b', 'queued', 'manual', timestamp'2026-01-01 00:00:00', null, 0, null),
        ('c', 'queued', 'dataset', timestamp'2026-01-01 00:00:00', null, 0, null),
        ('d', 'failed', 'dataset', timestamp'2026-01-01 00:00:00', null, 3, 'x'),
        ('e', 'failed', 'dataset', timestamp'2026-01-01 00:00:00', null, 0, 'invalid_source')
        as t(job_id, status, origin, submitted_at, started_at, retry_count, last_error_code)""")
    at = lambda s: F.lit("2026-01-01").cast("timestamp") + F.expr(f"interval {s} seconds")
    swept = {r.job_id for r in jobs.stale_sweep(frame, at(1801)).where("swept").collect()}
    assert swept == {"a", "b"}
    assert not jobs.stale_sweep(frame, at(900)).where("swept").count()
    again = jobs.stale_sweep(frame, at(1801))
    picked = jobs.retry_selection(again)
    assert {(r.job_id, r.decision) for r in picked.collect()} == {
        ("a", "selected"), ("b", "selected"), ("d", "skipped_retry_limit")}
    after = {r.job_id: (r.status, r.retry_count) for r in jobs.retry_jobs(picked, again).collect()}
    assert after["a"] == ("queued", 1) and after["d"] == ("failed", vocab.MAX_JOB_RETRIES)


def _drain_jobs(spark, root, deliveries, lateness):
    """One run of the query per delivery; rows of (job, transition, seconds, sequence)."""
    def store(rows, number):
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for rows in deliveries:
        spark.createDataFrame(rows, "job_id string, transition string, s double, seq_key bigint").select(
            "job_id", "transition", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("at_time"),
            "seq_key").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schemas.JOB_TRANSITION).parquet(f"{root}/in")
        (job_state.job_state_stream(stream, None, lateness).writeStream.foreachBatch(store)
         .outputMode("update").option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")


def test_late_transitions_over_many_batches_equal_the_batch_fold(spark, tmp_path):
    pick = random.Random(5)
    # ties in time, and one job with most of the rows
    log = [(pick.choice("aaaabcd"), pick.choice(jobs.TRANSITIONS), 1e6 + float(pick.randrange(4000)), n)
           for n in range(400)]
    sent = sorted(log, key=lambda r: r[2] + pick.randrange(900))
    deliveries = [sent[at:at + 80] for at in range(0, 400, 80)]
    deliveries[3] = deliveries[3] + deliveries[2][-5:]  # delivered twice
    rows = _drain_jobs(spark, tmp_path, deliveries, 1000)
    got = {r.job_id: (r.status, r.retry_count) for r in job_state.latest_states(rows).collect()}
    want = {}
    for job, name, _, _ in sorted(log, key=lambda r: (r[2], r[3])):
        state = want.get(job, ("queued", 0))
        want[job] = jobs.next_state(name, *state) or state
    assert got == want
    assert not rows.where("late").count()
    assert rows.count() > 400  # some came out again, after an earlier one arrived


def test_transition_before_a_settled_one_is_marked(spark, tmp_path):
    deliveries = [
        [("j", "claim", 1000.0, 1), ("j", "complete", 1010.0, 2), ("k", "claim", 1000.0, 3)],
        [("x", "claim", 5000.0, 4)],  # the watermark passes all of the above
        [("j", "fail", 1005.0, 5), ("k", "fail", 1005.0, 6), ("j", "claim", 1010.0, 2)],
    ]
    rows = _drain_jobs(spark, tmp_path, deliveries, 60)
    # k has nothing settled behind its late row; j has, and its repeated row is ignored
    assert [r.seq_key for r in rows.where("late").collect()] == [5]
    got = {r.job_id: r.status for r in job_state.latest_states(rows).collect()}
    assert got == {"j": "completed", "k": "failed", "x": "processing"}


def test_contents_are_taken_in_once_over_five_batches(spark, tmp_path):
    schema = "event_id string, sender_email_raw string, subject string, body_text string, submitted_at timestamp"
    contents = [["a", "b"], ["b", "c", "c"], ["a"], ["d", "a"], ["d", "e", "b"]]
    for n, bodies in enumerate(contents):
        spark.createDataFrame([(f"{n}-{i}", "s@t", "x", body, None) for i, body in enumerate(bodies)], schema
                              ).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schemas.SUBMISSION).parquet(f"{tmp_path}/in")
        ingest.start_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    taken = lambda: sorted(
        (r.batch, r.body_text) for r in spark.read.parquet(f"{tmp_path}/out/events").collect())
    assert taken() == [(0, "a"), (0, "b"), (1, "c"), (3, "d"), (4, "e")]
    # the last batch is run again, as after a crash before its commit
    (tmp_path / "state" / "commits" / "4").unlink()
    (tmp_path / "state" / "commits" / ".4.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(schemas.SUBMISSION).parquet(f"{tmp_path}/in")
    query = ingest.start_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert taken() == [(0, "a"), (0, "b"), (1, "c"), (3, "d"), (4, "e")]
    assert [s.operatorName for s in query.lastProgress.stateOperators] == ["dedupe"]


def test_completed_batches_are_not_run_again(spark):
    schema = "source_type string, ordinal long, outcome string, error string"
    batches = ingestion.batch_stats(spark.createDataFrame(
        [("a", 0, "created", None), ("b", 0, "failed", "E"), ("c", 0, "failed", "E")], schema))
    again = spark.createDataFrame(
        [("a", 0, "failed", "E"), ("a", 1, "created", None), ("b", 0, "created", None), ("d", 0, "created", None)],
        schema)
    got = {r.source_type: (r.status, r.records_seen, r.records_failed, r.error_summary)
           for r in ingestion.rerun_batches(batches, again).collect()}
    assert got == {"a": ("completed", 1, 0, ""), "b": ("completed", 1, 0, ""),
                   "c": ("partially_failed", 1, 1, "row 0: E"), "d": ("completed", 1, 0, "")}
    assert not ingestion.rerun_batches(batches.limit(0), again.limit(0)).count()


def test_a_batch_reads_the_waiting_transitions_of_a_job_once():
    """State lies behind a socket: it is read once, and only changed stretches are written."""
    import pandas as pd

    from brokerlake.operators.jobs import TRANSITIONS
    from brokerlake.streaming.job_state import JobProcessor

    class State:
        def __init__(self):
            self.kept, self.calls = {}, []

        def exists(self):
            return () in self.kept

        def get(self):
            return self.kept[()]

        def iterator(self):
            self.calls.append("iterator")
            return iter(list(self.kept.items()))

        def getValue(self, key):
            self.calls.append("getValue")
            return self.kept.get(key)

        def updateValue(self, key, value):
            self.calls.append("updateValue")
            self.kept[key] = value

    class Handle:
        def __init__(self):
            self.settled, self.waiting, self.timers = State(), State(), []

        def getValueState(self, *_):
            return self.settled

        def getMapState(self, *_):
            return self.waiting

        def registerTimer(self, at):
            self.timers.append(at)

    handle, processor = Handle(), JobProcessor(None, 10)
    processor.init(handle)
    batch = lambda *rows: iter([pd.DataFrame(
        [(n, s, a * 1_000_000, c) for n, s, a, c in rows], columns=["transition", "seq_key", "at", "code"])])
    claim, complete = TRANSITIONS.index("claim"), TRANSITIONS.index("complete")
    first = list(processor.handleInputRows(
        ("j",), batch(("complete", 2, 25, complete), ("claim", 1, 5, claim), ("claim", 3, 35, claim)), None))
    assert list(first[0]["status"]) == ["processing", "completed", "completed"]
    handle.waiting.calls.clear()
    second = list(processor.handleInputRows(("j",), batch(("claim", 0, 36, claim)), None))
    assert list(second[0]["accepted"]) == [False]
    assert handle.waiting.calls == ["iterator", "updateValue"]


def test_emails_are_fingerprinted_once(spark, tmp_path):
    """Rows and checks read what was stored; the fields are those of the text, and none is lost."""
    email = {"email_id": "A", "timestamp": "2026-05-01T10:00:00Z", "from_email": "X@y.z", "to_email": "d",
             "subject": "s \"é\"", "body": "one\n{two}, \\ three"}
    (tmp_path / "e.json").write_text(json.dumps([email, {**email, "email_id": "B", "subject": None}]))
    rows, problems = files.read_emails(spark, str(tmp_path / "e.json"))
    for frame in (rows, problems):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "sha2" not in plan and "ArrowEvalPython" not in plan
    got = {r.email_id: r for r in rows.collect()}
    assert {f: got["A"][f] for f in email} == email and got["B"].subject is None
    assert json.loads(got["A"].row_json) == email and got["A"].source_occurred_at is not None
    assert len(got["A"].content_fingerprint) == 64 and problems.isEmpty()
