"""Job lifecycle as a stateful stream: transitions wait in event-time order until they settle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brokerlake import vocab
from brokerlake.operators.jobs import TRANSITIONS, next_state

#: what has settled: the state, and the place of the last transition in it
SETTLED = "status string, retry_count int, at bigint, seq bigint"
#: transitions of one stretch of time that have not settled
WAITING = "at array<bigint>, seq array<bigint>, code array<int>"
OUTPUT = (
    "job_id string, transition string, seq_key bigint, accepted boolean, status string,"
    " retry_count int, last_error_code string, at bigint, late boolean"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: place of a transition without time: before all others, as in the batch fold
_NO_TIME = -(2**62)
_START = ("queued", 0, -(2**63), -(2**63))


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk beside the executors, with changes in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


class JobProcessor(StatefulProcessor):
    """Applies legal transitions in the order of (time, sequence) and ignores the others.

    A transition settles once the clock has passed it by ``lateness`` seconds: the watermark, or
    with ``stale_seconds`` the job's own newest transition. Until then it waits in a map from
    stretches of time to transitions, and one that arrives before it is applied before it: the
    waiting ones from there on come out again with their new states. Only a transition that
    belongs before a settled one cannot be applied; it comes out as late. One delivered twice
    counts once while it waits. With ``stale_seconds`` a job that stays in processing that long
    is failed by a processing-time timer, which settles all that waits.
    """

    def __init__(self, stale_seconds: int | None, lateness: int) -> None:
        self._stale_seconds = stale_seconds
        self._lateness = lateness * 1_000_000
        self._stretch = max(1, self._lateness)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._settled = handle.getValueState("settled", SETTLED)
        self._waiting = handle.getMapState("waiting", "stretch bigint", WAITING)

    def _state(self) -> tuple:
        return tuple(self._settled.get()) if self._settled.exists() else _START

    def _stretches(self) -> dict[int, tuple[list, list, list]]:
        """The waiting transitions by stretch of time."""
        return {int(stretch): tuple(map(list, value)) for (stretch,), value in self._waiting.iterator()}

    @staticmethod
    def _queue(stretches: dict[int, tuple[list, list, list]]) -> list[tuple[int, int, int]]:
        """The waiting transitions in order, each once."""
        found = {
            (int(at), int(seq)): int(code)
            for value in stretches.values() for at, seq, code in zip(*value)
        }
        return [(at, seq, found[at, seq]) for at, seq in sorted(found)]

    def _settle(self, queue: list[tuple[int, int, int]], before: int) -> None:
        """Fold the waiting transitions before a time into the settled state."""
        status, retries, last_at, last_seq = self._state()
        rest: dict[int, list] = {}
        for at, seq, code in queue:
            if at < before:
                status, retries = next_state(TRANSITIONS[code], status, retries) or (status, retries)
                last_at, last_seq = at, seq
            else:
                rest.setdefault(at // self._stretch, []).append((at, seq, code))
        self._settled.update((status, int(retries), int(last_at), int(last_seq)))
        self._waiting.clear()
        for stretch, rows in rest.items():
            self._waiting.updateValue((stretch,), tuple(map(list, zip(*rows))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, retries, last_at, last_seq = self._state()
        # plain lists: a job has few rows in a batch, and frames cost more than the work on them
        new, late = [], []
        for frame in rows:
            for name, seq, at, code in zip(*(frame[c].tolist() for c in ("transition", "seq_key", "at", "code"))):
                if (at, seq) < (last_at, last_seq):
                    late.append((key[0], name, seq, False, status, int(retries), None, at, True))
                elif (at, seq) != (last_at, last_seq):
                    new.append((at, seq, code))
            if late:
                yield _frame(late)
                late = []
        if not new:
            return
        first, newest = min(new)[:2], max(new)[0]
        waiting = self._stretches()
        changed = set()
        for row in new:
            stretch = row[0] // self._stretch
            changed.add(stretch)
            for values, value in zip(waiting.setdefault(stretch, ([], [], [])), row):
                values.append(value)
        queue, out = self._queue(waiting), []
        for at, seq, code in queue:
            after = next_state(TRANSITIONS[code], status, retries)
            status, retries = after or (status, retries)
            if (at, seq) >= first:
                out.append((key[0], TRANSITIONS[code], seq, after is not None, status, int(retries),
                            None, at, False))
        if self._stale_seconds is None:
            for stretch in changed:
                self._waiting.updateValue((stretch,), waiting[stretch])
            # the watermark reaches it when nothing older is due any more
            self._handle.registerTimer(max(1, newest // 1000 + 1))
        else:
            self._settle(queue, queue[-1][0] - self._lateness)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            if status == "processing":
                now = timerValues.getCurrentProcessingTimeInMs()
                self._handle.registerTimer(now + self._stale_seconds * 1000)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue = self._queue(self._stretches())
        if self._stale_seconds is None:
            self._settle(queue, expiredTimerInfo.getExpiryTimeInMs() * 1000)
            return
        self._settle(queue, 2**63)
        status, retries, at, seq = self._state()
        if status != "processing":
            return
        self._settled.update(("failed", retries, at, seq))
        yield _frame([
            (key[0], "sweep", int(seq), True, "failed", int(retries), "stale_processing", int(at), False)
        ])

    def close(self) -> None:
        pass


def job_state_stream(
    transitions: DataFrame,
    stale_seconds: int | None = vocab.STALE_PROCESSING_SECONDS,
    lateness_seconds: int = vocab.STALE_PROCESSING_SECONDS,
) -> DataFrame:
    """The state after each transition (and sweep), in order of time over all micro-batches.

    A transition comes out again when an earlier one arrives after it; its row of the latest
    batch counts. ``late`` marks those that arrived after a later one had settled; they are not
    applied. Timers keep a query running for ever; pass ``stale_seconds=None`` to drain a source
    and stop, and sweep the result as a batch. The stream must not have a watermark yet.
    """
    use_rocksdb(transitions.sparkSession)
    names = F.array(*[F.lit(n) for n in TRANSITIONS])
    timed = transitions
    if stale_seconds is None:
        timed = timed.withWatermark("at_time", f"{lateness_seconds} seconds")
    # the place is a column of its own, so that late rows reach the processor and are marked
    placed = timed.select(
        F.col("job_id"), "transition", "seq_key",
        F.coalesce(F.unix_micros("at_time"), F.lit(_NO_TIME)).alias("at"),
        (F.array_position(names, F.col("transition")) - 1).cast("int").alias("code"),
    )
    states = placed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobProcessor(stale_seconds, lateness_seconds),
        outputStructType=OUTPUT,
        outputMode="Update",
        timeMode="EventTime" if stale_seconds is None else "ProcessingTime",
    )
    at_time = F.when(F.col("at") != _NO_TIME, F.timestamp_micros("at"))
    return states.withColumn("at_time", at_time).drop("at")


def latest_states(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """The newest state of each job from all rows that the stream has put out.

    Of the rows with the job's last place that of the latest batch counts.
    """
    place = F.struct("at_time", "seq_key", batch)
    return rows.where("NOT late").groupBy("job_id").agg(
        F.max_by("status", place).alias("status"),
        F.max_by("retry_count", place).alias("retry_count"),
    )
