"""Ordered folds of a finite state machine over keys of any size.

The log is sorted once by (key, order) and fixed as ranges. Each range is folded by its own
task; a key that runs over several ranges hands its state on. What is handed on is, per range,
the effect of its first and last run on every possible state, so at most two rows per range meet
in one place, whatever the size of a key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake.scale import sorted_ranges

#: A slot that a run has not written; a written one may hold None.
_UNSET = object()


def _walk(frames: Iterator[pd.DataFrame], table: np.ndarray, slots: int, width: int):
    """Effect of each range's first and last run of one key on all ``width`` start states."""
    runs: list[dict] = []
    part = None
    state: dict | None = None
    for frame in frames:
        keys = frame["_key"].to_numpy()
        codes = frame["_code"].to_numpy()
        slot = frame["_slot"].to_numpy()
        value = frame["_value"].to_numpy()
        if len(frame):
            part = int(frame["_part"].iloc[0])
        for key, code, at, new in zip(keys, codes, slot, value):
            if state is None or state["key"] != key:
                if state is not None and not runs:
                    runs.append(state)
                state = {
                    "key": key, "end": np.arange(width),
                    "kept": np.full((slots, width), _UNSET, dtype=object),
                }
            step = table[code, state["end"]]  # every start state at once
            state["end"] = step[:, 0]
            if at >= 0:
                state["kept"][at][step[:, 1] == 1] = new
    if state is not None:
        last = len(runs) > 0
        runs.append(state)
        for place, run in enumerate(runs):
            yield {
                "_part": part, "_place": 1 if last and place == 1 else 0, "_key": run["key"],
                "_end": run["end"].tolist(),
                "_kept": [
                    json.dumps([[] if v is _UNSET else [v] for v in kept])
                    for kept in (run["kept"].T if slots else [[]] * width)
                ],
                "_only": not last,
            }


def fold(
    log: DataFrame,
    key: str,
    order: list[Column],
    code: Column,
    table: np.ndarray,
    initial: DataFrame,
    slot: Column | None = None,
    value: Column | None = None,
    slots: int = 0,
) -> DataFrame:
    """Add ``state_before``, ``state_after``, ``accepted`` and ``slots_before`` to each log row.

    ``table[code, state] = (next state, accepted)``. ``initial``: key, ``start_state`` and
    ``start_slots`` (array of strings). An accepted row with ``slot >= 0`` stores ``value`` there;
    a NULL is stored like any other value.
    """
    width = table.shape[1]
    prepared = (
        log.join(initial.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"))
        .withColumn("_code", code.cast("int"))
        .withColumn("_slot", (F.lit(-1) if slot is None else slot).cast("int"))
        .withColumn("_value", F.lit(None).cast("string") if value is None else value)
    )
    ranged = sorted_ranges(prepared, ["_key"], order)

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(_walk(frames, table, slots, width))
        if rows:
            yield pd.DataFrame(rows)

    runs = ranged.select("_part", "_key", "_code", "_slot", "_value").mapInPandas(
        summarise,
        "_part int, _place int, _key string, _end array<int>, _kept array<string>, _only boolean",
    )

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # at most two rows per range arrive here
        rows = pd.concat(list(frames), ignore_index=True)
        rows = rows.sort_values(["_part", "_place"])
        out, open_key, ends, kept = [], None, None, None
        for row in rows.itertuples(index=False):
            part, place, key_, end, keep = row[0], row[1], row[2], list(row[3]), list(row[4])
            keep = [json.loads(k) for k in keep]  # per state and slot: [] or [value]
            if place == 0 and open_key == key_:
                out.append((part, key_, ends, [json.dumps(k) for k in kept]))
                merged_ends = [end[e] for e in ends]
                kept = [
                    [new or old for old, new in zip(kept[s], keep[ends[s]])]
                    for s in range(width)
                ]
                ends = merged_ends
            else:
                open_key, ends, kept = key_, end, keep
        yield pd.DataFrame(out, columns=["_part", "_key", "_ends", "_carried"])

    # the exchange lets every range be summarised by its own task; only summaries meet in one
    carried = runs.repartition(1).mapInPandas(
        chain, "_part int, _key string, _ends array<int>, _carried array<string>"
    )
    # one row per range at most: bounded by the number of ranges
    entered = ranged.join(F.broadcast(carried), ["_part", "_key"], "left")
    fields = [f for f in prepared.columns if f not in ("_code", "_slot", "_value", "_key")]
    keep_columns = [f for f in fields if f not in ("start_state", "start_slots")]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, stored = None, 0, []
        for frame in frames:
            before, after, ok, slots_before = [], [], [], []
            for row_key, code_, at, new, start, first, ends, kept in zip(
                frame["_key"], frame["_code"], frame["_slot"], frame["_value"],
                frame["start_state"], frame["start_slots"], frame["_ends"], frame["_carried"],
            ):
                if row_key != current:
                    current, state, stored = row_key, int(start), list(first)
                    if ends is not None:
                        carried_slots = json.loads(kept[state])
                        stored = [
                            new_[0] if new_ else old for old, new_ in zip(stored, carried_slots)
                        ]
                        state = int(ends[state])
                before.append(state)
                slots_before.append(list(stored))
                following, accepted = table[code_, state]
                state = int(following)
                if accepted and at >= 0:
                    stored[at] = new
                after.append(state)
                ok.append(bool(accepted))
            result = frame[keep_columns].copy()
            result["state_before"], result["state_after"] = before, after
            result["accepted"], result["slots_before"] = ok, slots_before
            yield result

    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        for f in prepared.schema if f.name in keep_columns
    )
    return entered.select(
        "_key", "_code", "_slot", "_value", "start_state", "start_slots", "_ends", "_carried",
        *keep_columns,
    ).mapInPandas(
        apply,
        schema + ", state_before int, state_after int, accepted boolean, slots_before array<string>",
    )
