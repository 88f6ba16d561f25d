"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: a word's weight is its count times the square of its length (up
to 12 letters), so that words which say more count for more. For each of ``SAMPLES`` numbers every
term has gamma variates r and c and a uniform b, all fixed by a hash of the term; with
t = floor(ln(weight) / r + b) the term whose c / (e^(r (t - b)) e^r) is least is the sample, together
with its t. Two texts draw the same sample with the probability of their generalised Jaccard
similarity, the sum of lesser weights over the sum of greater ones. 16 bits of each sample are kept.

``edited_fingerprints`` also needs each document's successor. Rows go once through a shuffle into
ranges of ids; the first row of a range is sent to the range before it as well, so that every task
sees the successors of all its rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare

SAMPLES = 64
#: Terms whose variates a worker keeps.
_KEEP = 60_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = (np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _ODD).reshape(2, SAMPLES)
_SAMPLERS: list[Sampler] = []


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def _uniform(bits: np.ndarray, low: int, count: int) -> np.ndarray:
    """Numbers in (0, 1) from ``count`` of the bits."""
    part = (bits >> np.uint64(low)) & np.uint64((1 << count) - 1)
    return (part.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-count)


def weighted_terms(text: str) -> dict[str, float]:
    return {w: n * float(min(len(w), 12) ** 2) for w, n in Counter(text.split()).items()}


class Sampler:
    """Draws samples; keeps the variates of terms it has met."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.names = np.zeros(_KEEP, np.uint64)
        self.r = np.zeros((_KEEP, SAMPLES), np.float32)
        self.b = np.zeros((_KEEP, SAMPLES), np.float32)
        self.c = np.zeros((_KEEP, SAMPLES), np.float32)

    def _learn(self, terms: list[str]) -> None:
        from xxhash import xxh64_intdigest

        for at in range(0, len(terms), 1024):
            part = terms[at : at + 1024]
            names = np.array([xxh64_intdigest(t.encode("utf-8", "replace")) for t in part], np.uint64)
            first = _mixed(names[:, None] + _TURNS[0])
            second = _mixed(names[:, None] + _TURNS[1])
            here = slice(len(self.slots), len(self.slots) + len(part))
            self.names[here] = names
            self.r[here] = -np.log(_uniform(first, 0, 22) * _uniform(first, 22, 22))
            self.b[here] = _uniform(first, 44, 20)
            self.c[here] = np.log(-np.log(_uniform(second, 0, 24) * _uniform(second, 24, 24)))
            self.slots.update(zip(part, range(here.start, here.stop)))

    def draw(self, terms: dict[str, float]) -> bytes:
        """``SAMPLES`` little-endian unsigned 16-bit numbers; zeros for no terms."""
        best = np.full(SAMPLES, np.inf, np.float32)
        drawn = np.zeros(SAMPLES, np.uint64)
        names = list(terms)
        for at in range(0, len(names), 8192):
            part = names[at : at + 8192]
            fresh = [t for t in part if t not in self.slots]
            if len(self.slots) + len(fresh) > _KEEP:
                self.slots.clear()
                fresh = part
            self._learn(fresh)
            where = np.fromiter(map(self.slots.__getitem__, part), np.int64, len(part))
            weights = np.fromiter(map(terms.__getitem__, part), np.float64, len(part))
            heavy = np.log(weights).astype(np.float32)[:, None]
            r, b = self.r[where], self.b[where]
            t = np.floor(heavy / r + b)
            reach = self.c[where] - r * (t - b) - r
            winner = reach.argmin(axis=0)
            every = np.arange(SAMPLES)
            least = reach[winner, every]
            better = least < best
            best[better] = least[better]
            step = t[winner, every].astype(np.int64).view(np.uint64)
            found = _mixed(self.names[where[winner]] + step * _ODD)
            drawn[better] = found[better]
        return (drawn & np.uint64(0xFFFF)).astype("<u2").tobytes()


def sampler() -> Sampler:
    """The sampler of this worker process."""
    if not _SAMPLERS:
        _SAMPLERS.append(Sampler())
    return _SAMPLERS[0]


def likeness(one: bytes, other: bytes) -> float:
    """The share of equal samples; an empty text is like an empty text only."""
    if one == other:
        return 1.0
    if not any(one) or not any(other):
        return 0.0
    return float((np.frombuffer(one, "<u2") == np.frombuffer(other, "<u2")).mean())


def edited(text: str, after: str) -> str:
    """The text, its last half replaced by as much of the start of the one after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _compare(batches: Iterator) -> Iterator:
    import pyarrow as pa

    draw = sampler().draw
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
    names = [part.split()[0] for part in _OUT.split(", ")]
    previous = None  # (range, doc_id, text, samples)
    done: list[tuple] = []
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("part", "doc_id", "text", "guest"))
        for part, name, text, guest in zip(*columns):
            text = text or ""
            if guest and (previous is None or previous[0] != part):
                continue  # the range's last row has met its successor already
            samples = draw(weighted_terms(text))
            if previous is not None and previous[0] == part:
                new = edited(previous[2], text)
                changed = draw(weighted_terms(new))
                done.append((
                    previous[1], len(previous[2]),
                    hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(),
                    previous[3].hex(), changed.hex(),
                    likeness(previous[3], changed), likeness(previous[3], samples),
                ))
            previous = None if guest else (part, name, text, samples)
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names
            )
            done = []


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its text edited by the next row's.

    Rows follow each other by ascending doc_id, NULL first, then by a hash of the text; the last is
    followed by the first, a single row by itself. A NULL text is the empty text; a text without
    terms has a fingerprint of zeros, like only its own kind. Other columns are ignored.
    """
    from pyspark.ml.feature import Bucketizer

    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long"), "text", F.col("doc_id").cast("double").alias("_at")
    )
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least, unknown = rows.agg(
        F.min("_at"), F.coalesce(F.max(F.col("_at").isNull().cast("int")), F.lit(0))
    ).first()
    shares = [k / ranges for k in range(1, ranges)]
    # one number a range; each is the id of a row, so no range is empty
    found = rows.approxQuantile("_at", shares, 1 / (4 * ranges)) if shares and least is not None else []
    starts = sorted({at for at in found if at > least})
    if starts:
        splits = [float("-inf"), *starts, float("inf")]
        placed = Bucketizer(
            splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep"
        ).transform(rows)
    else:  # no row, or one id alone: a single range
        placed = rows.withColumn("_range", F.lit(0.0))
    # ids that are NULL are put in an extra last bucket; they come first here
    part = F.when(F.col("_at").isNull(), 0).otherwise(F.col("_range").cast("int"))
    last = len(starts)
    opens = F.col("_at").isNull() if unknown else F.col("_at") == F.lit(least)
    before = F.when(opens, last).when(F.col("_at").isin(starts), F.col("part") - 1)
    dealt = (
        placed.withColumn("part", part)
        .withColumn("_before", before)
        .select("doc_id", "text", F.explode(F.when(
            F.col("_before").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))
        ).otherwise(F.array(
            F.struct(F.col("part"), F.lit(False).alias("guest")),
            F.struct(F.col("_before").alias("part"), F.lit(True).alias("guest")),
        ))).alias("_to"))
        .select("_to.part", "_to.guest", "doc_id", "text")
    )
    return (
        dealt.repartition(ranges, "part")
        .sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(_compare, _OUT)
    )
