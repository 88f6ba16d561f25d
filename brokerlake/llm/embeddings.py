"""Embedding near-duplicates by spherical-cap filters.

A filter is a unit direction; a vector belongs to every filter whose direction it exceeds a fixed
inner product with, so close vectors share filters and others hardly ever do. Directions are random
product codes: after a random rotation the space is two halves with ``CODES`` random directions
each, and a filter is a pair of them. List decoding finds all filters of a vector without looking
at all pairs: codes of one half that cannot reach the height with the best of the other are left
out, and only the rest is paired. ``ROTATIONS`` independent codes make the recall even over vectors.

Vectors meet on filters; a filter's vectors are compared as blocks of a matrix product in double
precision, and what leaves the task is a spanning forest of the links found. Links join only
vectors of one component, so a vector's links are then counted within its component, again as blocks.
Equal vectors are one class from the start. Filters and components of more than ``BLOCK`` classes
are cut into blocks, each pair of blocks a unit of work, so that no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored
from brokerlake.llm.components import components

SIMILARITY = 0.9
#: With these a pair of 64-dimensional vectors at a cosine of 0.9 is found in 97 of 100 cases.
ROTATIONS, CODES, FILTERS_EACH = 16, 256, 2.6
BLOCK = 2048
SEED = 20


def cap_height(dimensions: int, share: float) -> float:
    """The inner product that a random unit vector exceeds with probability ``share``."""
    heights = np.linspace(-1, 1, 200_001)[1:-1]
    density = (1 - heights**2) ** ((dimensions - 3) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(heights[np.searchsorted(-above, -share)])


class ProductCode:
    """The filters of one number of dimensions; made for 32 and more, correct for any."""

    def __init__(self, dimensions: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dimensions])
        self.size = max(2, dimensions)
        self.codes = CODES if dimensions >= 32 else 16
        self.height = min(0.85, cap_height(self.size, FILTERS_EACH / self.codes**2))
        half = self.size // 2
        self.parts = []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(rng.standard_normal((self.size, self.size)))[0]
            ends = []
            for rows in (turn[:half], turn[half:]):
                code = rng.standard_normal((self.codes, len(rows)))
                code /= np.linalg.norm(code, axis=1, keepdims=True) * np.sqrt(2)
                ends.append((code @ rows).T)
            self.parts.append(ends)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, filter) of unit vectors, filters numbered over all rotations."""
        if unit.shape[1] < self.size:
            unit = np.pad(unit, ((0, 0), (0, self.size - unit.shape[1])))
        rows, filters = [], []
        for number, (left, right) in enumerate(self.parts):
            p, q = unit @ left, unit @ right
            rp, cp = np.nonzero(p >= self.height - q.max(1, keepdims=True))
            rq, cq = np.nonzero(q >= self.height - p.max(1, keepdims=True))
            # pair each code of the first half with all codes of the second in its row
            starts = np.searchsorted(rq, np.arange(len(unit) + 1))
            each = (starts[1:] - starts[:-1])[rp]
            first = np.repeat(np.arange(len(rp)), each)
            within = np.arange(len(first)) - np.repeat(np.cumsum(each) - each, each)
            second = starts[rp[first]] + within
            good = p[rp[first], cp[first]] + q[rq[second], cq[second]] >= self.height
            first, second = first[good], second[good]
            rows.append(rp[first])
            filters.append((number * self.codes + cp[first]) * self.codes + cq[second])
        return np.concatenate(rows), np.concatenate(filters)


@lru_cache(maxsize=8)
def product_code(dimensions: int) -> ProductCode:
    return ProductCode(dimensions)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares stay finite."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components that is not all zeros."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _segments(batch):
    """A batch as (columns, matrix of vectors), cut where the number of dimensions changes."""
    vectors = batch.column("vector")
    lengths = vectors.value_lengths().to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    others = {n: batch.column(n).to_numpy() for n in batch.schema.names if n != "vector"}
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            matrix = flat[ends[start] : ends[end]].reshape(end - start, -1)
            yield {n: c[start:end] for n, c in others.items()}, matrix


def _whole_groups(batches: Iterator, keys: list[str]) -> Iterator:
    """(columns, unit vectors, cuts between groups) of sorted rows; a group is never divided."""
    kept = None
    for batch in batches:
        for columns, matrix in _segments(batch):
            fresh = units(matrix)
            if kept is not None and kept[1].shape[1] == fresh.shape[1]:
                columns = {n: np.concatenate([kept[0][n], c]) for n, c in columns.items()}
                fresh = np.concatenate([kept[1], fresh])
            elif kept is not None:
                yield (*kept, np.array([0, len(kept[1])]))
            new = np.zeros(len(fresh), bool)
            for key in keys:
                new[1:] |= columns[key][1:] != columns[key][:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new)]).astype(np.int64)
            if cuts[-1]:
                yield {n: c[: cuts[-1]] for n, c in columns.items()}, fresh[: cuts[-1]], cuts
            kept = {n: c[cuts[-1] :] for n, c in columns.items()}, fresh[cuts[-1] :]
    if kept is not None:
        yield (*kept, np.array([0, len(kept[1])]))


def _cells(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of a key with more than ``block`` rows, once per pair of blocks that needs them.

    Adds x, y (the pair) and side (which of the two the row is).
    """
    large = stored(
        rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
        .select(F.col(key).alias("_key"), F.ceil(F.col("_n") / block).cast("int").alias("_n")),
        "large",
    )
    if large.isEmpty():
        return rows.select("*", *(F.lit(0).alias(c) for c in ("x", "y", "side")))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(
        F.least("_c", k).alias("x"), F.greatest("_c", k).alias("y"),
        (F.col("_c") > k).cast("int").alias("side"),
    )))
    return (
        rows.join(large, F.col(key) == F.col("_key"), "left")
        .withColumn("_n", F.coalesce("_n", F.lit(1)))
        .withColumn("_c", F.pmod(F.xxhash64("class"), F.col("_n")).cast("int"))
        .select(*rows.columns, cell.alias("_cell")).select(*rows.columns, "_cell.x", "_cell.y", "_cell.side")
    )


def _sorted_cells(rows: DataFrame, key: str) -> DataFrame:
    keys = [key, "x", "y"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _pairs(unit: np.ndarray, cuts: np.ndarray, apart: np.ndarray, side: np.ndarray,
           least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at a cosine of at least ``least`` within the groups between cuts.

    Small groups are compared together, one distance between rows at a time; large ones as blocks.
    """
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes <= 24
    for step in range(1, int(sizes[small].max(initial=0))):
        a = np.flatnonzero((group[step:] == group[:-step]) & small[group[step:]])
        b = a + step
        ok = ~apart[a] | (side[a] != side[b])
        a, b = a[ok], b[ok]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        yield a[near], b[near]
    for k in np.flatnonzero(~small):
        start, end = cuts[k], cuts[k + 1]
        for at in range(start, end, 512):
            to = min(end, at + 512)
            a, b = np.nonzero(unit[at:to] @ unit[at:end].T >= least)
            a, b = a + at, b + at
            ok = (b > a) & (~apart[a] | (side[a] != side[b]))
            yield a[ok], b[ok]


def _forest(classes: np.ndarray, found: Iterator) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b in found:
        for left, right in zip(classes[a].tolist(), classes[b].tolist()):
            i, j = root(left), root(right)
            if i != j:
                parent[j] = i
                links.append((left, right))
    return links


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id that
    links reach. Vectors that are NULL, empty, zero or hold NULL or non-finite components link with
    nothing, vectors of different length not with each other. Repeated rows and ids are rows of
    their own; a NULL vec_id is no candidate for ``component_id`` and not kept. Other columns are
    ignored.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    classes = stored(
        rows.where(usable(F.col("vector"))).groupBy("vector")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("members"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for columns, matrix in _segments(batch):
                size = matrix.shape[1]
                row, number = product_code(size).decode(units(matrix))
                order = np.argsort(row, kind="stable")
                names = columns["class"][row[order]]
                filters = number[order].astype(np.int64) + size * (1 << 32)
                taken = pa.array(np.arange(len(matrix)).repeat(np.bincount(row, minlength=len(matrix))))
                wide = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filters), pa.array(names), wide.take(taken).cast(pa.list_(wide.type.value_type))],
                    names=["filter", "class", "vector"],
                )

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for columns, unit, cuts in _whole_groups(batches, ["filter", "x", "y"]):
            apart = columns["x"] != columns["y"]
            links = _forest(columns["class"], _pairs(unit, cuts, apart, columns["side"], similarity))
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"]
            )

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for columns, unit, cuts in _whole_groups(batches, ["root", "x", "y"]):
            apart = columns["x"] != columns["y"]
            total = np.zeros(len(unit), np.int64)
            members = columns["members"]
            for a, b in _pairs(unit, cuts, apart, columns["side"], similarity):
                total += np.bincount(a, members[b], len(unit)).astype(np.int64)
                total += np.bincount(b, members[a], len(unit)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns["class"]), pa.array(total)], names=["class", "links"]
            )

    kind = classes.schema["vector"].dataType.simpleString()
    # filters are few bytes, the vector goes with them; both leave the decoding task together
    narrow = classes.select("class", "vector").mapInArrow(
        decode, f"filter long, class long, vector {kind}"
    )
    links = _sorted_cells(_cells(narrow, "filter", BLOCK), "filter").mapInArrow(join, "a long, b long")
    roots = components(links)
    joined = classes.join(roots, F.col("class") == F.col("node"))
    grouped = stored(joined.select("root", "class", "members", "first", "vector"), "grouped")
    counted = _sorted_cells(
        _cells(grouped.select("root", "class", "members", "vector"), "root", BLOCK), "root"
    ).mapInArrow(count, "class long, links long")
    links_of = counted.groupBy("class").agg(F.sum("links").alias("links"))
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component"))
    linked = grouped.select("root", "class").join(firsts, "root").join(links_of, "class").select(
        "class", "component", "links"
    )
    placed = stored(classes.join(linked, "class", "left").select(
        F.col("vector").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component", "first").alias("component_id"),
    ), "placed")
    return (
        rows.join(placed, usable(F.col("vector")) & (F.col("vector") == F.col("_vector")), "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


#: The same links by comparing all pairs, as DuckDB SQL over ``embeddings``.
ALL_PAIRS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
    AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= {SIMILARITY}
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links,
  min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r GROUP BY r.a
"""
