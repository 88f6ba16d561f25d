"""SimHash near-duplicates: fingerprints linked within a Hamming radius, found by BK-trees.

Distinct fingerprints are dealt into shards such that two within the radius of 4 surely meet: of
4 + k blocks of the 64 bits at least k agree, so k blocks and the values of some of their bits are
a shard. How many bits name it follows from the number of fingerprints, so that a shard holds some
``TREE`` of them at any size of the corpus; k grows only where k blocks have not enough bits. Each
shard is searched by a BK-tree: children hang on their parent by their integer Hamming distance to
it, and a query follows only the edges within the radius of its own distance.

The trees grow with the corpus, so they are not broadcast: a shard's fingerprints and its queries
are the same rows and meet by one shuffle of 5 to 35 rows of 20 bytes a fingerprint. Shards that a
1/64 sample shows to be large are cut into chunks, and each pair of chunks is a task of its own.
A shard hands on only links that join two parts of it, fewer than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored, texts
from brokerlake.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a shard that one BK-tree holds; larger shards are cut into such chunks.
CHUNK = 4096
#: Fingerprints that a shard is meant to hold, if bits were even.
TREE = 512
_SAMPLE = 64


def fingerprint(text: str, words_each: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()  # both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_each:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    count = len(words) - words_each + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        to = min(count, at + (1 << 15))
        hashes = np.array([
            xxh64_intdigest(joined[s:e], SEED)
            for s, e in zip(starts[at:to].tolist(),
                            ends[at + words_each - 1 : to + words_each - 1].tolist())
        ], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); NULL is the empty text, fp 0."""
    prepare(docs.sparkSession)

    def mark(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(text, words_each) for text in texts(batch.column("text"))]
            prints = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        mark, "doc_id long, fp long"
    )


class BKTree:
    """Codes by Hamming distance; a child hangs on its parent by its distance to it."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        new = len(self.codes)
        self.codes.append(code)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.codes[at] ^ code).bit_count(), new)
        return new

    def within(self, code: int, radius: int) -> list[int]:
        found: list[int] = []
        stack = [0] if self.codes else []
        codes, children = self.codes, self.children
        while stack:
            at = stack.pop()
            distance = (codes[at] ^ code).bit_count()
            if distance <= radius:
                found.append(at)
            edges = children[at]
            if edges:
                low, high = distance - radius, distance + radius
                stack.extend([child for edge, child in edges.items() if low <= edge <= high])
        return found


def joining_links(codes: list[int], sides: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join parts not joined yet: a spanning forest.

    Without ``sides`` all pairs count; with them only those between side 0 and side 1.
    """
    links: list[tuple[int, int]] = []
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = BKTree()
    if sides is None:
        members, queries = [], range(len(codes))
    else:
        members = [i for i, side in enumerate(sides) if side == 0]
        queries = [i for i, side in enumerate(sides) if side == 1]
        for i in members:
            tree.add(codes[i])
    for i in queries:
        for hit in tree.within(codes[i], radius):
            a, b = root(members[hit] if sides is not None else hit), root(i)
            if a != b:
                parent[b] = a
                links.append((codes[members[hit] if sides is not None else hit], codes[i]))
        if sides is None:
            tree.add(codes[i])
    return links


def _search(radius: int):
    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def runs(rows: dict, last: bool):
            """Links of all whole shards in ``rows``, and what is left for the next batch."""
            keys = [rows[k] for k in ("shard", "bits", "x", "y")]
            size = len(keys[0])
            new = np.zeros(size, bool)
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(new), [size]])
            if not last:
                cuts = cuts[:-1]
            links: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(cuts) > 1):
                part = slice(cuts[k], cuts[k + 1])
                codes = rows["fp"][part].view(np.uint64).tolist()
                apart = rows["x"][cuts[k]] != rows["y"][cuts[k]]
                sides = rows["side"][part].tolist() if apart else None
                links += joining_links(codes, sides, radius)
            return links, {k: v[cuts[-1] :] for k, v in rows.items()}

        kept: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fresh = {n: batch.column(n).to_numpy() for n in batch.schema.names}
            rows = {n: np.concatenate([kept[n], v]) if kept else v for n, v in fresh.items()}
            links, kept = runs(rows, False)
            if links:
                yield _links(links)
        if kept:
            links, _ = runs(kept, True)
            yield _links(links)

    def _links(links):
        import numpy as np
        import pyarrow as pa

        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"]
        )

    return search


def shard_masks(count: int, radius: int) -> list[int]:
    """Masks of which two codes within ``radius`` agree on at least one, for ``count`` codes.

    Codes that agree on a mask are some ``TREE`` in number, as far as 64 bits allow.
    """
    bits = max(0, (-(-count // TREE) - 1).bit_length())
    agreeing = next(k for k in range(1, 65) if k * (64 // (radius + k)) >= bits or k == 4)
    blocks = radius + agreeing
    width = 64 // blocks
    each, more = divmod(min(bits, agreeing * width), agreeing)
    masks = {
        sum(((1 << each + (n < more)) - 1) << 64 * block // blocks for n, block in enumerate(chosen))
        for chosen in combinations(range(blocks), agreeing)
    }
    return sorted(masks)


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` of ``prints`` within the radius of others.

    ``prints`` is read twice, once to count it.
    """
    masks = shard_masks(prints.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shards = F.explode(F.array(*(
        F.struct(F.lit(k).cast("short").alias("shard"), F.col("fp").bitwiseAND(m).alias("bits"))
        for k, m in enumerate(signed)
    )))
    keyed = prints.select("fp", shards.alias("_s")).select("fp", "_s.shard", "_s.bits")
    large = stored(
        keyed.where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLE)) == 0)
        .groupBy("shard", "bits").agg(F.count("*").alias("_n"))
        .where(F.col("_n") * _SAMPLE > CHUNK)
        .select("shard", "bits", F.ceil(F.col("_n") * _SAMPLE / CHUNK).cast("int").alias("_n")),
        "large",
    )
    if large.isEmpty():  # the usual case needs no join
        cells = keyed.select("*", *(F.lit(0).alias(c) for c in ("x", "y", "side")))
    else:
        chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("_n")).cast("int")
        cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(
            F.least("_c", k).alias("x"), F.greatest("_c", k).alias("y"),
            (F.col("_c") > k).cast("int").alias("side"),
        )))
        cells = (
            keyed.join(large, ["shard", "bits"], "left")
            .withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_c", chunk)
            .select("fp", "shard", "bits", cell.alias("_cell"))
            .select("fp", "shard", "bits", "_cell.x", "_cell.y", "_cell.side")
        )
    keys = ["shard", "bits", "x", "y"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _search(radius), "a long, b long"
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_each: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of at most ``radius`` differing bits reach.
    Texts of no words, NULL among them, have fingerprint zero and link like any other; repeated
    rows and equal texts share a class; a NULL doc_id is no candidate for ``component_id``, which
    is NULL only where all of a component's are. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, words_each), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_links(classes.select("fp"), radius))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    members = stored(placed.join(smallest, "root").select("fp", "component_id"), "members")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")
