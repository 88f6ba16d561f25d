"""Ranked lexical search by the Best Position Algorithm over shards of documents.

Items are read in blocks of bounded size. For a block, one pass over the texts keeps of each document
its number of terms and the counts of those terms that the block asks for; the corpus statistics are
aggregates of that table. Each task then cuts its rows into shards, orders every term's documents of
a shard by falling impact, and searches the lists of an item: it reads all lists to the same depth,
fetches the remaining impacts of each new document by direct access, marks the positions so seen, and
bounds every unseen document by the impacts at the best positions, the ends of the contiguously seen
prefixes. It stops when that bound is strictly below the k-th score found so far in the task, so ties
are settled by document id alone. The k best of each task meet in a two-step top-k.

All score arithmetic is in 64-bit integers, as is the order of impacts, so bounds are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored

#: Items of a block, and characters of their texts; an item longer than that is a block of its own.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 2_000_000
#: Cells of a shard's table of positions (terms of the block times documents), 4 bytes each.
CELLS = 12_000_000
#: Documents of a shard at most, and how deep the lists are first read.
SHARD_DOCS, FIRST_DEPTH = 4_096, 32
_SALTS = 64

#: ASCII letters and digits and every byte of a longer character are parts of terms.
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_LOWERED = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_WORD_BYTES) else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased; a NULL text has none."""
    return (text or "").encode().translate(_LOWERED).split()


def blocks(items: DataFrame) -> Iterator[dict[int | None, Counter]]:
    """The items (item_id, text) in order of id, as term counts, a bounded block at a time.

    The table is streamed to the driver, which holds one block. Rows that repeat an id follow each
    other and are one item with the terms of all of them; items without terms are left out.
    """
    block: dict[int | None, Counter] = {}
    chars = 0
    ordered = items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id")
    for row in ordered.toLocalIterator():
        size = len(row.text or "")
        if row.item_id not in block and block and (
            len(block) >= BLOCK_ITEMS or chars + size > BLOCK_CHARS
        ):
            yield block
            block, chars = {}, 0
        if found := terms(row.text):
            block.setdefault(row.item_id, Counter()).update(found)
            chars += size
    if block:
        yield block


def count_terms(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all its terms), and the ids and counts of its ``wanted`` terms, per document."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        get = wanted.get
        for batch in batches:
            sizes, ids, counts, offsets = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").translate(_LOWERED).split()
                found = Counter(map(get, words))
                found.pop(None, None)
                sizes.append(len(words))
                ids.extend(found.keys())
                counts.extend(found.values())
                offsets.append(len(ids))
            ends = pa.array(np.array(offsets, "i4"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
            ], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


class Shard:
    """The impact lists of some documents: per term, documents by falling impact."""

    def __init__(self, n, terms, counts, rows, n_terms: int, documents: int, total: int):
        """``terms``, ``counts`` and ``rows`` (place in ``n``) are parallel, one entry per posting."""
        import numpy as np

        m = 100 - 25 + (25 * n * documents) // total
        tf = counts.astype("i8")
        impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[rows])
        order = np.lexsort((rows, -impact, terms))
        self.impact, self.rows = impact[order], rows[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.size = len(n)
        #: of each (term, document) its position in the term's list, or -1
        self.place = np.full((n_terms, self.size), -1, "i4")
        at = np.arange(len(order)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        self.place[terms[order], self.rows] = at

    def search(self, wanted, weights, k: int, best) -> tuple:
        """The documents that may be among the k best, their scores, and how deep the lists were read.

        ``wanted`` are term ids, ``weights`` what an impact of each counts, above 0; ``best`` holds
        the k best scores known from elsewhere, falling.
        """
        import numpy as np

        lengths = np.diff(self.starts)[wanted]
        wanted, weights, lengths = (x[lengths > 0] for x in (wanted, weights, lengths))
        found_rows, found_scores = [], []
        deepest = int(lengths.max(initial=0))
        starts = self.starts[wanted][:, None]
        places = self.place[wanted]
        known = np.zeros(self.size, bool)
        seen = np.zeros((len(wanted), deepest + 1), bool)  # the last column ends every list
        depth = 0
        while depth < deepest:
            to = min(deepest, depth + max(FIRST_DEPTH, depth // 2))
            reach = np.arange(depth, to)[None, :]
            fresh = np.zeros(self.size, bool)
            fresh[self.rows[(starts + reach)[reach < lengths[:, None]]]] = True
            depth = to
            new = np.flatnonzero(fresh & ~known)
            known[new] = True
            # direct access: positions and impacts of the new documents in all lists
            at = places[:, new]
            held = at >= 0
            impacts = np.where(held, self.impact[np.where(held, starts + at, 0)], 0)
            scores = (weights[:, None] * impacts).sum(axis=0)
            seen[np.nonzero(held)[0], at[held]] = True
            may = scores >= max(1, best[-1] if len(best) >= k else 1)
            found_rows.append(new[may])
            found_scores.append(scores[may])
            best = -np.sort(-np.concatenate([best, scores[may]]))[:k]
            if len(best) < k:
                continue
            prefix = seen.argmin(axis=1)  # positions seen without a gap
            at_best = self.impact[starts[:, 0] + prefix - 1]
            # a list seen to its end holds no unseen document
            if int((weights * np.where(prefix == lengths, 0, at_best)).sum()) < best[-1]:
                break
        if not found_rows:
            return np.zeros(0, "i8"), np.zeros(0, "i8"), depth
        return np.concatenate(found_rows), np.concatenate(found_scores), depth


def _search_task(asked: list, n_terms: int, documents: int, total: int, k: int):
    """The mapInArrow function: the k best documents of its rows for each item of ``asked``."""

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        none = np.zeros(0, "i8")
        # of each item the k best so far: scores, ids, whether the id is NULL, in order
        tops = [(none, none, np.zeros(0, bool)) for _ in asked]
        room = max(64, min(SHARD_DOCS, CELLS // max(1, n_terms)))

        def join(pieces: list) -> None:
            whole = pa.Table.from_batches(pieces).combine_chunks()
            n = whole["n"].to_numpy()
            ids = whole["doc_id"].combine_chunks()
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            names = ids.fill_null(0).to_numpy()
            lists = whole["terms"].combine_chunks()
            rows = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            shard = Shard(
                n, lists.flatten().to_numpy(), whole["counts"].combine_chunks().flatten().to_numpy(),
                rows, n_terms, documents, total,
            )
            for at, (wanted, weights) in enumerate(asked):
                scores, held, null = tops[at]
                rows, more, _ = shard.search(wanted, weights, k, scores)
                if not len(rows):
                    continue
                scores = np.concatenate([scores, more])
                held, null = np.concatenate([held, names[rows]]), np.concatenate([null, absent[rows]])
                order = np.lexsort((held, null, -scores))[:k]
                tops[at] = scores[order], held[order], null[order]

        waiting, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, room - count)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                count += part.num_rows
                if count == room:
                    join(waiting)
                    waiting, count = [], 0
        if waiting:
            join(waiting)
        for at, (scores, held, null) in enumerate(tops):
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(scores), at, "i4")), pa.array(held, mask=null),
                    pa.array(scores),
                ], names=["_item", "doc_id", "score"])

    return search


def search_block(docs: DataFrame, block: dict[int | None, Counter], k: int) -> DataFrame:
    """The k best documents for each item of one block: item_id, rank, doc_id, score."""
    import numpy as np

    spark = docs.sparkSession
    wanted = {term: i for i, term in enumerate(sorted(set().union(*block.values())))}
    counted = stored(count_terms(docs, wanted), "term-counts")
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    shape = "item_id long, rank int, doc_id long, score long"
    if not sums["documents"]:
        return spark.createDataFrame([], shape)
    # one row per term of the block
    holders = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    frequency = np.zeros(len(wanted), "i8")
    for row in holders:
        frequency[row["term"]] = row["count"]
    weight = np.array([
        math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * int(df) + 1))) for df in frequency
    ], "i8")
    asked, names = [], []
    for name, counts in block.items():
        ids = np.array([wanted[term] for term in counts], "i8")
        weights = weight[ids] * np.fromiter(counts.values(), "i8", len(ids))
        asked.append((ids[weights > 0], weights[weights > 0]))
        names.append((len(names), name))
    task = _search_task(asked, len(wanted), sums["documents"], sums["total"], k)
    found = counted.mapInArrow(task, "_item int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("_item", "_salt").orderBy(*order)
    whole = Window.partitionBy("_item").orderBy(*order)
    best = (
        found.withColumn("_salt", F.spark_partition_id() % _SALTS)
        .withColumn("_rank", F.row_number().over(salted)).where(F.col("_rank") <= k)
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    )
    # broadcast is bounded by BLOCK_ITEMS
    labels = F.broadcast(spark.createDataFrame(names, "_item int, item_id long"))
    return best.join(labels, "_item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents of ``docs`` (doc_id, text) that score highest for each row of ``items``.

    Columns: item_id, rank (from 1), doc_id, score. Only scores above 0 are listed. Equal scores go
    by ascending doc_id, NULL last; rows that repeat a doc_id are documents of their own. NULL and
    empty texts have no terms. Rows that repeat an item_id are one item, and so are those without
    one. Empty tables give no rows; other columns are ignored.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    results = [stored(search_block(docs, block, k), "ranked") for block in blocks(items)]
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


SEARCH_SQL = r"""
with docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents where text is not null
), sizes as (
  select row, doc_id, len(words) as n, words from docs where len(words) > 0
), corpus as (
  select count(*) as docs, sum(n)::bigint as total from sizes
), postings as (
  select row, word, count(*) as tf from (select row, unnest(words) as word from sizes) group by row, word
), frequencies as (
  select word, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w
  from postings, corpus group by word, docs
), asked as (
  select item_id, word, count(*) as times from (
    select item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word
    from benchmark) group by item_id, word
), scores as (
  select item_id, row, sum(times * w * ((1000000000 * tf)
      // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))))::bigint as score
  from asked join frequencies using (word) join postings using (word) join sizes using (row), corpus
  group by item_id, row
), ranked as (
  select item_id, doc_id, score,
    row_number() over (partition by item_id order by score desc, doc_id) as rank
  from scores join sizes using (row) where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""
