"""Whole records of splittable text files whose record borders depend on everything before them.

A line break ends a CSV record only outside of quotes, and a comma ends an element of a JSON array only
at the array's own depth. Spark splits both kinds of file at a separator all the same (lines, or
closing braces), and three steps make records of the pieces:

1. Every range of a file is summarised by what it does to the state: where reading ends if it begins
   outside or inside of quotes, and by how much the depth changes in either case. One row a range.
2. A prefix composition of those rows gives each range its true state. It is a running count of flips
   since the last range that ends in the same state either way, and a running sum of depths.
3. With that state a range cuts its own records. The first and last of a range may reach into its
   neighbours; these parts, at most two a range, are joined by the range in which the record begins.

So a file of any size is read by many tasks, each range on its own, and the records and their places
do not depend on where the file was split. No task holds more than a batch and one record.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brokerlake.scale import stored

_PARTS = "file string, block bigint, seq bigint, part string, text string"


class Lines:
    """One record a line; empty lines are none."""

    separator = "\n"

    def walk(self, text: str, inside: bool) -> tuple[bool, int]:
        return False, 0

    def reader(self, inside: bool, depth: int) -> _LineReader:
        return _LineReader(self, inside)

    def cut(self, text: str, inside: bool) -> tuple[list[str], bool]:
        """The records of whole lines, and whether the last one goes on behind them."""
        return text.split("\n"), False

    def text(self, record: Column) -> Column:
        """A record that ends in a carriage return has them before all its line breaks."""
        bare = F.replace(F.rtrim(record, F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
        return F.when(F.endswith(record, F.lit("\r")), bare).otherwise(record)


class Csv(Lines):
    """Fields may be quoted, a quote inside of quotes is doubled; one elsewhere is text."""

    _QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
    _OPENED = re.compile(rf'[,\n]{_QUOTED}("|\Z)')
    _FIELD = rf'(?:{_QUOTED}(?:"|\Z))?+[^,\n]*+'
    _RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+(?:\n|\Z)")

    def walk(self, text: str, inside: bool) -> tuple[bool, int]:
        """Whether the reader is inside of quotes behind the lines."""
        last = deque(self._OPENED.finditer(('\n"' if inside else "\n") + text), maxlen=1)
        return bool(last) and not last[0][1], 0

    def cut(self, text: str, inside: bool) -> tuple[list[str], bool]:
        found = self._RECORD.findall(('"' if inside else "") + text + "\n")
        found.pop()  # the empty match at the end
        open_at_end = self.walk(found[-1], False)[0]
        found = [record[:-1] for record in found]
        if inside:
            found[0] = found[0][1:]
        return found, open_at_end


class _LineReader:
    """Puts lines together; ``rest`` is the record that is not finished, if any."""

    def __init__(self, grammar: Lines, inside: bool):
        self.grammar, self.inside = grammar, inside
        self.rest: list[str] | None = [] if inside else None
        self.problems: list[str] = []

    def feed(self, text: str, first: bool) -> Iterator[str]:
        was = self.inside
        found, self.inside = self.grammar.cut(text, was)
        last = found.pop() if self.inside else None
        if was and found:
            yield "".join([*self.rest, "\n", found[0]])
            self.rest = None
        yield from [record for record in found[was:] if record.strip("\r")]
        if self.inside:
            self.rest = [*self.rest, "\n", last] if self.rest is not None else [last]


class JsonArray:
    """The elements of one array a file, cut at the commas of its own depth."""

    separator = "}"
    _CLOSE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
    _STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
    _TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\],]', re.S)

    def walk(self, piece: str, inside: bool) -> tuple[bool, int]:
        """Whether the reader is inside of a string behind the pieces, and the change of depth."""
        if inside:
            end = self._CLOSE.match(piece)
            if end is None:
                return True, 0
            piece = piece[end.end():]
        bare = self._STRING.sub("", piece)
        open_at = bare.find('"')
        if open_at >= 0:
            bare = bare[:open_at]
        depth = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
        return open_at >= 0, depth

    def reader(self, inside: bool, depth: int) -> _ArrayReader:
        return _ArrayReader(self, inside, depth)

    def text(self, record: Column) -> Column:
        return F.trim(record, F.lit(" \t\r\n"))


class _ArrayReader:
    def __init__(self, grammar: JsonArray, inside: bool, depth: int):
        self.grammar, self.inside, self.depth = grammar, inside, depth
        self.rest: list[str] | None = [] if depth > 0 else None
        self.problems: list[str] = []

    def feed(self, piece: str, first: bool) -> Iterator[str]:
        piece = piece if first else "}" + piece
        at = done = 0
        if self.inside:
            end = self.grammar._CLOSE.match(piece)
            if end is None:
                self.rest = [*(self.rest or []), piece] if self.depth else self._outside(piece)
                return
            at, self.inside = end.end(), False
        for token in self.grammar._TOKEN.finditer(piece, at):
            mark = token.group()
            if mark == '"':
                self.inside = True
                break
            if mark in "{[":
                self.depth += 1
                if self.depth == 1:
                    self._outside(piece[done : token.start()])
                    self.problems.append("begin" if mark == "[" else "junk")
                    done, self.rest = token.end(), []
            elif mark in "}]":
                self.depth -= 1
                if self.depth == 0:
                    yield "".join([*self.rest, piece[done : token.start()]])
                    self.problems.append("end" if mark == "]" else "junk")
                    done, self.rest = token.end(), None
                elif self.depth < 0:
                    self.problems.append("junk")
                    done, self.depth = token.end(), 0
            elif mark == "," and self.depth == 1:
                yield "".join([*self.rest, piece[done : token.start()]])
                done, self.rest = token.end(), []
        if self.depth:
            self.rest.append(piece[done:])
        else:
            self._outside(piece[done:])

    def _outside(self, text: str) -> None:
        if text.strip(" \t\r\n"):
            self.problems.append("junk")


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("piece"), F.octet_length("value").alias("bytes"),
        F.col("_metadata.file_size").alias("file_bytes"),
    )


def _runs(batch) -> Iterator:
    """((file, block), rows) for each stretch of a batch that belongs to one range."""
    import numpy as np
    import pyarrow.compute as pc

    count, file, block = batch.num_rows, batch.column("file"), batch.column("block")
    if count == 0:
        return
    other = pc.or_(
        pc.not_equal(file.slice(1), file.slice(0, count - 1)),
        pc.not_equal(block.slice(1), block.slice(0, count - 1)),
    )
    starts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), count]
    for start, end in zip(starts, starts[1:]):
        yield (file[start].as_py(), block[start].as_py()), batch.slice(start, end - start)


def _blocks(pieces: DataFrame, grammar) -> DataFrame:
    """(file, block, inside, depth): the state in which each range begins; ``bytes`` are what its
    pieces hold with a separator behind each, of ``file_bytes`` in the file."""

    def summarise(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(key, ends, size, file_size):
            (in_0, d_0), (in_1, d_1) = ends
            return pa.RecordBatch.from_pydict({
                "file": [key[0]], "block": pa.array([key[1]], pa.int64()),
                "out_end": pa.array([int(in_0)], pa.int32()), "in_end": pa.array([int(in_1)], pa.int32()),
                "out_depth": pa.array([d_0], pa.int64()), "in_depth": pa.array([d_1], pa.int64()),
                "bytes": pa.array([size], pa.int64()), "file_bytes": pa.array([file_size], pa.int64()),
            })

        current, ends, size, walk = None, [], 0, grammar.walk
        lead = "}" if grammar.separator == "}" else ""
        for key, rows in (run for batch in batches for run in _runs(batch)):
            pieces, first = rows.column("piece").to_pylist(), key != current
            if first:
                if current is not None:
                    yield row(current, ends, size, file_size)
                current, ends, size = key, [(False, 0), (True, 0)], 0
                file_size = rows.column("file_bytes")[0].as_py()
            text = grammar.separator.join(pieces)
            text = text if first and key[1] == 0 else lead + text
            size += sum(rows.column("bytes").to_pylist()) + len(pieces)
            after = {inside: walk(text, inside) for inside in {inside for inside, _ in ends}}
            ends = [(after[inside][0], depth + after[inside][1]) for inside, depth in ends]
        if current is not None:
            yield row(current, ends, size, file_size)

    found = stored(pieces.mapInArrow(
        summarise, "file string, block bigint, out_end int, in_end int, out_depth bigint,"
        " in_depth bigint, bytes bigint, file_bytes bigint"
    ), "blocks")
    # one row a range of a file, so these windows hold no data
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum(F.when((F.col("out_end") == 1) & (F.col("in_end") == 0), 1).otherwise(0))
    fixed = F.when(F.col("out_end") == F.col("in_end"), F.struct("out_end", "flips"))
    state = (
        found.withColumn("flips", flips.over(upto))
        .withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
        .withColumn("flipped", F.coalesce(F.lag("flips").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
        .withColumn("inside", F.pmod(
            F.coalesce("fixed.out_end", F.lit(0)) + F.col("flipped") - F.coalesce("fixed.flips", F.lit(0)),
            F.lit(2),
        ).cast("int"))
    )
    change = F.when(F.col("inside") == 1, F.col("in_depth")).otherwise(F.col("out_depth"))
    return state.withColumn("change", change).select(
        "file", "block", "inside", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
        "bytes", "file_bytes",
    )


def _parts(pieces: DataFrame, blocks: DataFrame, grammar) -> DataFrame:
    """Records and parts of records: file, block, seq (place among those begun in the range)."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, reader, seq, continued = None, None, 0, False

        def parts(seqs: list[int], marks: list[str], texts: list) -> pa.RecordBatch:
            file, block = current
            return pa.RecordBatch.from_pydict({
                "file": pa.array([file] * len(seqs), pa.string()),
                "block": pa.array([block] * len(seqs), pa.int64()), "seq": pa.array(seqs, pa.int64()),
                "part": pa.array(marks, pa.string()), "text": pa.array(texts, pa.string()),
            })

        def finish() -> pa.RecordBatch:
            """What is left of a range: the beginning of a record, or all of one's middle."""
            noted = len(reader.problems)
            seqs, marks, texts = [-1] * noted, list(reader.problems), [None] * noted
            if reader.rest is not None:
                seqs.append(-1 if continued else seq)
                marks.append("middle" if continued else "begun")
                texts.append("".join(reader.rest))
            return parts(seqs, marks, texts)

        for key, rows in (run for batch in batches for run in _runs(batch)):
            first = False
            if key != current:
                if current is not None:
                    yield finish()
                inside, depth = rows.column("inside")[0].as_py(), rows.column("depth")[0].as_py()
                current, reader, seq = key, grammar.reader(inside == 1, depth), 0
                continued, first = reader.rest is not None, key[1] == 0
            texts = list(reader.feed(grammar.separator.join(rows.column("piece").to_pylist()), first))
            ended = 1 if continued and texts else 0
            continued = continued and not ended
            whole = len(texts) - ended
            yield parts([-1] * ended + list(range(seq, seq + whole)), ["ended"] * ended + ["whole"] * whole, texts)
            seq += whole
        if current is not None:
            yield finish()

    # one row a range: a broadcast keeps the pieces in order
    states = F.broadcast(blocks.select("file", "block", "inside", "depth"))
    return stored(pieces.join(states, ["file", "block"], "left").mapInArrow(cut, _PARTS), "parts")


def read_records(spark: SparkSession, path: str, grammar) -> tuple[DataFrame, DataFrame]:
    """(records, marks) of the files below ``path``: file, ordinal (from 0 within its file), text.

    ``marks`` counts for each file what the grammar notes: begin and end of arrays, and junk outside;
    ``closed`` tells whether the file ends with a separator, which the pieces don't show. Files without
    any piece, such as empty ones, are in neither.
    """
    pieces = _pieces(spark, path, grammar.separator)
    blocks = stored(_blocks(pieces, grammar), "states")
    parts = _parts(pieces, blocks, grammar)
    shared = parts.where("part IN ('begun', 'middle', 'ended')")
    # a part belongs to the record begun in the last range before its own
    order = Window.partitionBy("file").orderBy("block", F.col("part") == "begun")
    keyed = shared.select("file", "block", "seq", "part").withColumn("_from", F.last(
        F.when(F.col("part") == "begun", F.struct("block", "seq")), ignorenulls=True).over(order))
    glued = (
        keyed.select("file", "block", "part", "_from")
        .join(shared.select("file", "block", "part", "text"), ["file", "block", "part"])
        .groupBy("file", F.col("_from.block").alias("block"), F.col("_from.seq").alias("seq"))
        .agg(F.collect_list(F.struct(F.col("block").alias("at"), "text")).alias("_parts"))
        .select("file", "block", "seq", F.array_join(F.sort_array("_parts").getField("text"), "").alias("text"))
    )
    begun = parts.where("part IN ('whole', 'begun')").groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begun.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    whole = parts.where("part = 'whole'").select("file", "block", "seq", "text")
    records = whole.unionByName(glued).join(F.broadcast(offsets), ["file", "block"]).select(
        "file", (F.col("_offset") + F.col("seq")).alias("ordinal"), grammar.text(F.col("text")).alias("text")
    )
    closed = blocks.groupBy("file").agg((F.sum("bytes") == F.max("file_bytes")).alias("closed"))
    noted = parts.groupBy("file").agg(*[
        F.count_if(F.col("part") == mark).alias(mark) for mark in ("begin", "end", "junk")
    ])
    return records, closed.join(noted, "file", "left").fillna(0, ["begin", "end", "junk"])
