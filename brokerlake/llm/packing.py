"""Pack documents into few sequences of a fixed number of tokens.

``tokenized_pieces`` encodes whole texts and cuts only those longer than a sequence. ``pack``
works on lengths alone: pieces are dealt at random into groups of some ten thousand, and each group
starts from best fit and is improved by local search. The search takes the emptiest underfull
sequence and tries to hand on its pieces by a move, by exchanging one for one, or two for one with
another underfull sequence; each step raises the sum of squared fills, and a sequence that runs
empty is gone. It ends when the group needs no more sequences than ceil(tokens / capacity), or when
``PATIENCE`` sequences in a row could not be emptied.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored

CAPACITY = 4096
#: Pieces packed together by one task; a few MB of numbers.
GROUP_PIECES = 50_000
#: Sequences in a row that the search fails to empty before it ends.
PATIENCE = 12

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, spaces: bool = False,
                     capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text), without their ids.

    A NULL or empty text is one piece that holds ``end_id`` alone; NULL or repeated doc_ids are
    kept as they are. Other columns are ignored.
    """
    prepare(docs.sparkSession)

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from brokerlake.llm.tokens import encoder

        encode = encoder(tokenizer, spaces)
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, encode.encode(batch.column("text"))):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((name, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, _PIECES)


class Bins:
    """Bins of one group that can be searched by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # of each bin: (length, piece)
        self.room: list[int] = []
        self.open: list[tuple[int, int]] = []  # (room, bin), sorted; only bins with room

    def _set_room(self, at: int, room: int) -> None:
        if self.room[at] > 0:
            del self.open[bisect_left(self.open, (self.room[at], at))]
        self.room[at] = room
        if 0 < room < self.capacity:
            insort(self.open, (room, at))

    def put(self, at: int, item: tuple[int, int]) -> None:
        self.items[at].append(item)
        self._set_room(at, self.room[at] - item[0])

    def take(self, at: int, item: tuple[int, int]) -> None:
        self.items[at].remove(item)
        room = self.room[at] + item[0]
        if room == self.capacity:  # emptied: out of the game
            del self.open[bisect_left(self.open, (self.room[at], at))]
            self.room[at] = 0
        else:
            self._set_room(at, room)

    def best_fit(self, item: tuple[int, int]) -> None:
        where = bisect_left(self.open, (item[0], -1))
        if where < len(self.open):
            self.put(self.open[where][1], item)
        else:
            self.items.append([item])
            self.room.append(0)
            self._set_room(len(self.items) - 1, self.capacity - item[0])

    def _hand_on(self, source: int) -> bool:
        """One step that empties ``source`` further, or False."""
        mine = sorted(self.items[source], reverse=True)
        for item in mine:  # move: the fullest bin that still has room
            where = bisect_left(self.open, (item[0], -1))
            while where < len(self.open) and self.open[where][1] == source:
                where += 1
            if where < len(self.open):
                target = self.open[where][1]
                self.take(source, item)
                self.put(target, item)
                return True
        pairs = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :]]
        for room, target in self.open:
            if target == source or self.room[target] > self.room[source]:
                continue
            theirs = sorted(self.items[target])
            sizes = [size for size, _ in theirs]
            for item in mine:  # one for one: a smaller piece comes back
                where = bisect_left(sizes, item[0] - room)
                if where < len(sizes) and sizes[where] < item[0]:
                    self._swap(source, target, [item], [theirs[where]])
                    return True
            for a, b in pairs:  # two of mine for one of theirs
                where = bisect_left(sizes, a[0] + b[0] - room)
                if where < len(sizes) and sizes[where] < a[0] + b[0]:
                    self._swap(source, target, [a, b], [theirs[where]])
                    return True
            for item in mine:  # one of mine for two of theirs
                for i, a in enumerate(theirs):
                    where = bisect_left(sizes, item[0] - room - a[0], i + 1)
                    if where < len(sizes) and sizes[where] + a[0] < item[0]:
                        self._swap(source, target, [item], [a, theirs[where]])
                        return True
        return False

    def _swap(self, source: int, target: int, out: list, back: list) -> None:
        self.items[source] = [x for x in self.items[source] if x not in out] + back
        self.items[target] = [x for x in self.items[target] if x not in back] + out
        change = sum(x[0] for x in out) - sum(x[0] for x in back)
        self._set_room(source, self.room[source] + change)
        self._set_room(target, self.room[target] - change)

    def improve(self, patience: int) -> None:
        """Empty bins, the emptiest first, until none needs to be or ``patience`` in a row stay."""
        used = sum(1 for items in self.items if items)
        total = sum(size for items in self.items for size, _ in items)
        fewest = -(-total // self.capacity)
        stuck: set[int] = set()
        while used > fewest and len(stuck) < patience:
            source = next((at for _, at in reversed(self.open) if at not in stuck), None)
            if source is None:
                return
            while self.items[source] and self._hand_on(source):
                pass
            if self.items[source]:
                stuck.add(source)
            else:
                used -= 1
                stuck.clear()


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each length; lengths are from 1 to ``capacity``."""
    bins = Bins(capacity)
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins.best_fit((lengths[at], at))
    bins.improve(PATIENCE)
    where, offsets = [0] * len(lengths), [0] * len(lengths)
    for number, items in enumerate(bins.items):
        offset = 0
        for size, at in items:
            where[at], offsets[at] = number, offset
            offset += size
    return where, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = prepare(pieces.sparkSession)
    fixed = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-fixed.count() // group_pieces))

    def place(frame):
        import pandas as pd

        frame = frame.sort_values(["length", "_row"], ascending=[False, True])
        where, offsets = pack_lengths(frame["length"].tolist(), capacity)
        group = int(frame["_group"].iloc[0])
        numbers = pd.Series(where, index=frame.index, dtype="int64") + (group << 32)
        return frame.drop(columns=["_row", "_group"]).assign(sequence_id=numbers, offset=offsets)

    dealt = fixed.withColumn(
        "_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")
    )
    return dealt.groupBy("_group").applyInPandas(place, _PACKED)
