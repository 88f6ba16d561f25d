"""Alignment of two tokenizers' tokens over the bytes of the same texts.

A task encodes texts with both tokenizers and lays their tokens out by byte position; each text has
a range of positions of its own, which keys the match by text. ``merge_asof`` finds for each token's
start the covering token of the other side; the union of both directions holds every overlapping pair
once, and overlaps whose tokens end together are the links, which close the groups.

Where no token of either side reaches over the space before a word, both sides end together at every
word's end, so the alignment of a document is that of its words in a row. A task aligns the words of a
batch that it has not met before, and a document whose white space may join words as one.

What leaves the task is one row per document: its figures, and its distinct linked id pairs with
their numbers. Pair counts over the corpus are an aggregate of those. Of two tokens that end at the
same byte of one text the shorter is a suffix of the longer, so the vocabularies alone bound the
number of pairs (``pair_bound``); that table goes to all tasks, which then look their pairs up.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored, texts
from brokerlake.llm.tokens import Words

#: Characters of the documents that are aligned at once (a longer one alone), and words and links remembered.
_CHARS, _KEEP, _KEEP_LINKS = 1_000_000, 500_000, 5_000_000
#: words that A reads at once as one text, as no space or letter of them may be read otherwise there
_PLAIN, _JOINED = r"^\n?[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:-@\[-`{-~]*$", 1_000
_RUN = re.compile(r"\s\s")
_SPACE = "▁"
_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """Both tokenizers of this worker process."""
    if (a_path, b_path) not in _SIDES:
        _SIDES[a_path, b_path] = Sides(a_path, b_path)
    return _SIDES[a_path, b_path]


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or 256 and up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


class Sides:
    """Tokenizer A (a byte-level ``tokenizers`` file) and B (a ``sentencepiece`` model)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            plain = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if plain else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # words may be encoded one by one if no piece reaches over the space before a word or over a line end
        self.by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}|\n", piece) for piece in pieces)
        self._forget()
        #: an id in digits with the mark behind it: within a side, after A's part, after a group, at the end
        self.top = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = np.array([f"{i}{mark}" for mark in (",", "|", ";", "\n") for i in range(self.top)], "S")

    def _forget(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        #: by place: tokens of A and B and whether the bytes do not come back; pair codes; groups
        self.figures = np.zeros((3, 0), "i8")
        self.links = Words("i8")
        self.groups: list[bytes] = []

    def _ids_a(self, said: list[str]) -> list[list[int]]:
        return [one.ids for one in self.a.encode_batch_fast(said, add_special_tokens=False)]

    def encode(self, docs: list[str]) -> list[tuple | None]:
        """Id arrays of both sides for each text, or None where its bytes do not come back."""
        import numpy as np

        found: list[tuple | None] = []
        both = zip(docs, self._ids_a([" " + text for text in docs]), self.b.encode(docs, num_threads=1))
        for text, a, b in both:
            raw = (" " + text).encode()
            same = raw == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b])
            found.append((np.array(a, "i8"), np.array(b, "i8")) if same else None)
        return found

    def align(self, docs: list[str]) -> tuple:
        """Tokens of A, tokens of B and links of each text, its groups or None where its bytes do not
        come back, and (document, pair code, number) of all distinct linked id pairs, by document."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > _KEEP or len(self.links) > _KEEP_LINKS:
            self._forget()
        split = np.array([self.by_word and not _RUN.search(" " + text) for text in docs], bool)
        lines = pa.array([text for text, one in zip(docs, split) if one], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
        distinct = cut.flatten().dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False)  # far faster than to_pylist
        places = np.fromiter(map(self.known.get, words, repeat(-1)), "i8", len(words))
        new = np.flatnonzero(places < 0)
        if len(new):
            plain = pc.match_substring_regex(distinct.dictionary.take(pa.array(new)), _PLAIN)
            plain = plain.to_numpy(zero_copy_only=False)
            new = np.concatenate([new[plain], new[~plain]])
            told = words[new].tolist()
            places[new] = self._learn(told, int(plain.sum())) + np.arange(len(new))
            self.known.update(zip(told, places[new].tolist()))
        counts = np.ones(len(docs), "i8")
        counts[split] = cut.value_lengths().to_numpy()
        at = np.empty(int(counts.sum()), "i8")
        of_words = np.repeat(split, counts)
        at[of_words] = places[distinct.indices.to_numpy()]
        if not split.all():
            whole = [text for text, one in zip(docs, split) if not one]
            said = [" " + text for text in whole]
            at[~of_words] = self._add(
                said, *_flat(self._ids_a(said)), *_flat(self.b.encode(whole, num_threads=1))
            ) + np.arange(len(whole))
        ends = np.concatenate([[0], np.cumsum(counts)])
        n_a, n_b, bad = np.diff(np.concatenate(
            [np.zeros((3, 1), "i8"), np.cumsum(self.figures[:, at], axis=1)], axis=1
        )[:, ends])
        like = bad == 0
        codes, sizes = self.links.take(at)
        n_links = np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])
        owner = np.repeat(np.arange(len(docs)), n_links)
        if not like.all():
            codes, owner = codes[like[owner]], owner[like[owner]]
        span = int(codes.max(initial=0)) + 1
        pairs, times = np.unique(owner * span + codes, return_counts=True)
        shown = list(map(self.groups.__getitem__, at.tolist()))
        groups = [
            b";".join(shown[lo:hi]) if one else None
            for lo, hi, one in zip(ends[:-1].tolist(), ends[1:].tolist(), like.tolist())
        ]
        return n_a * like, n_b * like, n_links * like, groups, (pairs // span, pairs % span, times)

    def _learn(self, words: list[str], plain: int) -> int:
        """Align words, ``plain`` ones first: one stands for a space and itself, or begins with its line
        end. Gives the place of the first."""
        import numpy as np

        spoken = [word if word[:1] == "\n" else " " + word for word in words]
        b = self.b.encode(words, num_threads=1)
        for at, word in enumerate(words):
            if not word:
                b[at] = [self.b.piece_to_id(_SPACE)]
            elif word[0] == "\n":  # without the space that the model puts in front
                del b[at][0]
        joined = ["".join(spoken[i : min(i + _JOINED, plain)]) for i in range(0, plain, _JOINED)]
        ids, _ = _flat(self._ids_a(joined))
        reach = np.cumsum(self.a_sizes[ids])
        wanted = np.cumsum(np.fromiter((len(one.encode()) for one in spoken[:plain]), "i8", plain))
        ends = np.searchsorted(reach, wanted) + 1
        if plain and (reach[-1] != wanted[-1] or (reach[ends - 1] != wanted).any()):
            ids, ends = _flat(self._ids_a(spoken[:plain]))
        others, other_ends = _flat(self._ids_a(spoken[plain:]))
        return self._add(
            spoken, np.concatenate([ids, others]), np.concatenate([ends, len(ids) + other_ends]), *_flat(b)
        )

    def _add(self, said: list[str], a, a_ends, b, b_ends) -> int:
        """Align some texts, given the ids of both sides in a row and where each text's end; the place
        of the first."""
        import numpy as np

        first = len(self.groups)
        raw = [one.encode() for one in said]
        raw_ends = np.cumsum(np.fromiter(map(len, raw), "i8", len(raw)))
        like = np.ones(len(raw), bool)
        for ids, ends, told, sizes in (
            (a, a_ends, self.a_bytes, self.a_sizes), (b, b_ends, self.b_bytes, self.b_sizes)
        ):
            reach = np.concatenate([[0], np.cumsum(sizes[ids])])[ends]
            parts = list(map(told.__getitem__, ids.tolist()))
            if not np.array_equal(reach, raw_ends) or b"".join(parts) != b"".join(raw):
                froms = [0, *ends.tolist()]
                like &= [b"".join(parts[lo:hi]) == own for lo, hi, own in zip(froms, froms[1:], raw)]
        n_a, n_b = (np.diff(ends, prepend=0) for ends in (a_ends, b_ends))
        if not like.all():
            a, b = a[np.repeat(like, n_a)], b[np.repeat(like, n_b)]
            n_a, n_b = n_a * like, n_b * like
        groups: list[bytes] = [b""] * len(raw)
        sizes = np.zeros(len(raw), "i8")
        codes = np.zeros(0, "i8")
        if like.any():
            found = Aligned(self, a, n_a[like], b, n_b[like])
            codes = found.linked(len(self.b_bytes))
            sizes[like] = np.diff(np.searchsorted(found.a_last, found.a_from))
            for at, shown in zip(np.flatnonzero(like).tolist(), found.groups(self)):
                groups[at] = shown
        self.links.add(codes, np.cumsum(sizes))
        self.figures = np.concatenate([self.figures, [n_a, n_b, ~like]], axis=1)
        self.groups += groups
        return first


def _flat(ids: list[list[int]]):
    """Lists of ids in a row, and where each ends."""
    import numpy as np

    ends = np.cumsum(np.fromiter(map(len, ids), "i8", len(ids)))
    return np.fromiter(chain.from_iterable(ids), "i8", int(ends[-1]) if len(ids) else 0), ends


class Aligned:
    """The tokens, overlaps and links of some texts, of which none is without tokens.

    Given are the ids of each side in a row and how many each text has.
    """

    def __init__(self, both: Sides, a_ids, a_counts, b_ids, b_counts):
        import numpy as np
        import pandas as pd

        def side(ids, counts, sizes):
            ends = np.cumsum(sizes[ids])
            frame = pd.DataFrame({"start": ends - sizes[ids], "token": np.arange(len(ids)), "end": ends})
            return ids, np.concatenate([[0], np.cumsum(counts)]), frame

        # both sides of a text have equally many bytes, so it has one range of positions in both
        self.a_ids, self.a_from, a = side(a_ids, a_counts, both.a_sizes)
        self.b_ids, self.b_from, b = side(b_ids, b_counts, both.b_sizes)
        a_starts = pd.merge_asof(a, b, on="start", suffixes=("_a", "_b"))
        b_starts = pd.merge_asof(b, a, on="start", suffixes=("_b", "_a"))
        # equal starts are found in both directions
        both_ways = b_starts["start"].to_numpy() == a["start"].to_numpy()[b_starts["token_a"].to_numpy()]
        columns = ["start", "token_a", "token_b", "end_a", "end_b"]
        self.overlaps = pd.concat([a_starts[columns], b_starts.loc[~both_ways, columns]], ignore_index=True)
        links = self.overlaps.loc[self.overlaps["end_a"].to_numpy() == self.overlaps["end_b"].to_numpy()]
        self.a_last = np.sort(links["token_a"].to_numpy())
        self.b_last = np.sort(links["token_b"].to_numpy())

    def groups(self, both: Sides) -> list[bytes]:
        """Each text's groups as decimal ids: ``a1,a2|b1;a3|b2,b3``."""
        import numpy as np

        a, b = np.arange(len(self.a_ids)), np.arange(len(self.b_ids))
        a_mark, b_mark = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
        a_mark[self.a_last], b_mark[self.b_last] = 1, 2
        a_group = np.cumsum(a_mark) - a_mark  # groups closed before
        b_group = (np.cumsum(b_mark) - b_mark) // 2
        b_mark[self.b_from[1:] - 1] = 3
        before = np.concatenate([[0], self.b_last + 1])
        shown = np.empty(len(a) + len(b), "i8")
        shown[a + before[a_group]] = self.a_ids + both.top * a_mark
        shown[b + self.a_last[b_group] + 1] = self.b_ids + both.top * b_mark
        return both.shown[shown].tobytes().translate(None, b"\0").split(b"\n")[:-1]

    def linked(self, n_b: int):
        """The pair codes of all links, in order of text."""
        return self.a_ids[self.a_last] * n_b + self.b_ids[self.b_last]


def _portions(docs: list[str]) -> Iterator[list[int]]:
    """Places of the non-empty texts, a bounded number of characters at a time."""
    part, size = [], 0
    for at, text in enumerate(docs):
        if not text:
            continue
        if part and size + len(text) > _CHARS:
            yield part
            part, size = [], 0
        part.append(at)
        size += len(text)
    if part:
        yield part


def pair_bound(a_path: str, b_path: str) -> int:
    """How many id pairs can be linked at all: those of which one token's bytes end the other's."""
    from collections import Counter

    both = sides(a_path, b_path)
    a, b = Counter(both.a_bytes), Counter(both.b_bytes)

    def ends(longer: Counter, shorter: Counter, least: int) -> int:
        return sum(
            n * shorter[x[i:]] for x, n in longer.items() for i in range(least, len(x)) if x[i:] in shorter
        )

    return ends(a, b, 0) + ends(b, a, 1)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its figures and its linked id pairs.

    Columns: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and ``pairs`` (a id times the size of
    B plus b id) with ``times``. NULL and empty texts, and those whose bytes either tokenizer does not
    give back, have no tokens: zeros, no hash and no pairs. Rows stand for themselves, repeated or
    without id; other columns are ignored.
    """
    n_a, n_b = (len(x) for x in (sides(a_path, b_path).a_bytes, sides(a_path, b_path).b_bytes))
    code = "int" if n_a * n_b < 1 << 31 else "long"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        both = sides(a_path, b_path)
        kind = pa.int32() if code == "int" else pa.int64()
        for batch in batches:
            said = texts(batch.column("text"))
            figures = np.zeros((4, len(said)), "i8")
            hashes = [""] * len(said)
            sizes = np.zeros(len(said), "i8")
            codes, times = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for part in _portions(said):
                places = np.array(part, "i8")
                n_as, n_bs, links, groups, (owner, pairs, number) = both.align([said[at] for at in part])
                figures[:, places] = n_as, n_bs, links, links
                for at, shown in zip(part, groups):
                    if shown is not None:
                        hashes[at] = hashlib.sha256(shown).hexdigest()
                sizes[places] = np.bincount(owner, minlength=len(places))
                codes.append(pairs)
                times.append(number)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *map(pa.array, figures), pa.array(hashes, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(codes), kind)),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int32())),
            ], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        f" pairs array<{code}>, times array<int>",
    )


def overlaps(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every overlapping pair of tokens, one row each, in the texts that ``align`` gives tokens.

    Columns: doc_id, a, b (places of the tokens in their document), a_id, b_id, start, end (the
    shared bytes of space and text, end exclusive) and linked (whether both tokens end there).
    """
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        both = sides(a_path, b_path)
        for batch in batches:
            said = texts(batch.column("text"))
            for part in _portions(said):
                encoded = both.encode([said[at] for at in part])
                places = np.array([at for at, one in zip(part, encoded) if one is not None], "i8")
                if not len(places):
                    continue
                (a, n_a), (b, n_b) = (
                    (np.concatenate(ids), [len(one) for one in ids])
                    for ids in zip(*(one for one in encoded if one is not None))
                )
                found = Aligned(both, a, n_a, b, n_b)
                pairs = found.overlaps
                a, b = pairs["token_a"].to_numpy(), pairs["token_b"].to_numpy()
                owner = np.searchsorted(found.a_from, a, "right") - 1
                base = np.concatenate([[0], np.cumsum(both.a_sizes[found.a_ids])])[found.a_from[owner]]
                end_a, end_b = pairs["end_a"].to_numpy(), pairs["end_b"].to_numpy()
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(places[owner])),
                    pa.array(a - found.a_from[owner]), pa.array(b - found.b_from[owner]),
                    pa.array(found.a_ids[a]), pa.array(found.b_ids[b]),
                    pa.array(pairs["start"].to_numpy() - base), pa.array(np.minimum(end_a, end_b) - base),
                    pa.array(end_a == end_b),
                ], names=["doc_id", "a", "b", "a_id", "b_id", "start", "end", "linked"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, a long, b long, a_id long, b_id long, start long, end long, linked boolean"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many links of the corpus hold each id pair: pair, count. At most ``pair_bound`` rows."""
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    return rows.groupBy(F.col("link.pairs").cast("long").alias("pair")).agg(
        F.sum("link.times").alias("count")
    )


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``align`` with corpus-wide counts: n_best (links whose count is the highest of their B id, ties
    included) and count_sum (the counts of all links) in place of the pairs. An empty table gives none.
    """
    aligned = stored(align(docs, a_path, b_path), "aligned")
    n_b = len(sides(a_path, b_path).b_bytes)
    # no more rows than pair_bound, whatever the corpus
    table = pair_counts(aligned).toArrow().sort_by("pair")
    pairs, counts = (table[name].to_numpy() for name in ("pair", "count"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        highest = np.zeros(n_b, "i8")
        np.maximum.at(highest, pairs % n_b, counts)
        best = counts == highest[pairs % n_b]
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        for batch in batches:
            lists = batch.column("pairs")
            times = batch.column("times").flatten().to_numpy().astype("i8")
            at = np.searchsorted(pairs, lists.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])

            def summed(values):
                return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

            yield pa.RecordBatch.from_arrays([
                *(batch.column(name) for name in kept),
                pa.array(summed(times * best[at])), pa.array(summed(times * counts[at])),
            ], names=[*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " n_best long, count_sum long",
    )
