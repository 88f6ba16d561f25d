"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once.

A byte-level or word BPE splits a text into words before it merges, so the ids of a text are the
ids of its words in a row. Words repeat, so they are encoded once and kept; Arrow splits the texts of a
batch and finds its distinct words, and one NumPy gather puts the ids together. Texts whose white space
could make the split depend on its neighbours, and those that spell a special token, go through the
tokenizer as a whole, so every text gets the ids of the plain library call.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

#: letters that are letters to every tokenizer here, then punctuation without the apostrophe
_PLAIN = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: two white space characters in a row, of those that Unicode has
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_KEEP = 1_000_000
_CHUNK = 10_000
#: characters of the texts that are put together at once (a longer one alone)
_CHARS = 2_000_000
#: byte-level vocabularies write a byte as a printable character: itself, or 256 and up in turn
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512)))
_SPACE = chr(_BYTES[32])
_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, spaces: bool) -> WordEncoder:
    """The encoder of this worker process for one tokenizer file."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = WordEncoder(path, spaces)
    return _ENCODERS[path, spaces]


class Words:
    """The ids of words already met, in one flat array with the place of each word."""

    def __init__(self, kind: str = "u4"):
        import numpy as np

        self.ids = np.zeros(1 << 16, kind)
        self.ends = np.zeros(1 << 14, "i8")
        self.count = 0

    def __len__(self) -> int:
        """All ids kept."""
        return int(self.ends[self.count])

    def add(self, ids, ends) -> None:
        """More words: their ids in a row, and where each ends in them."""
        import numpy as np

        size = int(self.ends[self.count])
        while self.count + len(ends) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[size : size + len(ids)] = ids
        self.ends[self.count + 1 : self.count + 1 + len(ends)] = size + ends
        self.count += len(ends)

    def take(self, words):
        """The ids of ``words`` (numbers) in a row, and how many each has."""
        import numpy as np

        sizes = self.ends[words + 1] - self.ends[words]
        shift = self.ends[words] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes

    def one(self, word: int) -> bytes:
        return self.ids[self.ends[word] : self.ends[word + 1]].tobytes()


class WordEncoder:
    """``spaces``: the space before a word is part of it (byte-level); else white space is dropped.

    Ids are returned as bytes, little-endian unsigned 32-bit.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.spaces = spaces
        self.marks: dict[str, bytes] = {}
        self._forget()
        self.newline = self.plain(["\n"])[0] if spaces else b""
        probe = [" a", " Hello", " été", "Ünder", "Zß"] if spaces else ["a", "Hello", "Été", "Zß"]
        self.direct = self.plain(probe) == [self._letters(w) for w in probe]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words = Words()

    def plain(self, texts: list[str]) -> list[bytes]:
        """Straight through the tokenizer."""
        found: list[bytes] = []
        for at in range(0, len(texts), _CHUNK):
            batch = self.tokenizer.encode_batch_fast(
                texts[at : at + _CHUNK], add_special_tokens=False
            )
            found += [array("I", one.ids).tobytes() for one in batch]
        return found

    def _letters(self, word: str) -> bytes:
        """A word of letters through the vocabulary's merges alone."""
        shown = word if self.spaces else word.lower()
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(_BYTES)
        elif shown[:1] == " ":  # the only other character of a word that is not its own letter
            shown = _SPACE + shown[1:]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, texts) -> Iterator[bytes]:
        """The ids of each text of an Arrow column; a NULL text is the empty one."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + _CHARS, "right")))
            yield from self._portion(texts.slice(at, to - at))
            at = to

    def _portion(self, texts) -> Iterator[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pa.array(np.zeros(len(texts), bool))
        if self.spaces:
            whole = pc.match_substring_regex(texts, _RUN)
        for name in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        alone = iter(self.plain(texts.filter(whole).to_pylist()))
        # a word after a line end is looked up with it; every other one stands for " word"
        lines = pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n")
        first, none = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        split = pc.split_pattern(pc.binary_join_element_wise(first, lines, none), " ")
        distinct = split.flatten().dictionary_encode()
        if len(self.known) > _KEEP:
            self._forget()
        words = distinct.dictionary.to_numpy(zero_copy_only=False)  # far faster than to_pylist
        places = list(map(self.known.get, words))
        if None in places:
            self._learn([word for word, place in zip(words, places) if place is None])
            places = list(map(self.known.__getitem__, words))
        ids, sizes = self.words.take(np.array(places, "i8")[distinct.indices.to_numpy()])
        counts = split.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        skip, n = len(self.newline) // 4, 0
        for one in whole.to_pylist():
            if one:
                yield next(alone)
            else:
                yield ids[ends[n] + skip : ends[n + 1]].tobytes()
                n += 1

    def _learn(self, words: Iterable[str]) -> None:
        """Add the ids of words: letters, then marks, or anything else as it is."""
        parts: list[tuple[str, str, str]] = []
        stems: set[str] = set()
        others: list[str] = []
        marks: set[str] = set()
        for word in words:
            if (found := _PLAIN.fullmatch(word)) and self.direct:
                stem, mark = found.groups()
                stems.add(stem)
                if mark:
                    marks.add(mark)
                    parts.append((word, stem, mark))
            else:
                others.append(word)
        lead = " " if self.spaces else ""
        fresh: dict[str, bytes] = {}
        known: dict[str, bytes] = {}
        for stem in stems:
            if (place := self.known.get(stem)) is not None:
                known[stem] = self.words.one(place)
            elif stem[0] == "\n":
                fresh[stem] = self.newline + self._letters(stem[1:])
            else:
                fresh[stem] = self._letters(lead + stem)
        known |= fresh
        shown = [w[1:] if w.startswith("\n") else lead + w for w in others]
        for word, ids in zip(others, self.plain(shown)):
            fresh[word] = self.newline + ids if word.startswith("\n") else ids
        new = list(marks.difference(self.marks))
        self.marks.update(zip(new, self.plain(new)))
        for word, stem, mark in parts:
            fresh[word] = known[stem] + self.marks[mark]
        if len(self.marks) > _KEEP:
            self.marks.clear()
        self._add(fresh)

    def _add(self, fresh: dict[str, bytes]) -> None:
        import numpy as np

        ends = np.cumsum(np.fromiter(map(len, fresh.values()), "i8", len(fresh))) // 4
        first = len(self.known)
        self.words.add(np.frombuffer(b"".join(fresh.values()), "<u4"), ends)
        self.known.update(zip(fresh, range(first, first + len(fresh))))
