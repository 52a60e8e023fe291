"""Token ids of whole texts by a tokenizer file, with one lookup per distinct word.

A byte-pair tokenizer cuts a text into pieces and encodes each piece by itself,
so the ids of a text are the ids of its pieces in order.  `Encoder` finds the
pieces of a batch with array operations, asks the tokenizers library for pieces
it has not met, and gathers the rest from a table of bounded size.  Texts with
characters outside `_PLAIN` or with a special token's string go to the library
whole, in parts cut where no piece can span.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from worklore.llm.textscan import span_hashes, take_spans

_PLAIN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_PART = 1 << 19
_CUT = re.compile(r"(?<=[A-Za-z.,;]) (?=[A-Za-z])")


def _classes() -> np.ndarray:
    out = np.full(_PLAIN, _OTHER, np.uint8)
    for c in range(_PLAIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return out


_CLASS = _classes()


class WordTable:
    """Open-addressed map from 64-bit word hashes to rows of ids, emptied when full."""

    def __init__(self, most: int = 1_500_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << int(self.most * 2).bit_length()
        self.keys = np.zeros(self.slots, np.uint64)
        self.rows = np.zeros(self.slots, np.int32)
        self.flat: np.ndarray = np.zeros(1 << 16, np.int32)
        self.offsets: np.ndarray = np.zeros(1 << 12, np.int64)
        self.n = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where it is absent."""
        mask = np.uint64(self.slots - 1)
        at = hashes & mask
        found = self.keys[at]
        rows = np.where(found == hashes, self.rows[at], -1)
        left = np.flatnonzero((found != hashes) & (found != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            found = self.keys[at[left]]
            hit = found == hashes[left]
            rows[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (found != 0)]
        return rows

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Enter distinct, absent hashes; ids holds their rows one after another."""
        total = int(self.offsets[self.n]) + len(ids)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total - len(self.flat), len(self.flat)), np.int32)])
        if self.n + len(hashes) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(max(len(hashes), len(self.offsets)), np.int64)])
        base = int(self.offsets[self.n])
        self.flat[base:total] = ids
        self.offsets[self.n + 1 : self.n + 1 + len(hashes)] = base + np.cumsum(lengths)
        rows = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.n += len(hashes)
        if 2 * self.n > self.slots:  # one batch brought very many words
            used = self.keys != 0
            hashes, rows = np.concatenate([self.keys[used], hashes]), np.concatenate([self.rows[used], rows])
            self.slots = 1 << int(2 * self.n).bit_length()
            self.keys, self.rows = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self._enter(hashes, rows)

    def _enter(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        mask = np.uint64(self.slots - 1)
        at, left = hashes & mask, np.arange(len(hashes))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = hashes[left[free]]
            placed = self.keys[at[left]] == hashes[left]
            self.rows[at[left[placed]]] = rows[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + np.uint64(1)) & mask


def _cut_flags(units: np.ndarray, classes: np.ndarray, bounds: np.ndarray, attach_space: bool) -> np.ndarray:
    """Where pieces start: class changes, text starts, lone spaces and contractions."""
    n = len(units)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    start = fresh[:n].copy()
    start[1:] |= classes[1:] != classes[:-1]
    if attach_space:
        after = np.flatnonzero((classes[1:] != _SPACE) & (classes[:-1] == _SPACE) & ~fresh[1:n]) + 1
        start[after - 1] = True
        start[after[units[after - 1] == 32]] = False
    else:
        start |= classes == _NUMBER
    quote = np.flatnonzero((units[:-1] == 39) & start[:-1] & (classes[1:] == _LETTER) & ~fresh[1:n]) if n else []
    if len(quote):
        one = units[quote + 1]
        beyond = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], units[beyond], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("l")) & (two == ord("l"))) | (np.isin(one, [ord("v"), ord("r")]) & (two == ord("e")))
        for where, length in ((short, 1), (long, 2)):
            q = quote[where]
            start[q + 1] = False
            end = q + 1 + length
            start[end[end < n]] = True
    return start


class Encoder:
    """Ids of texts as the library gives them; one of these lives in each worker.

    attach_space: pieces take one space before them (byte-level files); otherwise
    white space is dropped, digits are single pieces, and text is composed and
    put in lower case first.
    """

    def __init__(self, path: str, most_words: int = 500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.attach_space = self.library.normalizer is None
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.table = WordTable(most_words)
        self.unknown: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] = self._from_library

    def _from_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for at in range(0, len(words), 512):
            group = words[at : at + 512]
            e = self.library.encode(group, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.int32))
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
        return np.concatenate(ids), np.concatenate(lengths)

    def whole(self, text: str) -> np.ndarray:
        """By the library alone, in parts between which no piece can span."""
        parts = []
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + _PART)
            to = cut.start() if cut else len(text)
            parts.append(np.array(self.library.encode(text[at:to], add_special_tokens=False).ids, np.int32))
            at = to
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or max(text) < chr(_PLAIN)) and not self.special.search(text)

    def prepared(self, text: str) -> str:
        if self.attach_space or not text:
            return text
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def pieces(self, texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Joined text, piece starts, ends and hashes, and each text's first piece."""
        joined = "".join(texts)
        units = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        classes = _CLASS[units]
        flags = _cut_flags(units, classes, bounds, self.attach_space)
        starts = np.flatnonzero(flags)
        ends = np.append(starts[1:], len(units)) if len(starts) else starts
        if not self.attach_space:
            keep = classes[starts] != _SPACE
            starts, ends = starts[keep], ends[keep]
        return joined, starts, ends, span_hashes(units, starts, ends), np.searchsorted(starts, bounds)

    def rows(self, hashes: np.ndarray, word_at: Callable[[int], str]) -> np.ndarray:
        """Rows of the word table, after adding the words that it lacks."""
        if self.table.n > self.table.most:
            self.table.clear()
        rows = self.table.find(hashes)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            self.table.add(new, *self.unknown([word_at(i) for i in missing[first].tolist()]))
            rows[missing] = self.table.find(hashes[missing])
        return rows

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more than texts)."""
        texts = [x or "" for x in texts]
        plain = [not x or self.is_plain(x) for x in texts]
        ready = [self.prepared(x) if ok else "" for x, ok in zip(texts, plain, strict=True)]
        if not self.attach_space and any(not x.isascii() and max(x) >= chr(_PLAIN) for x in ready):
            for i, x in enumerate(ready):
                if not x.isascii() and max(x) >= chr(_PLAIN):
                    plain[i], ready[i] = False, ""
        joined, starts, ends, hashes, first = self.pieces(ready)
        rows = self.rows(hashes, lambda i: joined[starts[i] : ends[i]])
        ids, lengths = take_spans(self.table.flat, self.table.offsets, rows)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[first]
        if all(plain):
            return ids, offsets
        parts = [ids[offsets[i] : offsets[i + 1]] if ok else self.whole(texts[i]) for i, ok in enumerate(plain)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_KEPT: dict[tuple[type, str], Encoder] = {}


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]
