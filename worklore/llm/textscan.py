"""Whole-batch scans of texts with numpy: words, spans and their hashes.

A batch of texts is one array; every step below is a few passes over it, so a
batch costs the same whether it holds many short texts or a few long ones.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library has no such call
    _LIBC = None

_ODD = 0x9E3779B97F4A7C15
_LONG = 2048  # bytes
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, never 0; equal spans hash equal.

    values: bytes or 16-bit code units.  A span is folded eight bytes at a time, with
    a bijective scramble between the steps, so that spans of one length that first
    differ in some step differ after it; long spans go through a digest.
    """
    size = values.dtype.itemsize
    raw = np.concatenate([np.ascontiguousarray(values).view(np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))
    at, left = np.asarray(starts, np.int64) * size, (np.asarray(ends, np.int64) - starts) * size
    out = _mixed((left.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD))
    for i in np.flatnonzero(left > _LONG):
        digest = hashlib.blake2b(raw[at[i] : at[i] + left[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    live = np.flatnonzero((left > 0) & (left <= _LONG))
    at, left, state = at[live], left[live], out[live]
    while len(live):
        block = eight[at] & _KEEP[np.minimum(left, 8)]
        state = _mixed((state ^ block) * np.uint64(_ODD))
        more = left > 8
        out[live[~more]] = state[~more]
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    return np.maximum(out, np.uint64(1))


@dataclass
class Words:
    """The words of a batch of texts, in order.

    starts, ends: byte places; doc: the text's number; data: all bytes.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_docs: int
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of bytes other than space and 0x09-0x0D, never across two texts."""
    data, bounds = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1][np.diff(bounds) > 0]
    first[filled] |= inside[filled]
    before = filled[filled > 0] - 1
    last[before] |= inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    return Words(data, starts, ends, doc, len(bounds) - 1, bounds)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; the result is n - 1 shorter."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(_ODD) + hashes[i : i + len(out)])
    return out


def batches(
    arriving: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about most_bytes of text, one text at least."""
    for batch in arriving:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back, for a worker stays beside others after its task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def take_spans(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[offsets[i]:offsets[i + 1]] for i in which; also the lengths."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(lengths)
    if not len(which) or not ends[-1]:
        return flat[:0], lengths
    steps = np.repeat(offsets[:-1][which] - (ends - lengths), lengths)
    return flat[steps + np.arange(ends[-1])], lengths
