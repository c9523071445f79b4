"""Words of whole Arrow text columns as numpy arrays: no per-word Python object is made.

A word is a maximal run of bytes other than space and 0x09-0x0D.  As every byte of a multi-byte UTF-8 character is at
least 0x80, runs of bytes and runs of code points are the same words.  Words are known by a 64-bit mixing hash of their
bytes and length; with V distinct words the chance of any collision is about V*V / 2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that are worked on at once; a longer single text is worked on whole.
BLOCK_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


class Texts(NamedTuple):
    """A column of texts: their bytes one after the other, and where each begins (one more than there are texts)."""

    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    """Word starts and ends in Texts.data, and for each text where its words begin in them."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column(values: pa.Array) -> Texts:
    """The bytes of a string column; a null is an empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_string()).fill_null("") if values.null_count else values.cast(pa.large_string())
    _, where, data = values.buffers()
    offsets = np.frombuffer(where, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def release() -> None:
    """Give unused memory back to the system: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows whose texts have about `size` bytes together, with their texts; every row comes once, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = column(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(whole.offsets, whole.offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            lo, hi = whole.offsets[at], whole.offsets[to]
            yield batch.slice(at, to - at), Texts(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
            at = to
    release()


def split(texts: Texts) -> Words:
    data, offsets = texts
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    blank = SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = blank[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = blank[1:]
    start = np.flatnonzero(~blank & (before | begins[:-1]))
    end = np.flatnonzero(~blank & (after | begins[1:])) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; eight bytes of all ranges are taken in at a time."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = (end - start).astype(np.int64)
    out = left.astype(U64) * GOLD
    which, at = None, start
    while True:
        piece = eight[at] << (np.clip(8 - left, 0, 7).astype(U64) * U64(8))
        if which is None:
            out = mix(out ^ piece)
        else:
            out[which] = mix(out[which] ^ piece)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8


def word_hashes(texts: Texts, lower: bool = False) -> tuple[Words, np.ndarray]:
    """The words of texts and their hashes; lower: A-Z count as a-z."""
    found = split(texts)
    return found, hashes(LOWER[texts.data] if lower else texts.data, found.start, found.end)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and where each text's runs begin.  A text of 1 to n-1 words has one
    run, of all its words; an empty one has none."""
    total, count = len(words), np.diff(first)
    rolled = np.zeros(total, U64)
    if total >= n:
        acc = words[: total - n + 1].copy()
        for k in range(1, n):
            acc = mix(acc * GOLD + words[k : total - n + 1 + k])
        rolled[: total - n + 1] = acc
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    for i in np.flatnonzero((count > 0) & (count < n)):
        acc = words[first[i] : first[i] + 1].copy()
        for k in range(1, int(count[i])):
            acc = mix(acc * GOLD + words[first[i] + k : first[i] + k + 1])
        rolled[first[i]] = mix(acc + U64(int(count[i])))[0]
    starts = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=starts[1:])
    where = np.repeat(first[:-1] - starts[:-1], runs) + np.arange(starts[-1])
    return rolled[where], starts


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, where each run's begin now, and how often each value stood there."""
    runs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, runs))
    values, runs = values[order], runs[order]
    if not len(values):
        return values, np.zeros(len(first), np.int64), np.zeros(0, np.int64)
    new = np.empty(len(values), bool)
    new[0] = True
    new[1:] = (values[1:] != values[:-1]) | (runs[1:] != runs[:-1])
    at = np.flatnonzero(new)
    return values[at], np.searchsorted(runs[at], np.arange(len(first))), np.diff(np.append(at, len(values)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each run, in order of the values; 0 for an empty run."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out
