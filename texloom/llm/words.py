"""Words, word hashes and word-window hashes over Arrow batches.

Everything works on the UTF-8 bytes of a whole batch with numpy, so the cost
per word is a few vector operations and no Python object is made per word.
Hashes are 64 bits, fixed by the constants below, and equal on all machines. A
word is folded eight bytes at a time, every step of which multiplies and shifts,
so that no pattern of repeated bytes cancels out; windows are folded by doubling
in the same way. ``same_bytes`` compares what hashes say is equal.
Memory is bounded by ``SLICE_BYTES`` of text at a time (or the longest single
document, if that is longer).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once.
SLICE_BYTES = 1 << 20
#: Bytes of a word from which on it is hashed by itself, by BLAKE2.
_LONG = 256

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_WINDOW_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Of the bytes of a word's last eight that belong to it, by their number less one.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_table(keep: str) -> np.ndarray:
    """256 booleans: which bytes belong to words."""
    table = np.zeros(256, bool)
    if keep == "nonspace":  # [^\x20\x09-\x0D]
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif keep == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    else:
        raise ValueError(f"unknown word class {keep!r}")
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None
TABLES = {k: _byte_table(k) for k in ("nonspace", "alnum")}


@dataclass
class Words:
    """Words of consecutive documents: document k has words ptr[k]:ptr[k+1], and word j the bytes start[j]:end[j]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-word windows that stay inside a document, and their hashes."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        acc = window_hash(self.hash, n)
        inside = np.zeros(len(self.hash) + 1, bool)
        lens = np.diff(self.ptr)
        full = lens >= n
        # a window may start at ptr[k] .. ptr[k+1]-n
        step = np.zeros(len(self.hash) + 1, np.int32)
        np.add.at(step, self.ptr[:-1][full], 1)
        np.add.at(step, self.ptr[1:][full] - n + 1, -1)
        inside = np.cumsum(step[:count]) > 0
        first = np.flatnonzero(inside)
        return first, acc[first]


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    with np.errstate(over="ignore"):
        return mix(a * _WORD_BASE + (b ^ _WINDOW_BASE))


def window_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of one sequence of word hashes: of halves by doubling, then of the two that cover n words."""
    count = max(0, len(word_hash) - n + 1)
    if not count:
        return np.empty(0, np.uint64)
    h, size = word_hash, 1
    while 2 * size <= n:
        h = fold(h[: len(h) - size], h[size:])
        size *= 2
    with np.errstate(over="ignore"):
        return fold(h[:count], h[n - size : n - size + count] + np.uint64(n))


def sequence_hash(word_hash: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words, as window_hash has it for its length."""
    return window_hash(word_hash, len(word_hash))[0]


def list_hashes(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One hash for each list values[ptr[k]:ptr[k+1]], of its values and their places."""
    lens = np.diff(ptr)
    with np.errstate(over="ignore"):
        place = (np.arange(len(values)) - np.repeat(ptr[:-1] - ptr[0], lens)).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values[ptr[0] : ptr[-1]] ^ mix(place + _WINDOW_BASE)))])
        at = ptr - ptr[0]
        return mix(sums[at[1:]] - sums[at[:-1]] + lens.astype(np.uint64) * _WORD_BASE)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; seven more bytes than the text has are read."""
    room = np.empty(len(data) + 8, np.uint8)
    room[: len(data)] = data
    room[len(data) :] = 0
    return np.ndarray((len(data) + 1,), "<u8", room, 0, (1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start[j]:end[j]]."""
    if not len(start):
        return np.empty(0, np.uint64)
    lens = end - start
    eights = _eights(data)
    with np.errstate(over="ignore"):
        out = lens.astype(np.uint64) * _WORD_BASE
        first = eights[start] & _TAIL[np.minimum(lens, 8) - 1]
        out = mix(out ^ first * _M1)
        live = np.flatnonzero((lens > 8) & (lens <= _LONG))
        at = 8
        while len(live):
            left = lens[live] - at
            out[live] = fold(out[live], eights[start[live] + at] & _TAIL[np.minimum(left, 8) - 1])
            at += 8
            live = live[left > 8]
    for k in np.flatnonzero(lens > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other_data: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of the word at its place in the other list."""
    eights = _eights(data)
    others = eights if other_data is data else _eights(other_data)
    lens = end - start
    same = lens == other_end - other_start
    live, at = np.flatnonzero(same & ((start != other_start) | (other_data is not data))), 0
    while len(live):
        left = lens[live] - at
        equal = (eights[start[live] + at] ^ others[other_start[live] + at]) & _TAIL[np.minimum(left, 8) - 1] == 0
        same[live[~equal]] = False
        live = live[equal & (left > 8)]
        at += 8
    return same


def split_words(data: np.ndarray, offsets: np.ndarray, keep: str = "nonspace", lower: bool = True, hashes: bool = True) -> Words:
    """Words of the documents data[offsets[k]:offsets[k+1]]."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = offsets.astype(np.int64) - base
    if lower:
        data = _LOWER[data]
    inside = TABLES[keep][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    before &= ~edge[:-1]
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    ptr = np.searchsorted(start, offsets)
    return Words(data, start, end, ptr, word_hashes(data, start, end) if hashes else np.empty(0, np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of documents with at most ``limit`` bytes, one document at least."""
    data, offsets = utf8(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data, offsets[a : b + 1]
        a = b
    give_back()


def give_back() -> None:
    """Hands free memory back to the system: Python workers live on between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """Per document the sorted distinct n-word shingle hashes; with fewer words the whole sequence as one; without words none."""
    first, hashes = words.windows(n)
    cut = np.searchsorted(first, words.ptr)
    out = []
    for k in range(len(words.ptr) - 1):
        own = hashes[cut[k] : cut[k + 1]]
        if len(own):
            out.append(np.unique(own))
        elif words.ptr[k + 1] > words.ptr[k]:
            out.append(np.array([sequence_hash(words.hash[words.ptr[k] : words.ptr[k + 1]])], np.uint64))
        else:
            out.append(own)
    return out
