"""Arrays of numbers as few bytes: byte planes, compressed.

The first bytes of all values, then the second bytes and so on, so that what
values have in common compresses away; sorted values go as differences.
"""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def _turned(a: np.ndarray) -> np.ndarray:
    """Rows and columns exchanged, by copies along the few bytes of a number."""
    out = np.empty(a.shape[::-1], np.uint8)
    if len(a) < a.shape[1]:
        for k in range(len(a)):
            out[:, k] = a[k]
    else:
        for k in range(a.shape[1]):
            out[k] = a[:, k]
    return out


def squeeze(*arrays: np.ndarray) -> bytes:
    """One value of these arrays; unsigned 64-bit ones must be sorted."""
    out = [np.int32(len(arrays)).tobytes()]
    for a in arrays:
        kind = a.dtype.str.encode().ljust(4)
        if a.dtype == np.uint64 and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        body = zstandard.ZstdCompressor(level=_LEVEL).compress(_turned(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)))
        out += [kind, np.int64(len(a)).tobytes(), np.int64(len(body)).tobytes(), body]
    return b"".join(out)


def expand(blob: bytes, which: slice = slice(None)) -> list[np.ndarray]:
    """The arrays, or some of them."""
    out, at, count = [], 4, int(np.frombuffer(blob, "<i4", 1)[0])
    wanted = range(count)[which]
    for j in range(count):
        kind = np.dtype(blob[at : at + 4].decode().strip())
        n, size = np.frombuffer(blob, "<i8", 2, at + 4).tolist()
        if j not in wanted:
            at += 20 + size
            continue
        body = zstandard.ZstdDecompressor().decompress(blob[at + 20 : at + 20 + size], max_output_size=n * kind.itemsize)
        a = _turned(np.frombuffer(body, np.uint8).reshape(kind.itemsize, n)).reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += 20 + size
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts as 32-bit numbers where they fit."""
    return a.astype(np.int32) if not len(a) or a.max() < 1 << 31 else a.astype(np.int64)
