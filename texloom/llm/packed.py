"""Hash entries packed by the thousand.

Operators that compare windows or shingles over a whole corpus move one hash
for each of them. As rows of their own they would cost several times their
size; here each task packs the entries that go to one bucket into one binary
value: runs of entries with the same owner, then the hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from .squeezed import expand, narrow, squeeze

#: Entries that a task gathers before it packs them.
FLUSH = 1 << 20
#: Owner of entries whose own id is null: never smaller than any other.
NO_ID = (1 << 63) - 1
PACKED = "bucket long, packed binary"


def buckets(spark: SparkSession) -> int:
    """Buckets that hashes are dealt to: twice as many as the session has partitions for its shuffles, since a task holds one at a time."""
    return 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(owner: np.ndarray, value: np.ndarray) -> bytes:
    """owner (int64) in runs, value of any fixed width."""
    n = len(owner)
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if n else np.empty(0, np.int64)
    runs = np.diff(np.concatenate([at, [n]])).astype("<i4")
    return np.int32(len(at)).tobytes() + owner[at].astype("<i8").tobytes() + runs.tobytes() + value.tobytes()


def unpack(blob: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    runs = int(np.frombuffer(blob, "<i4", 1)[0])
    owner = np.frombuffer(blob, "<i8", runs, 4)
    lens = np.frombuffer(blob, "<i4", runs, 4 + 8 * runs)
    return np.repeat(owner, lens), np.frombuffer(blob, kind, int(lens.sum()), 4 + 12 * runs)


def pack_small(owner: np.ndarray, value: np.ndarray) -> bytes:
    """The same in fewer bytes, for sorted owners in short runs: owners as differences, all of it compressed. value of plain numbers."""
    at = starts(owner)
    return squeeze(owner[at].astype(np.int64).view(np.uint64), narrow(np.diff(np.append(at, len(owner)))), value)


def unpack_small(blob: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    owner, lens, value = expand(blob)
    return np.repeat(owner.view(np.int64), lens), value.astype(kind, copy=False)


def unpack_all(blobs: pa.ChunkedArray, kind: str, read: Callable = unpack) -> tuple[np.ndarray, np.ndarray]:
    parts = [read(b.as_py(), kind) for b in blobs]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, kind)
    return np.concatenate([o for o, _ in parts]), np.concatenate([v for _, v in parts])


def deal(bucket: np.ndarray, n: int, owner: np.ndarray, value: np.ndarray, write: Callable = pack) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed entries) of the buckets that have any; entries of a bucket in order of their owner."""
    order = np.lexsort((owner, bucket))
    bucket, owner, value = bucket[order], owner[order], value[order]
    edge = np.searchsorted(bucket, np.arange(n + 1))
    for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        yield k, write(owner[edge[k] : edge[k + 1]], value[edge[k] : edge[k + 1]])


def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["bucket", "packed"])


def group_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Which of n groups an id belongs to; group_column is the same as an expression."""
    return np.mod(ids ^ (ids >> 17), n)


def group_column(ids: Column, n: int) -> Column:
    ids = F.coalesce(ids.cast("long"), F.lit(NO_ID))
    return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 17)), F.lit(n).cast("long"))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)
