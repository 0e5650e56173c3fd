"""Substring dedup by level-wise doubling, from half the wanted length to all of it.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window of ``length`` words is
repeated if its word sequence also starts in a document with a smaller id;
words that repeated windows cover are removed, whatever else is.

Levels. A repeated window can only stand where its parts are repeated, so the
first level looks at windows of half the length (7 words for 13), and of those
only at each full window's anchor: the part with the smallest hash. Equal
windows have equal anchors. Anchors that more than one document has survive;
only windows around surviving anchors are extended to the full length and
compared exactly. No longer level is run: what a window of twice the length
covers, its parts of ``length`` words cover too, so the result is complete once
these are known.

Scale: each level moves packed hashes, not rows: 4 bytes for an anchor (a false
match there only keeps a candidate), 8 for a window. A task sends one entry for
each hash, however often it has it, and knows the smallest owner, so that a
passage in a third of all documents sends as many entries as there are tasks.
Surviving anchors are handed on as a filter of ``filter_bits`` bits, a fixed
size: on larger inputs it lets more candidates through but never drops one.
Whole texts are dealt once, by groups of ids.

Defined cases: a null or empty text has no words and keeps none. Rows with equal
ids count as one document for others, and aren't repeats of each other. A null id is
larger than any other. Fewer words than a window are never removed. Other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import packed as P, words as W
from .shared import small_batches

LENGTH = 13
FILTER_BITS = 1 << 27
_BUCKET_SALT = np.uint64(0xA24BAED4963EE407)
#: Groups of documents for each shuffle partition in the last step. What a bucket of hashes hands back is packed by
#: group, so this many times the square of the partitions bounds the rows that are handed back.
GROUPS = 1


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets by bits that are independent of the hash's own."""
    return (W.mix(h ^ _BUCKET_SALT) >> np.uint64(33)).astype(np.int64) % n


def first_words(ptr: np.ndarray, n: int) -> np.ndarray:
    """First words of all n-word windows that stay inside a document."""
    lens = np.maximum(np.diff(ptr) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(lens)])
    return np.arange(at[-1]) - np.repeat(at[:-1] - ptr[:-1], lens)


def anchors(w: W.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and each window's anchor hash."""
    first = first_words(w.ptr, length)
    if not len(first):
        return first, np.empty(0, np.uint64)
    half = (length + 1) // 2
    parts = W.window_hash(w.hash, half)
    low = parts[: len(parts) - (length - half)].copy()
    for k in range(1, length - half + 1):
        np.minimum(low, parts[k : k + len(low)], out=low)
    return first, low[first]


def in_filter(sections: list[np.ndarray], h: np.ndarray, bits: int) -> np.ndarray:
    """Whether hashes may be among those that survived."""
    n = len(sections)
    flat = np.concatenate(sections)
    base = _bucket(h, n) * bits
    a, b = _spots(h, bits)
    return (flat[base + a >> 3] >> (a & 7) & flat[base + b >> 3] >> (b & 7) & 1).astype(bool)


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = h & np.uint64(0xFFFFFFFF)
    x = W.mix(low + np.uint64(0x9E3779B97F4A7C15))
    return (x % np.uint64(bits)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _combined(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a task's entries: each hash with its smallest owner and whether others have it too; and the others' entries."""
    order = np.lexsort((owner, h))
    owner, h = owner[order], h[order]
    new = P.starts(h)
    smallest = np.repeat(owner[new], np.diff(np.concatenate([new, [len(h)]])))
    other = owner != smallest
    shared = np.add.reduceat(other.astype(np.int32), new) > 0 if len(new) else np.empty(0, bool)
    o, x = owner[other], h[other]
    keep = np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])]) if len(o) else np.empty(0, bool)
    return owner[new], h[new], shared, o[keep], x[keep]


def _gathered(batches: Iterator[pa.RecordBatch], of_slice: Callable[[W.Words, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, hashes) that of_slice makes of (words, ids), about FLUSH at a time."""
    owners, hashes, held = [], [], 0
    for batch in batches:
        ids = P.ids_of(batch.column(0))
        for a, b, data, offsets in W.slices(batch.column(1)):
            o, h = of_slice(W.split_words(data, offsets, lower=False), ids[a:b])
            owners.append(o)
            hashes.append(h)
            held += len(h)
            if held >= P.FLUSH:
                yield np.concatenate(owners), np.concatenate(hashes)
                owners, hashes, held = [], [], 0
    if held:
        yield np.concatenate(owners), np.concatenate(hashes)


def surviving_anchors(texts: DataFrame, length: int, filter_bits: int) -> tuple[list[bytes], int]:
    """The filter of anchors that several documents have: a section for each bucket, of as many bits each."""
    n = P.buckets(texts.sparkSession)
    bits = max(64, filter_bits // n // 8 * 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_slice(w: W.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first, low = anchors(w, length)
            new = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.empty(0, bool)
            doc = np.repeat(np.arange(len(ids)), np.maximum(np.diff(w.ptr) - length + 1, 0))
            new |= np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else new
            return ids[doc[new]], low[new]

        for owner, h in _gathered(batches, of_slice):
            o, x, shared, _, _ = _combined(owner, h)
            # what several documents here have is told by a second owner
            o, x = np.concatenate([o, np.full(shared.sum(), -1, np.int64)]), np.concatenate([x, x[shared]])
            yield P.batch_of(list(P.deal(_bucket(x, n), n, o, (x & np.uint64(0xFFFFFFFF)).astype("<u4"))))

    def receive(table: pa.Table) -> pa.Table:
        owner, low = P.unpack_all(table["packed"], "<u4")
        order = np.lexsort((owner, low))
        owner, low = owner[order], low[order]
        new = P.starts(low)
        ends = np.concatenate([new[1:], [len(low)]]) - 1
        alive = low[new][owner[new] != owner[ends]].astype(np.uint64)
        section = np.zeros(bits, bool)
        for spot in _spots(alive, bits):
            section[spot] = True
        return pa.table({"bucket": table["bucket"][:1], "packed": pa.array([np.packbits(section, bitorder="little").tobytes()], pa.binary())})

    got = {r["bucket"]: r["packed"] for r in texts.mapInArrow(send, P.PACKED).groupBy("bucket").applyInArrow(receive, P.PACKED).collect()}
    return [bytes(got.get(k) or bytes(bits // 8)) for k in range(n)], bits


def repeated_windows(texts: DataFrame, length: int, filter_bits: int, groups: int) -> tuple[DataFrame, int]:
    """What tasks send: packed (id, hash) of candidate windows by buckets of hashes, and behind these (from the second value on) what they decided alone, by groups of ids."""
    spark = texts.sparkSession
    n = P.buckets(spark)
    sections, bits = surviving_anchors(texts, length, filter_bits)
    shared = spark.sparkContext.broadcast(sections)
    groups_at = n  # buckets from here on hold what a task has decided by itself

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive = [np.frombuffer(s, np.uint8) for s in shared.value]

        def of_slice(w: W.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first, low = anchors(w, length)
            keep = in_filter(alive, low, bits) if len(low) else np.empty(0, bool)
            doc = np.repeat(np.arange(len(ids)), np.maximum(np.diff(w.ptr) - length + 1, 0))
            return ids[doc[keep]], W.window_hash(w.hash, length)[first[keep]] if keep.any() else np.empty(0, np.uint64)

        for owner, h in _gathered(batches, of_slice):
            o, x, _, later, again = _combined(owner, h)
            rows = list(P.deal(_bucket(x, n), n, o, x))
            rows += [(groups_at + k, b) for k, b in P.deal(P.group_of(later, groups), groups, later, again)]
            yield P.batch_of(rows)

    sent = texts.mapInArrow(send, P.PACKED)
    return sent, groups_at


def _decided(sent: DataFrame, groups_at: int, groups: int) -> DataFrame:
    """Both what tasks decided alone and what the buckets did. One pass over what was sent: entries and decisions share its shuffle."""

    def receive(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= groups_at:
            return pa.table({"bucket": pa.array([bucket - groups_at] * table.num_rows, pa.int64()), "packed": table["packed"]})
        owner, h = P.unpack_all(table["packed"], "<u8")
        order = np.lexsort((owner, h))
        owner, h = owner[order], h[order]
        new = P.starts(h)
        smallest = np.repeat(owner[new], np.diff(np.concatenate([new, [len(h)]])))
        later = owner > smallest
        return pa.Table.from_batches([P.batch_of(list(P.deal(P.group_of(owner[later], groups), groups, owner[later], h[later])))])

    return sent.groupBy("bucket").applyInArrow(receive, P.PACKED)


def covered(w: W.Words, ids: np.ndarray, marks: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Which words the marked windows cover. marks: (id, hash), sorted."""
    first = first_words(w.ptr, length)
    hit = np.zeros(len(w.hash) + 1, np.int32)
    if len(first) and len(marks[0]):
        doc = np.repeat(np.arange(len(ids)), np.maximum(np.diff(w.ptr) - length + 1, 0))
        h = W.window_hash(w.hash, length)[first]
        owners = np.unique(marks[0])
        # marks and windows as (rank of the owner, hash), compared owner by owner
        maybe = np.isin(ids, owners)[doc]
        for k in np.unique(doc[maybe]).tolist():
            a, b = np.searchsorted(marks[0], [ids[k], ids[k] + 1]) if ids[k] < P.NO_ID else (np.searchsorted(marks[0], ids[k]), len(marks[0]))
            mine = slice(*np.searchsorted(doc, [k, k + 1]))
            at = first[mine][np.isin(h[mine], marks[1][a:b])]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
    return np.cumsum(hit[:-1]) > 0


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, filter_bits: int = FILTER_BITS, groups: int | None = None) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256."""
    spark = docs.sparkSession
    groups = groups or GROUPS * P.buckets(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent, groups_at = repeated_windows(texts, length, filter_bits, groups)
    marks = _decided(sent, groups_at, groups)
    dealt = texts.withColumn("bucket", P.group_column(F.col("id"), groups))

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        owner, h = P.unpack_all(right["packed"], "<u8")
        order = np.lexsort((h, owner))
        marked = owner[order], h[order]
        out: list[tuple[int, int, str]] = []
        for batch in left.combine_chunks().to_batches():
            ids = P.ids_of(batch.column(0))
            for a, b, data, offsets in W.slices(batch.column(1)):
                w = W.split_words(data, offsets, lower=False)
                gone = covered(w, ids[a:b], marked, length)
                raw = w.data.tobytes()
                s, e = w.start.tolist(), w.end.tolist()
                for k in range(b - a):
                    own = np.flatnonzero(~gone[w.ptr[k] : w.ptr[k + 1]]) + w.ptr[k]
                    total = int(w.ptr[k + 1] - w.ptr[k])
                    out.append((total, total - len(own), b" ".join([raw[s[j] : e[j]] for j in own.tolist()]).decode("utf-8", "replace")))
        return pa.table([left["id"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    done = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(clean, f"id {id_type}, n_words long, n_removed long, kept_text string")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

