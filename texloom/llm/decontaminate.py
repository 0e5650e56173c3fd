"""Benchmark decontamination: a hash set of test n-grams against all training windows.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z
lower-cased. A window is ``window`` consecutive words of a benchmark item; an
item with fewer words, but not none, is one window. The set of window hashes
is broadcast; each document's windows are looked up in it, each hit is
verified word by word, and the words that hits cover are marked.

Scale: documents are only mapped, never shuffled. What is broadcast is
checked: items are taken in blocks of at most ``block_bytes`` of text, and
where the benchmark is larger, the documents pass through one such narrow step
for each block.

Defined cases: a null text has no words. An item without words is never hit.
Equal items each count. Rows are judged one by one, so repeated rows give
repeated results. An empty benchmark leaves everything clean. Other columns
aren't read; ``find_contamination`` returns only its own, ``decontaminate``
all of its input's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words as W
from .shared import free_name, small_batches

#: Text bytes of benchmark items that are held at once, on the driver and on each executor.
BLOCK_BYTES = 32 << 20

_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
    ]
)


@dataclass
class Block:
    """Windows of a block of items: for each length the sorted hashes, and for each hash its words and items."""

    lengths: list[int]
    hashes: list[np.ndarray]
    windows: list[list[tuple[bytes, list[str]]]]


def build_block(items: list[tuple[str, str | None]], window: int) -> Block:
    """items: (id as a string, text)."""
    found: dict[int, dict[int, dict[bytes, list[str]]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        w = W.split_words(raw, np.array([0, len(raw)]), "alnum")
        if not len(w.hash):
            continue
        n = min(window, len(w.hash))
        first, hashes = w.windows(n)
        for i, h in zip(first.tolist(), hashes.tolist(), strict=True):
            key = b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + n))
            owners = found.setdefault(n, {}).setdefault(h, {}).setdefault(key, [])
            if item not in owners[-1:]:
                owners.append(item)
    block = Block([], [], [])
    for n, by_hash in sorted(found.items()):
        order = sorted((h, key, owners) for h, keys in by_hash.items() for key, owners in keys.items())
        block.lengths.append(n)
        block.hashes.append(np.array([h for h, _, _ in order], np.uint64))
        block.windows.append([(key, owners) for _, key, owners in order])
    return block


def match(w: W.Words, block: Block) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words hits cover, and for each document with hits its items."""
    hit = np.zeros(len(w.hash) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for n, hashes, windows in zip(block.lengths, block.hashes, block.windows, strict=True):
        first, own = w.windows(n)
        at = np.searchsorted(hashes, own)
        at[at == len(hashes)] = 0
        for k in np.flatnonzero(hashes[at] == own) if len(own) else ():
            i, j = int(first[k]), int(at[k])
            key = b" ".join(w.data[w.start[x] : w.end[x]].tobytes() for x in range(i, i + n))
            while j < len(hashes) and hashes[j] == own[k]:  # a hash may stand for several windows
                if windows[j][0] == key:
                    hit[i] += 1
                    hit[i + n] -= 1
                    items.setdefault(int(np.searchsorted(w.ptr, i, "right")) - 1, set()).update(windows[j][1])
                j += 1
    return np.cumsum(hit[:-1]) > 0, items


def _runs(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2).tolist()


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    """Blocks of items, each of a checked size; the driver holds one at a time."""
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-int(total) // max(1, block_bytes // 2)) or 1
    for k in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield build_block([(r["i"] or "", r["t"]) for r in part.sort("i", "t").collect()], window)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str, block_bytes: int) -> tuple[DataFrame, str, str]:
    """docs with two more columns: the spans of hit words and the items with occurring windows."""
    spans_col, items_col = free_name(docs, "_spans"), free_name(docs, "_items")
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, _SPANS), T.StructField(items_col, T.ArrayType(T.StringType()))])
    out = small_batches(docs)
    for n, block in enumerate(_blocks(benchmark, window, item_col, item_text_col, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch], shared=shared, more=n > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(batch.schema.get_field_index(text_col))
                spans: list[list[list[int]]] = []
                items: list[list[str]] = []
                for _, _, data, offsets in W.slices(col):
                    w = W.split_words(data, offsets, "alnum")
                    hit, found = match(w, shared.value)
                    for k in range(len(w.ptr) - 1):
                        spans.append(_runs(hit[w.ptr[k] : w.ptr[k + 1]]) if k in found else [])
                        items.append(sorted(found.get(k, ())))
                names = batch.schema.names
                arrays = list(batch.columns)
                if more:
                    old_spans, old_items = arrays[-2].to_pylist(), arrays[-1].to_pylist()
                    names, arrays = names[:-2], arrays[:-2]
                    spans = [merge_spans(a + b) for a, b in zip(old_spans, spans, strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(old_items, items, strict=True)]
                arrays += [pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, spans_col, items_col])

        out = out.mapInArrow(mark, schema)
    return out, spans_col, items_col


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: id, n_words, spans ([first word, end word) of what is hit) and items (sorted ids as strings)."""
    out, spans, items = _marked(docs.select(F.col(id_col), F.col(text_col)), benchmark, window, text_col, item_col, item_text_col, block_bytes)
    return out.select(F.col(id_col), n_words(F.col(text_col)).alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items"))


def summarize(found: DataFrame, *, id_col: str = "doc_id", hit_share: int = 20) -> DataFrame:
    """Counts and the verdict: contaminated where at least one word in ``hit_share`` is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit_share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", hit_share: int = 20, spans_too: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents; with ``spans_too``, hit words go from the documents that stay.

    A removed span takes along the bytes from its first word's start to its
    last word's end; what stands around it stays as it is.
    """
    out, spans, items = _marked(docs, benchmark, window, text_col, item_col, item_text_col, block_bytes)
    hit = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    out = out.filter((hit == 0) | (hit_share * hit < n_words(F.col(text_col))))
    if spans_too:

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                col = batch.column(at)
                if pa.compute.sum(pa.compute.list_value_length(batch.column(batch.schema.get_field_index(spans)))).as_py():
                    texts = col.to_pylist()
                    for k, own in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()):
                        if own:
                            texts[k] = strip_spans(texts[k], own)
                    arrays = list(batch.columns)
                    arrays[at] = pa.array(texts, col.type)
                    batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
                yield batch

        out = out.mapInArrow(strip, out.schema)
    return out.drop(spans, items)


def strip_spans(text: str, spans: list[list[int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    w = W.split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), "alnum", hashes=False)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : w.start[a]])
        at = int(w.end[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

