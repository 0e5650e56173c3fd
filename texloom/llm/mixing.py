"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` words. Sources, sorted by
code point with null last, weigh 1, 2, 3, repeating. The targets share the
total size by weight; a target stops at ``max_epochs`` times its source's size
and the excess is shared again by weight.

For each source the mix takes whole epochs first. What is left of the budget
is fitted over the histogram of exact sizes: sizes give their share of
documents, and a bounded-knapsack dynamic programme over the remaining
documents finds the sum nearest to the budget from below. If that sum isn't the
budget itself (or its largest part that the sizes' common divisor divides), more
documents are handed to the programme, in the end all, so that the fit is the
best there is. Which documents of a size are taken is decided by a seeded hash,
so reruns agree.

Scale: texts are read once, to count words; ids, sources and sizes are written to
the shared folder. Documents are counted by (source, size) with map-side partial
sums; the histogram of one source has at most as many rows as there are different
sizes. The plan is broadcast if it has at most ``BROADCAST_ROWS`` rows, and joined
by key otherwise. The programme starts with ``width`` cells; only budgets that it
can't meet make it grow. Hash ranks are taken within buckets of about
``bucket_rows`` documents of one (source, size), so that a source or size with a
third of all rows is dealt to many tasks. The driver gets one row for each source.

Defined cases: a null or blank text has size 0 and takes 0. A null source is a
source of its own. Rows with equal ids are told apart by nothing but their
size, so they share their hash rank's fate where their ranks tie. Other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .shared import cut, free_name, small_batches

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
WIDTH = 1 << 17
BUCKET_ROWS = 250
#: Rows of a plan that is broadcast, at most: some 60 bytes each.
BROADCAST_ROWS = 200_000
_PLAN = "source string, no_source boolean, size long, n long, epochs long, extra long, source_size long, target double"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> dict[str | None, Fraction]:
    """sizes: (source, size) of each source, in any order."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "surrogatepass")))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    cap = {s: max_epochs * n for s, n in order}
    left, total = [s for s, _ in order], Fraction(sum(n for _, n in order))
    out: dict[str | None, Fraction] = {}
    while left:
        share = total / sum(weight[s] for s in left)
        full = [s for s in left if cap[s] < share * weight[s]]
        if not full:
            return out | {s: share * weight[s] for s in left}
        for s in full:
            out[s] = Fraction(cap[s])
            total -= cap[s]
        left = [s for s in left if s not in out]
    return out


def fit(sizes: list[int], counts: list[int], budget: int, width: int = WIDTH) -> list[int]:
    """How many documents of each size to take so that their sum comes as near to ``budget`` as any can that isn't over it."""
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(sizes)
    unit = math.gcd(*(s for s, n in zip(sizes, counts, strict=True) if n))
    sizes, budget, total = [s // unit for s in sizes], budget // unit, total // unit
    while True:
        taken, left = _shares(sizes, counts, budget, total, width)
        if left <= width:
            more = _programme(sizes, [n - t for n, t in zip(counts, taken, strict=True)], left)
            if budget <= width or sum(s * n for s, n in zip(sizes, more, strict=True)) == left:
                return [t + n for t, n in zip(taken, more, strict=True)]
        width *= 8


def _shares(sizes: list[int], counts: list[int], budget: int, total: int, width: int) -> tuple[list[int], int]:
    """Documents of each size by its share of what exceeds half the width, none if all fits the width; and the budget left."""
    if budget <= width:
        return [0] * len(sizes), budget
    taken = [n * (budget - width // 2) // total for n in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    for k in sorted((k for k in range(len(sizes)) if sizes[k] > 0), key=lambda k: -sizes[k]):
        if left > width:  # what rounding down left over
            more = min(counts[k] - taken[k], (left - width // 2) // sizes[k])
            taken[k] += more
            left -= more * sizes[k]
    return taken, left


def _programme(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """The best sum of at most ``budget``, by bounded knapsack."""
    out = [0] * len(sizes)
    # by[x]: the first piece that reached sum x; pieces are size * 2^j documents
    mask, reached = (1 << (budget + 1)) - 1, 1
    by = np.full(budget + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []
    for k in sorted((k for k in range(len(sizes)) if sizes[k] > 0), key=lambda k: -sizes[k]):
        free, step = min(counts[k], budget // sizes[k]), 1
        while free > 0:
            part = min(step, free)
            new = ((reached << (part * sizes[k])) & mask) & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = len(pieces)
                reached |= new
            pieces.append((k, part))
            free, step = free - part, step * 2
        if reached >> budget & 1:
            break
    x = reached.bit_length() - 1
    while x > 0:
        k, part = pieces[by[x]]
        out[k] += part
        x -= part * sizes[k]
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc id, source and size, with a flag for null sources so that joins are plain equalities."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(W.split_words(data, offsets, lower=False, hashes=False).ptr) for _, _, data, offsets in W.slices(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n or [[]]), pa.int64())], ["doc", "source", "size"])

    id_type = docs.schema[id_col].dataType.simpleString()
    d = small_batches(docs).select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    d = d.mapInArrow(count, f"doc {id_type}, source string, size long")
    return d.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))


def plan(hist: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, width: int = WIDTH) -> DataFrame:
    """hist: source, no_source, size, n. What to take of each (source, size): whole epochs, and extra documents once more."""
    totals = hist.groupBy("source", "no_source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    want = targets([(None if r["no_source"] else r["source"], int(r["words"])) for r in totals], weights, max_epochs)

    def of_source(table: pa.Table) -> pa.Table:
        sizes, counts = table["size"].to_pylist(), table["n"].to_pylist()
        order = sorted(range(len(sizes)), key=lambda k: sizes[k])
        sizes, counts = [sizes[k] for k in order], [counts[k] for k in order]
        source, none = table["source"][0].as_py(), table["no_source"][0].as_py()
        own, goal = sum(s * n for s, n in zip(sizes, counts, strict=True)), want[None if none else source]
        epochs = min(max_epochs, int(goal // own)) if own else 0
        extra = fit(sizes, counts, int(goal) - epochs * own if epochs < max_epochs else 0, width)
        n = len(sizes)
        return pa.table([[source] * n, [none] * n, sizes, counts, [epochs] * n, extra, [own] * n, [float(goal)] * n], names=["source", "no_source", "size", "n", "epochs", "extra", "source_size", "target"]).cast(pa.schema([("source", pa.string()), ("no_source", pa.bool_()), *((c, pa.int64()) for c in ("size", "n", "epochs", "extra", "source_size")), ("target", pa.float64())]))

    return hist.groupBy("source", "no_source").applyInArrow(of_source, _PLAN)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of docs: id, size, source_size, target, copies (how often the mix takes it) and taken (copies * size)."""
    d = cut(sized(docs, id_col, text_col, source_col), "sizes")
    keys = ["source", "no_source", "size"]
    steps = cut(plan(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), weights=weights, max_epochs=max_epochs, width=width), "mix-plan")
    d = d.join(F.broadcast(steps) if steps.count() <= BROADCAST_ROWS else steps, keys).withColumn("rank", F.xxhash64(F.lit(seed), "doc"))
    d = d.withColumn("bucket", F.shiftrightunsigned(F.col("rank"), 33) % F.ceil(F.col("n") / bucket_rows))
    # Only sizes of which some documents are taken once more and some aren't need ranks.
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    some = d.filter(split)
    cell = [*keys, "bucket"]
    before = (
        some.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ).select(*cell, F.coalesce("before", F.lit(0)).alias("before"))
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("rank", "doc")))
    ranked = ranked.join(before, cell).withColumn("more", (F.col("before") + F.col("place") <= F.col("extra")).cast("long"))
    rest = d.filter(~split).withColumn("more", (F.col("extra") > 0).cast("long"))
    out = [F.col("doc").alias(id_col), "size", "source_size", "target", (F.col("epochs") + F.col("more")).alias("copies"), ((F.col("epochs") + F.col("more")) * F.col("size")).alias("taken")]
    return ranked.select(*out).unionByName(rest.select(*out))


def take(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say. Rows with equal ids are taken equally often."""
    copies, key, copy = (free_name(docs, n) for n in ("_copies", "_key", "_copy"))
    mixed = mix(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias(key)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    out = docs.join(mixed, F.col(id_col).eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
