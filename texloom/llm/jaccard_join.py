"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

A document's set holds its distinct ``n``-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``); with fewer words the whole sequence is its one shingle, and
without words the set is empty and linked with nothing. Two documents link if
100 * intersection >= ``percent`` * union. Documents with equal sets are one
class, and everything below works on classes.

1. *Frequencies.* All shingles are counted by class. A class can only link if at
   least ``percent`` of its shingles occur in another class; the rest is done.
2. *Prefixes.* Among the classes left, shingles are counted exactly, and each
   class orders its own from the rarest to the most frequent. Linked sets share
   a shingle of their prefixes (all but ceil(percent * size) - 1 of the set).
   Prefix shingles that a single class has are dropped.
3. *Candidates.* Classes with a common prefix shingle are joined if their
   lengths and positions allow enough overlap: all pairs of a small group are
   tried, but only a spanning forest of them is sent on; large groups are
   joined as chains of length-compatible neighbours. Either way a group of
   copies sends as many edges as it has members, not as many as it has pairs.
   Candidates that hang together form a block.
4. *Verification.* Each class's set is sent to its block once. There an index of
   rare-first prefixes, the filters on length and position, and a bound on
   the overlap of parts of the sets (suffix filter) leave few pairs, which are
   verified on the whole sets, each once; pairs that are connected already are
   skipped. A block of more than ``block_rows`` classes is split into tiles,
   and every two tiles meet in a task of their own.

Scale: steps 1 and 2 move packed hashes (4 and 8 bytes), the text is read, not
shuffled; only classes that may link are written with their sets. Nothing
unbounded reaches the driver, and no group is expanded into all its pairs.

Defined cases: a null text has no words. Null ids are kept, and rows with equal
ids are documents of their own that share the id. Other columns aren't read.
64-bit hashes stand for shingles and sets; words and windows are hashed
non-linearly, so that only chance makes two alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import packed as P, words as W
from .components import components
from .shared import cut, free_name, small_batches

SHINGLE, PERCENT = 5, 75
BLOCK_ROWS = 3000
#: Groups of at most so many classes are joined pair by pair before a spanning forest is sent.
SMALL_GROUP = 48
#: Parts of the hash range whose sizes bound an overlap.
PARTS = 32
#: Bits of the filter of classes that may link (a fixed size; more classes only let more through).
FILTER_BITS = 1 << 25

_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def set_key(s: np.ndarray) -> int:
    """Name of a set: a hash of its sorted shingles."""
    return int(W.list_hashes(s, np.array([0, len(s)]))[0].view(np.int64)) if len(s) else 0


def least_overlap(size: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of this size shares at least with any set that it links to."""
    return -(-size * percent // 100)


def prefix_length(size: np.ndarray | int, percent: int = PERCENT):
    return size - least_overlap(size, percent) + 1


def pair_overlap(a, b, percent: int = PERCENT):
    """Shingles that two sets of these sizes share at least if they link."""
    return -(-(a + b) * percent // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        col = batch.column(1)
        for a, b, data, offsets in W.slices(col):
            yield batch.slice(a, b - a), W.shingles(W.split_words(data, offsets), n)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (W.mix(h ^ _SALT) >> np.uint64(33)).astype(np.int64) % n


def classes(texts: DataFrame, n: int) -> DataFrame:
    """Per document: id, n_shingles, class, and how many shingles share their last 32 bits with another of the set."""
    id_type = texts.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) - len(np.unique(s.astype(np.uint32))) for s in sets], pa.int64())], ["id", "n_shingles", "class", "alike"])

    return texts.mapInArrow(run, f"id {id_type.simpleString()}, n_shingles long, class long, alike long")


def _filter_spots(keys: np.ndarray, bits: int) -> np.ndarray:
    x = W.mix(keys.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return np.stack([(x % np.uint64(bits)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)])


def shared_counts(texts: DataFrame, n: int) -> DataFrame:
    """Packed (class, how many of its shingles at least one other class has, in one bucket of shingles) by groups of classes."""
    buckets = P.buckets(texts.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, hashes, held, seen = [], [], 0, set()

        def rows() -> pa.RecordBatch:
            o, h = np.concatenate(owners), np.concatenate(hashes)
            return P.batch_of(list(P.deal(_bucket(h, buckets), buckets, o, (h & np.uint64(0xFFFFFFFF)).astype("<u4"), P.pack_small)))

        for _, sets in _sets(batches, n):
            for s in sets:
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    owners.append(np.full(len(s), key))
                    hashes.append(s)
                    held += len(s)
            if held >= P.FLUSH:
                yield rows()
                owners, hashes, held, seen = [], [], 0, set()
        if held:
            yield rows()

    def receive(table: pa.Table) -> pa.Table:
        owner, low = P.unpack_all(table["packed"], "<u4", P.unpack_small)
        order = np.lexsort((owner, low))
        owner, low = owner[order], low[order]
        new = P.starts(low)
        ends = np.concatenate([new[1:], [len(low)]])
        several = np.repeat(owner[new] != owner[ends - 1], ends - new)
        first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])]) if len(low) else several
        keys, counts = np.unique(owner[several & first], return_counts=True)
        return pa.Table.from_batches([P.batch_of(list(P.deal(P.group_of(keys, buckets), buckets, keys, counts.astype("<u4"), P.pack_small)))])

    return texts.mapInArrow(send, P.PACKED).groupBy("bucket").applyInArrow(receive, P.PACKED)


def _sum_counts(table: pa.Table) -> pa.Table:
    owner, n = P.unpack_all(table["packed"], "<u4", P.unpack_small)
    keys, at = np.unique(owner, return_inverse=True)
    return pa.table({"class": keys, "shared": np.bincount(at, n, len(keys)).astype(np.int64)})


def linkable(texts: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Classes of which enough shingles occur elsewhere: class, n_shingles and one id that has it."""
    counts = shared_counts(texts, n).groupBy("bucket").applyInArrow(_sum_counts, "class long, shared long")
    known = sets.filter("n_shingles > 0").groupBy("class").agg(F.max("n_shingles").alias("n_shingles"), F.max("alike").alias("alike"))
    return counts.join(known, "class").filter((F.col("shared") + F.col("alike")) * 100 >= F.col("n_shingles") * percent).select("class")


def members(texts: DataFrame, wanted: DataFrame, n: int, bits: int) -> DataFrame:
    """class, n_shingles, shingles (packed, sorted) of each wanted class once."""
    spark = texts.sparkSession

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(bits, bool)
        for b in batches:
            mask[_filter_spots(b.column(0).to_numpy(), bits).ravel()] = True
        parts = np.packbits(mask, bitorder="little").reshape(64, -1)
        yield P.batch_of([(k, p.tobytes()) for k, p in enumerate(parts) if p.any()])

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"][:1], "packed": pa.array([np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table["packed"]]).tobytes()], pa.binary())})

    got = {r["bucket"]: bytes(r["packed"]) for r in wanted.mapInArrow(spots, P.PACKED).groupBy("bucket").applyInArrow(merged, P.PACKED).collect()}
    shared = spark.sparkContext.broadcast(b"".join(got.get(k, bytes(bits // 8 // 64)) for k in range(64)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = np.frombuffer(shared.value, np.uint8), set()
        for _, sets in _sets(batches, n):
            keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.int64)
            a, b = _filter_spots(keys, bits)
            keep = (mask[a >> 3] >> (a & 7) & mask[b >> 3] >> (b & 7) & 1).astype(bool)
            own = []
            for k in np.flatnonzero(keep).tolist():
                if len(sets[k]) and int(keys[k]) not in seen:
                    seen.add(int(keys[k]))
                    own.append(k)
            if len(seen) > 1 << 18:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array([len(sets[k]) for k in own], pa.int64()), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["class", "n_shingles", "shingles"])

    found = texts.mapInArrow(pick, "class long, n_shingles long, shingles binary")
    return found.join(wanted, "class", "left_semi").dropDuplicates(["class"])


def _unpacked_sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]


def candidate_edges(kept: DataFrame, percent: int) -> DataFrame:
    """kept: class, n_shingles, shingles. Edges a, b that connect all classes that may link."""
    buckets = P.buckets(kept.sparkSession)
    groups = buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
            if sets:
                owner = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
                h = np.concatenate(sets)
                yield P.batch_of(list(P.deal(_bucket(h, buckets), buckets, owner, h)))

    def count(table: pa.Table) -> pa.Table:
        owner, h = P.unpack_all(table["packed"], "<u8")
        order = np.argsort(h, kind="stable")
        owner, h = owner[order], h[order]
        new = P.starts(h)
        df = np.repeat(np.diff(np.concatenate([new, [len(h)]])), np.diff(np.concatenate([new, [len(h)]])))
        several = df > 1
        value = np.zeros(int(several.sum()), np.dtype([("h", "<u8"), ("df", "<u4")]))
        value["h"], value["df"] = h[several], df[several]
        own = owner[several]
        return pa.Table.from_batches([P.batch_of(list(P.deal(P.group_of(own, groups), groups, own, value)))])

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        """Prefix shingles that several classes have, with size and position, by buckets of shingles."""
        owner, value = P.unpack_all(right["packed"], np.dtype([("h", "<u8"), ("df", "<u4")]))
        size = dict(zip(left["class"].to_pylist(), left["n_shingles"].to_pylist(), strict=True))
        order = np.lexsort((value["h"], value["df"], owner))
        owner, value = owner[order], value[order]
        new = P.starts(owner)
        lens = np.diff(np.concatenate([new, [len(owner)]]))
        n = np.repeat(np.array([size[k] for k in owner[new].tolist()], np.int64), lens)
        # shingles of this class alone come first in its order
        place = np.arange(len(owner)) - np.repeat(new, lens) + (n - np.repeat(lens, lens))
        keep = place < prefix_length(n, percent)
        out = np.zeros(int(keep.sum()), np.dtype([("h", "<u8"), ("n", "<u4"), ("at", "<u4")]))
        out["h"], out["n"], out["at"] = value["h"][keep], n[keep], place[keep]
        return pa.Table.from_batches([P.batch_of(list(P.deal(_bucket(out["h"], buckets), buckets, owner[keep], out)))])

    def join(table: pa.Table) -> pa.Table:
        owner, v = P.unpack_all(table["packed"], np.dtype([("h", "<u8"), ("n", "<u4"), ("at", "<u4")]))
        order = np.lexsort((owner, v["n"], v["h"]))
        owner, h, n, at = owner[order], v["h"][order], v["n"][order].astype(np.int64), v["at"][order].astype(np.int64)
        new = P.starts(h)
        ends = np.concatenate([new[1:], [len(h)]])
        a, b = [], []
        for s, e in zip(new[ends - new > 1].tolist(), ends[ends - new > 1].tolist(), strict=True):
            if e - s > SMALL_GROUP:  # sorted by size: neighbours that are too far apart in size separate all others
                ok = np.flatnonzero(n[s : e - 1] * 100 >= n[s + 1 : e] * percent) + s
                a.append(owner[ok])
                b.append(owner[ok + 1])
                continue
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
            room = 1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1)
            ok = (n[i] * 100 >= n[j] * percent) & (room >= pair_overlap(n[i], n[j], percent))
            for x, y in _forest(i[ok] - s, j[ok] - s, e - s):
                a.append(owner[[s + x]])
                b.append(owner[[s + y]])
        if not a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    counted = kept.mapInArrow(send, P.PACKED).groupBy("bucket").applyInArrow(count, P.PACKED)
    left = kept.select("class", "n_shingles", P.group_column(F.col("class"), groups).alias("bucket"))
    posted = left.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(prefixes, P.PACKED)
    return posted.groupBy("bucket").applyInArrow(join, "a long, b long").distinct()


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            up[b] = a
            out.append((x, y))
    return out


def links(sets: list[np.ndarray], percent: int = PERCENT, tile: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets. tile: of two tiles, only pairs across them count."""
    order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])), np.int64)
    sets = [sets[k] for k in order.tolist()]
    size = np.array([len(s) for s in sets], np.int64)
    if not len(sets):
        return []
    flat = np.concatenate(sets)
    _, back, df = np.unique(flat, return_inverse=True, return_counts=True)
    own = df[back]
    ptr = np.concatenate([[0], np.cumsum(size)])
    part = np.stack([np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=PARTS) for s in sets])
    side = tile[order] if tile is not None else None
    label = np.arange(len(sets))
    index: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int]] = []
    for i, s in enumerate(sets):
        n = int(size[i])
        rank = np.lexsort((s, own[ptr[i] : ptr[i + 1]]))[: int(prefix_length(n, percent))]
        common = own[ptr[i] : ptr[i + 1]][rank] > 1
        found: dict[int, int] = {}
        for place, h in zip(np.flatnonzero(common).tolist(), s[rank][common].tolist(), strict=True):
            held = index.setdefault(h, [])
            for j, other in held:
                if j not in found and size[j] * 100 >= n * percent:
                    # the first common shingle: no more can follow than what is left of either set
                    found[j] = 1 + min(n - place, int(size[j]) - other) - 1
            held.append((i, place))
        if not found:
            continue
        near = np.fromiter(found, np.int64, len(found))
        need = pair_overlap(n, size[near], percent)
        ok = (np.fromiter(found.values(), np.int64, len(found)) >= need) & (label[near] != label[i])
        if side is not None:
            ok &= side[near] != side[i]
        near, need = near[ok], need[ok]
        ok = np.abs(part[near] - part[i]).sum(1) <= n + size[near] - 2 * need
        for j, least in zip(near[ok].tolist(), need[ok].tolist(), strict=True):
            if label[j] == label[i]:
                continue
            t = sets[j]
            at = np.searchsorted(s, t)
            at[at == n] = 0
            both = int((s[at] == t).sum())
            if both >= least:
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _verified(kept: DataFrame, blocks: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Edges a, b of verified links within blocks. blocks: node, component."""
    counts = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    b = blocks.join(counts, "component").select(F.col("node").alias("class"), F.col("component").alias("block"), F.ceil(F.col("rows") / block_rows).cast("int").alias("tiles"))
    d = kept.select("class", "shingles").join(b, "class")
    # each tile meets itself and every other: (low tile, high tile)
    own = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    d = d.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def verify(table: pa.Table) -> pa.Table:
        keys, sets = table["class"].to_numpy(), _unpacked_sets(table)
        tile = table["own"].to_numpy() if table["low"][0].as_py() != table["high"][0].as_py() else None
        found = np.array(links(sets, percent, tile), np.int64).reshape(-1, 2)
        return pa.table({"a": keys[found[:, 0]], "b": keys[found[:, 1]]})

    return d.select("class", "shingles", "block", "own", "low", "high").groupBy("block", "low", "high").applyInArrow(verify, "a long, b long")


def _linked(texts: DataFrame, sets: DataFrame, shingle: int, percent: int, block_rows: int, filter_bits: int) -> DataFrame:
    """class, component of all classes that link to another; a component is named by one of its classes."""
    wanted = cut(linkable(texts, sets, shingle, percent), "linkable")
    kept = cut(members(texts, wanted, shingle, filter_bits), "members")
    blocks = components(candidate_edges(kept, percent))
    return components(_verified(kept, blocks, percent, block_rows)).withColumnRenamed("node", "class")


def _first(sets: DataFrame, found: DataFrame, least: Column) -> DataFrame:
    """class, first: the least value in each class's component. Values are compared within classes, then within components, so that neither a class nor a component is gathered; joins have nothing above them that would keep a hot key in one task."""
    own = cut(sets.filter("n_shingles > 0").groupBy("class").agg(F.min(least).alias("first")), "firsts")
    named = own.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_component = named.groupBy("component").agg(F.min("first").alias("all_first"))
    return named.join(of_component, "component").select("class", F.col("all_first").alias("first"))


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id that links reach)."""
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = cut(classes(texts, shingle), "classes")
    found = _linked(texts, sets, shingle, percent, block_rows, filter_bits)
    first = cut(_first(sets, found, F.col("id")), "components")
    words = F.col("n_shingles") > 0
    out = sets.filter(words).join(first, "class").select("id", "n_shingles", F.col("first").alias("component_id"))
    out = out.unionByName(sets.filter(~words).select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with one row of each component: the one with the smallest id (nulls last), and of several with that id one.

    Rows are numbered in a table of the shared folder, so rows that repeat, or
    share an id, are told apart. Rows without words all stay.
    """
    row = free_name(docs, "_row")
    rows = cut(small_batches(docs).withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = cut(classes(texts, shingle), "classes")
    first = cut(_first(sets, _linked(texts, sets, shingle, percent, block_rows, filter_bits), F.col("id")), "components")
    later = sets.join(first, "class").filter(F.col("id.row") != F.col("first.row")).select(F.col("id.row").alias(row))
    return rows.join(later, row, "left_anti").select(*docs.columns)
