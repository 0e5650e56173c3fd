"""LM scoring with a hierarchical Pitman-Yor model.

A text is its tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one
end. A token is drawn from the restaurant of the word before it (a text's first
from that of starts); all these restaurants share one parent, the restaurant of
tokens without context, whose base is uniform over the training vocabulary and
one unknown word. The tables of the context restaurants are the customers of the
parent. ``score`` is log10 of the averaged predictive probabilities, summed; over
the vocabulary and the unknown word they add up to 1 in every context.

Seating is sampled by Gibbs: customers are taken from their tables and seated
again, given everybody else's. In each of ``ROUNDS`` rounds the parent is seated
with the tables of the context restaurants as its customers and tells its
probabilities, under which the context restaurants are seated or, in the last
round, tokens get theirs. Probabilities average over ``SAMPLES`` sweeps of the parent and of the contexts. Strength and
discount of the context restaurants are those of a grid under which the seating
at a round's start is likeliest; the parent's discount is estimated from its
tokens with one and two customers.

Scale. A cell is a context and a token that follows it. Cells are dealt by the
hash of both, so that a common word is dealt over all buckets, and a task sends
each kind once for every ``FLUSH`` tokens. A bucket asks others for the totals of
its contexts and for its tokens' probabilities: one entry for each that it has, in
one message for each two buckets. Buckets are as many as the texts need
(``BUCKET_BYTES``), however many partitions a session's shuffles have.
For scoring, a task sends each kind of cell that a run of documents has once, gets
probability and count back, and adds up its documents; documents are scored in
``BLOCKS`` blocks, one after another, which bounds what shuffles hold at once.
Everything gathered grows with the corpus, none of it in one task; the driver
gets a few sums for each bucket. Words and cells are known by 64-bit hashes.

Defined cases: a null or empty text has the end token alone. Rows with equal ids
count as documents of their own; equal rows get equal scores. A null id is in
training as the text "" would be. With an empty training set all tokens are
unknown. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import packed as P, words as W
from .seating import Seats
from .shared import cut, drop, small_batches
from .squeezed import expand, narrow, squeeze

ROUNDS, SAMPLES = 2, 2
STRENGTH = 1.0
#: Strength and discount under which customers are seated first, before they are estimated.
FIRST, DISCOUNT = 256.0, 0.75
#: Strengths and discounts that context restaurants may have.
STRENGTHS, DISCOUNTS = 2.0 ** np.arange(-1, 11), np.arange(0.05, 1, 0.1)
FLUSH = 1 << 21
BLOCKS = 3
#: Bytes of text for each bucket of cells; few texts have ``LEAST_BUCKETS``.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 23, 8
#: Stand for a text's end and for what precedes its first word.
END, START = np.uint64(1), np.uint64(2)
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
_CONTEXT = np.uint64(0x4F1BBCDCBFA53E0B)


def in_training(ids: pa.Array, folds: int, held_out: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % folds != held_out for i in ids.to_pylist()], bool)


def buckets(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(min(LEAST_BUCKETS, P.buckets(texts.sparkSession)), -(-size // BUCKET_BYTES))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (W.mix(h ^ _SALT) >> np.uint64(33)).astype(np.int64) % n


def _by_bucket(bucket: np.ndarray, n: int) -> np.ndarray:
    """The stable order of n buckets: numpy sorts 16 bits by counting."""
    return np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")


def _edges(bucket: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the sorted buckets that have any."""
    edge = np.searchsorted(bucket, np.arange(n + 1))
    for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        yield k, int(edge[k]), int(edge[k + 1])


def tokens(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens, ends included: the document, the token before, the token."""
    lens = np.diff(w.ptr)
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    own = np.full(at[-1], END)
    first = np.repeat(at[:-1] - (w.ptr[:-1] - w.ptr[0]), lens)
    own[first + np.arange(len(first))] = w.hash[w.ptr[0] : w.ptr[-1]]
    before = np.full(at[-1], START)
    before[1:] = own[:-1]
    before[at[:-1]] = START
    return np.repeat(np.arange(len(lens)), lens + 1), before, own


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each kind of key first stands, in the keys' order, and its sum of n."""
    order = np.argsort(key)
    at = P.starts(key[order])
    return order[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


@dataclass
class Cells:
    """Cells of a bucket, by context: the contexts and tokens that it has, and of each cell its places in them, customers, tables, and these summed over the last round's samples; of cells with several customers the tables' sizes."""

    contexts: np.ndarray
    context: np.ndarray
    words: np.ndarray
    word: np.ndarray
    n: np.ndarray
    t: np.ndarray
    sampled: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(blob: bytes) -> Cells:
        a = expand(blob)
        n = a[4].astype(np.int64)
        t, sampled = np.minimum(n, 1), SAMPLES * np.minimum(n, 1)
        t[n > 1], sampled[n > 1] = a[5], a[6]
        return Cells(a[0], a[1].astype(np.int64), a[2], a[3].astype(np.int64), n, t, sampled, a[7].astype(np.int64))

    def blob(self) -> bytes:
        return squeeze(self.contexts, self.context.astype(np.int32), self.words, self.word.astype(np.int32), narrow(self.n), narrow(self.t[self.n > 1]), narrow(self.sampled[self.n > 1]), narrow(self.sizes))

    def seats(self) -> tuple[np.ndarray, Seats]:
        several = np.flatnonzero(self.n > 1)
        return several, Seats(self.n[several], self.t[several], self.sizes)

    def take(self, several: np.ndarray, seats: Seats, sampled: np.ndarray) -> None:
        self.t[several], self.sampled[several], self.sizes = seats.t, sampled, seats.sizes()


def _rng(*what: int) -> np.random.Generator:
    return np.random.default_rng([17, *what])


def count_cells(texts: DataFrame, n: int, folds: int, held_out: int) -> DataFrame:
    """Cells of all documents with their training customers, seated: bucket, packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            v, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            first, c = _summed(W.fold(v, w), c)
            v, w = v[first], w[first]
            bucket = _bucket(W.fold(v, w), n)
            order = np.argsort(v)
            order = order[_by_bucket(bucket[order], n)]
            v, w, c = v[order], w[order], c[order]
            out = []
            for k, a, b in _edges(bucket[order], n):
                words, word = np.unique(w[a:b], return_inverse=True)
                out.append((k, squeeze(v[a:b], words, word.astype(np.int32), narrow(c[a:b]))))
            return P.batch_of(out)

        for batch in batches:
            train = in_training(batch.column(0), folds, held_out)
            for a, b, data, offsets in W.slices(batch.column(1)):
                doc, v, w = tokens(W.split_words(data, offsets))
                held.append((v, w, train[a:b][doc].astype(np.int64)))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield rows()
        if held:
            yield rows()

    def receive(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        v, w, c = (np.concatenate(x) for x in zip(*((v, words[word], c) for v, words, word, c in (expand(x.as_py()) for x in table["packed"])), strict=True))
        first, c = _summed(W.fold(v, w), c.astype(np.int64))
        v, w = v[first], w[first]
        order = np.lexsort((w, v))
        contexts, context = np.unique(v[order], return_inverse=True)
        words, word = np.unique(w[order], return_inverse=True)
        one = np.minimum(c[order], 1)
        cells = Cells(contexts, context, words, word, c[order], one, SAMPLES * one, np.empty(0, np.int64))
        several = np.flatnonzero(cells.n > 1)
        # nobody knows totals yet: the bucket's own stand for them
        own = np.bincount(word, cells.n, len(words)) / max(1, int(c.sum()))
        opened = np.bincount(context, cells.t, len(contexts))
        seats = Seats.first(cells.n[several], (FIRST + DISCOUNT * opened[context[several]]) * own[word[several]], DISCOUNT, _rng(0, bucket))
        cells.take(several, seats, SAMPLES * seats.t)
        return pa.Table.from_batches([P.batch_of([(bucket, cells.blob())])])

    return texts.mapInArrow(send, P.PACKED).groupBy("bucket").applyInArrow(receive, P.PACKED)


def _added(packed: DataFrame, of_row: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The sum of what of_row makes of each row: a few numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                yield P.batch_of([(0, of_row(x.as_py()).astype("<f8").tobytes())])

    return reduce(lambda a, b: a + b, (np.frombuffer(r["packed"], "<f8") for r in packed.select("bucket", "packed").mapInArrow(run, P.PACKED).toLocalIterator()), np.zeros(1))


def _discount(once: float, twice: float) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1


def _asked(keys: np.ndarray, salt: np.uint64 | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a bucket of cells asks for its keys, and where each bucket's begin."""
    bucket = _bucket(keys if salt is None else keys ^ salt, n)
    order = _by_bucket(bucket, n)
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def totals(cells: DataFrame, n: int) -> DataFrame:
    """By buckets of contexts and tokens: keys, customers, tables (of tokens now, of contexts over the samples), and who asked for which; tokens first."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Cells.of(blob.as_py())
                asked = []
                for keys, at, tables, salt in ((c.words, c.word, c.t, None), (c.contexts, c.context, c.sampled, _CONTEXT)):
                    order, edge = _asked(keys, salt, n)
                    asked.append((edge, [keys[order], *(np.bincount(at, x, len(keys)).astype(np.int64)[order] for x in (c.n, tables))]))
                rows = []
                for k in range(n):
                    parts = [x[edge[k] : edge[k + 1]] for edge, arrays in asked for x in arrays]
                    if len(parts[0]) or len(parts[3]):
                        rows.append((k, squeeze(np.array([own], np.int64), *(x if x.dtype == np.uint64 else narrow(x) for x in parts))))
                yield P.batch_of(rows)

    def receive(table: pa.Table) -> pa.Table:
        asked = sorted((expand(x.as_py()) for x in table["packed"]), key=lambda x: int(x[0][0]))
        owners, out = np.array([int(x[0][0]) for x in asked], np.int32), []
        for k in (1, 4):
            keys, at = np.unique(np.concatenate([x[k] for x in asked]), return_inverse=True)
            sums = [np.bincount(at, np.concatenate([x[j] for x in asked]), len(keys)).astype(np.int64) for j in (k + 1, k + 2)]
            out += [keys, narrow(sums[0]), narrow(sums[1]), owners, narrow(np.array([len(x[k]) for x in asked], np.int64)), at.astype(np.int32)]
        return pa.Table.from_batches([P.batch_of([(table["bucket"][0].as_py(), squeeze(*out))])])

    return cells.mapInArrow(ask, P.PACKED).groupBy("bucket").applyInArrow(receive, P.PACKED)


@dataclass
class Parent:
    """The restaurant without context: training tokens and vocabulary, customers, tables, discount."""

    tokens: int
    vocabulary: int
    customers: int
    discount: float
    #: Tables under which seats are drawn, and those that this gives.
    drawn: float
    tables: float
    #: The sums, each with its tokens' tables as a last array. Stays with the driver.
    seated: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seated": None}

    def tables_of(self, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Tables of a bucket's tokens with c customers, summed over the samples."""
        base = 1 / (self.vocabulary + 1)
        rng = _rng(1, int(keys[0]) if len(keys) else 0)
        strength = np.full(len(c), (STRENGTH + self.discount * self.drawn) * base)
        several = np.flatnonzero(c > 1)
        seats = Seats.first(c[several], strength[several], self.discount, rng)
        t = SAMPLES * np.minimum(c, 1).astype(np.int64)
        t[several] = 0
        for _ in range(SAMPLES):
            seats.sweep(strength[several], self.discount, rng)
            t[several] += seats.t
        return t

    def probabilities(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Averaged over the samples, whose tables t are summed."""
        base = 1 / (self.vocabulary + 1)
        return (c - self.discount * t / SAMPLES + (STRENGTH + self.discount * self.tables) * base) / (self.customers + STRENGTH)


def seat_parent(sums: DataFrame, before: Parent | None) -> Parent:
    """Seated under the tables of the round before, or one for each token."""

    def first(blob: bytes) -> np.ndarray:
        n, c = expand(blob, slice(1, 3))
        return np.array([n.sum(), (n > 0).sum(), c.sum(), (c == 1).sum(), (c == 2).sum()])

    tokens_, kinds, customers, once, twice = np.resize(_added(sums, first), 5)
    parent = Parent(int(tokens_), int(kinds), int(customers), _discount(once, twice), before.tables if before else float(kinds), 0.0)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = expand(x.as_py())
                yield P.batch_of([(k, squeeze(*a, narrow(parent.tables_of(a[0], a[2]))))])

    parent.seated = cut(sums.mapInArrow(seat, P.PACKED), "seated")
    parent.tables = float(_added(parent.seated, lambda x: np.array([expand(x, slice(-1, None))[0].sum() / SAMPLES]))[0])
    return parent


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight places on."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - sum(np.log(x + k) for k in range(8))


def _log_likelihood_of_contexts(blob: bytes) -> np.ndarray:
    """For each strength and discount, of opening so many tables for so many customers."""
    n, t = expand(blob, slice(7, 9))
    customers, of_customers = np.unique(n[n > 0].astype(np.float64), return_counts=True)
    tables, of_tables = np.unique(np.rint(t[n > 0] / SAMPLES), return_counts=True)
    out = np.zeros((len(STRENGTHS), len(DISCOUNTS)))
    for i, theta in enumerate(STRENGTHS.tolist()):
        out[i] = -((_log_gamma(theta + customers) - _log_gamma(np.array(theta + 1))) * of_customers).sum()
        for j, d in enumerate(DISCOUNTS.tolist()):
            out[i, j] += (((tables - 1) * np.log(d) + _log_gamma(theta / d + tables) - _log_gamma(np.array(theta / d + 1))) * of_tables).sum()
    return out.ravel()


def _log_likelihood_of_tables(blob: bytes) -> np.ndarray:
    """For each strength and discount, of the tables' sizes."""
    sizes, times = np.unique(expand(blob, slice(7, 8))[0].astype(np.int64), return_counts=True)
    of_d = np.array([((_log_gamma(sizes - d) - _log_gamma(np.array(1 - d))) * times).sum() for d in DISCOUNTS.tolist()])
    return np.tile(of_d, len(STRENGTHS))


def likeliest(cells: DataFrame, sums: DataFrame) -> tuple[float, float]:
    """Strength and discount of the context restaurants."""
    both = np.resize(_added(sums, _log_likelihood_of_contexts), len(STRENGTHS) * len(DISCOUNTS)) + np.resize(_added(cells, _log_likelihood_of_tables), len(STRENGTHS) * len(DISCOUNTS))
    i, j = divmod(int(both.argmax()), len(DISCOUNTS))
    return float(STRENGTHS[i]), float(DISCOUNTS[j])


def replies(sums: DataFrame, parent: Parent) -> DataFrame:
    """To each bucket of cells, of the keys that it asked for, in its order: tokens' counts and probabilities, contexts' customers and tables. Tokens are seated only where sums don't have their tables."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = expand(x.as_py())
                t = a[12].astype(np.int64) if len(a) > 12 else parent.tables_of(a[0], a[2])
                p = parent.probabilities(a[2], t).astype(np.float32)
                of_words, of_contexts = (np.split(at, np.cumsum(lens)[:-1]) for lens, at in (a[4:6], a[10:12]))
                yield P.batch_of([(own, squeeze(np.array([k], np.int64), a[1][i], p[i], a[7][j], a[8][j])) for own, i, j in zip(a[3].tolist(), of_words, of_contexts, strict=True)])

    return sums.mapInArrow(reply, P.PACKED)


def _kinds(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, each with the place of its frame."""
    return reduce(DataFrame.unionAll, [f.select("bucket", F.lit(k).alias("kind"), "packed") for k, f in enumerate(frames)])


def _of_kind(table: pa.Table, kind: int) -> list[bytes]:
    return [x.as_py() for x in table["packed"].filter(pa.array(table["kind"].to_numpy() == kind))]


def seat_cells(cells: DataFrame, told: DataFrame, n: int, theta: float, discount: float, round_: int, last: bool) -> DataFrame:
    """Cells seated anew under what they were told; in the last round instead their hashes, log10 of averaged probabilities and tokens' counts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        c = Cells.of(_of_kind(table, 0)[0])
        heard = sorted((expand(x) for x in _of_kind(table, 1)), key=lambda x: int(x[0][0]))
        of = []
        for keys, salt, at in ((c.words, None, 1), (c.contexts, _CONTEXT, 3)):
            order, _ = _asked(keys, salt, n)
            for k, kind in ((at, np.int64), (at + 1, np.float64)):
                of.append(np.empty(len(keys), kind))
                of[-1][order] = np.concatenate([x[k] for x in heard])
        count, p, customers, tables = of
        v, w = c.context, c.word
        tables = tables / SAMPLES
        if last:
            p = (c.n - discount * c.sampled / SAMPLES + (theta + discount * tables[v]) * p[w]) / (customers[v] + theta)
            key = W.fold(c.contexts[v], c.words[w])
            order = np.argsort(key)
            return pa.Table.from_batches([P.batch_of([(bucket, squeeze(key[order], np.log10(p[order]).astype(np.float32), narrow(count[w][order])))])])
        rng = _rng(2 + round_, bucket)
        several, seats = c.seats()
        sampled = np.zeros(len(several), np.int64)
        for _ in range(SAMPLES):
            seats.sweep((theta + discount * tables[v[several]]) * p[w[several]], discount, rng)
            sampled += seats.t
        c.take(several, seats, sampled)
        return pa.Table.from_batches([P.batch_of([(bucket, c.blob())])])

    return _kinds(cells, told).groupBy("bucket").applyInArrow(run, P.PACKED)


@dataclass
class Model:
    """By buckets of cells: their hashes, log10 probabilities and tokens' training counts."""

    cells: DataFrame
    buckets: int
    parent: Parent


def fit(texts: DataFrame, folds: int, held_out: int) -> Model:
    """texts: id, text."""
    n = buckets(texts)
    cells = cut(count_cells(texts, n, folds, held_out), "cells")

    parent = None
    for k in range(ROUNDS):
        sums = cut(totals(cells, n), "totals")
        parent = seat_parent(sums, parent)
        drop(sums)
        new = cut(seat_cells(cells, replies(parent.seated, parent), n, *likeliest(cells, parent.seated), k, k == ROUNDS - 1), "cells")
        drop(cells)
        drop(parent.seated)
        cells = new
    return Model(cells, n, parent)


_CHUNK = "bucket long, chunk long, packed binary, ids array<{0}>, lens array<long>, held array<boolean>"


def _chunks(texts: DataFrame, n: int, folds: int, held_out: int, id_type: str) -> DataFrame:
    """Runs of documents: by buckets the cells that they ask for; and, as bucket -1, each token's place among these."""
    schema = _CHUNK.format(id_type)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        keys, lens, ids, held, size = [], [], [], [], 0

        def rows() -> pa.RecordBatch:
            kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
            bucket = _bucket(kinds, n)
            order = _by_bucket(bucket, n)
            rank = np.empty(len(kinds), np.int32)
            rank[order] = np.arange(len(kinds))
            kinds = kinds[order]
            out = [(k, squeeze(kinds[a:b])) for k, a, b in _edges(bucket[order], n)]
            none = [None] * len(out)
            own = pa.concat_arrays(ids)
            columns = [
                pa.array([*(k for k, _ in out), -1], pa.int64()),
                pa.array([chunk] * (len(out) + 1), pa.int64()),
                pa.array([*(x for _, x in out), squeeze(rank[place])], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0] * (len(out) + 1) + [len(own)], pa.int32()), own),
                pa.array([*none, np.concatenate(lens).tolist()], pa.list_(pa.int64())),
                pa.array([*none, np.concatenate(held).tolist()], pa.list_(pa.bool_())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "packed", "ids", "lens", "held"])

        for batch in batches:
            train = in_training(batch.column(0), folds, held_out)
            for a, b, data, offsets in W.slices(batch.column(1)):
                w = W.split_words(data, offsets)
                _, before, own = tokens(w)
                keys.append(W.fold(before, own))
                lens.append(np.diff(w.ptr) + 1)
                ids.append(batch.column(0).slice(a, b - a))
                held.append(~train[a:b])
                size += len(own)
                if size >= FLUSH:
                    yield rows()
                    chunk += 1
                    keys, lens, ids, held, size = [], [], [], [], 0
        if keys:
            yield rows()

    return texts.mapInArrow(send, schema)


def score_with(model: Model, texts: DataFrame, folds: int, held_out: int) -> tuple[DataFrame, DataFrame]:
    """Per row of texts (whose cells the model has): id, held_out, n_tokens, n_known, base (sum of log10(count + 1)), score; and a table to drop when these are read."""
    id_type = texts.schema["id"].dataType.simpleString()
    schema = _CHUNK.format(id_type)
    chunks = cut(_chunks(texts, model.buckets, folds, held_out, id_type), "chunks")
    asked = chunks.filter("bucket >= 0").select("bucket", "chunk", "packed")
    known = model.cells.select("bucket", F.lit(-1).cast("long").alias("chunk"), "packed")

    def reply(table: pa.Table) -> pa.Table:
        chunk, packed = table["chunk"].to_pylist(), table["packed"]
        key, logp, count = expand(packed[chunk.index(-1)].as_py())
        rows = [(c, packed[k].as_py()) for k, c in enumerate(chunk) if c >= 0]
        out = []
        for _, blob in rows:
            at = np.searchsorted(key, expand(blob)[0])
            out.append(squeeze(logp[at], count[at]))
        return pa.table({"bucket": table["bucket"][: len(out)], "chunk": pa.array([c for c, _ in rows], pa.int64()), "packed": pa.array(out, pa.binary())})

    told = known.unionAll(asked).groupBy("bucket").applyInArrow(reply, "bucket long, chunk long, packed binary")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields[3:]]
    everything = told.select("bucket", "chunk", "packed", *none).unionAll(chunks.filter("bucket = -1"))

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table["bucket"].to_numpy())
        own = int(order[0])
        heard = [expand(table["packed"][int(k)].as_py()) for k in order[1:]]
        place = expand(table["packed"][own].as_py())[0]
        lens = np.array(table["lens"][own].as_py(), np.int64)
        at = np.cumsum(lens) - lens
        logp, count = (np.concatenate([x[k] for x in heard])[place] for k in (0, 1))
        sums = [np.add.reduceat(x, at) for x in (count > 0, np.log10(count + 1.0), logp.astype(np.float64))]
        return pa.table({"id": table["ids"][own].values, "held_out": pa.array(table["held"][own].as_py(), pa.bool_()), "n_tokens": lens, "n_known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2]})

    return everything.groupBy("chunk").applyInArrow(add, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double"), chunks


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = fit(texts, folds, held_out)
    done = []
    for k in range(blocks):
        block = texts.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        found, chunks = score_with(model, block, folds, held_out)
        done.append(cut(found, "scores"))
        drop(chunks)
    drop(model.cells)
    parent = model.parent
    norm = float(np.log10(parent.tokens + parent.vocabulary + 1.0))
    return reduce(DataFrame.unionAll, done).select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(parent.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of a token under the model and under the base, by held_out."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
