"""Toxicity with noisy-channel deobfuscation.

Obfuscated words are restored first. A span counts as suspicious if letters
are mixed with digits or symbols that stand for letters, if a letter is
repeated three times or more, or if single letters follow one another with
spaces or points between. Its characters span a lattice (each may be itself,
the letter that it stands for, a separator that is dropped, or one more
repetition that is dropped) and Viterbi decoding under a character trigram
model finds the most likely word; in a run of more than ``ONE_WORD`` single letters,
or in more than ``ONE_SPAN`` bytes, it finds words. Of such a run all pieces of 3 to
``ONE_WORD`` letters are scored as well, since where its words end is a guess. Spans are decoded whole, however long, in time linear in their length.
The model's units are bytes in 64 classes.

Restored and plain words are then scored: a word, and its first bytes, carry
the shrunken share of toxic documents among the labelled documents that have
them. A document's score is that of its worst word, raised a little by the
next one.

Scale: the classifier is fitted on all labelled training rows, the character
model (at most 64^3 counts) on all documents, but for their suspicious spans. Labels are joined to the
rows that may be in training by a shuffle of both, at any size; counts are added up in each task, for ``FLUSH`` entries at a time, and
again by hash. Scoring maps all documents, whole, with a model of at most
``max_features`` entries.

Defined cases: a null or empty text gets the score of a document without any
known word. Labels without an id or a verdict are ignored; of several verdicts
on an id the highest counts. Repeated rows are scored one by one. Without any
training rows all scores are 0. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import packed as P, words as W
from .shared import free_name, small_batches
from .squeezed import expand, narrow, squeeze

#: Counts of features that a task gathers before it sends them.
FLUSH = 1 << 20
#: Words and word beginnings that the model keeps, at most.
MAX_FEATURES = 50_000
#: First bytes of words that are features of their own.
PREFIXES = (4, 5, 6, 7)
#: Toxic documents that a feature needs, and how many deviations its share is lowered by (Wilson's bound): of many
#: words that few documents have, some stand in toxic ones alone by chance.
MIN_TOXIC, DEVIATIONS = 3, 3.0
#: Share of toxic documents that a word, or the beginning of words, needs among those that have it: what is common in
#: clean text proves nothing, least of all a beginning.
PURE, PURE_PREFIX = 0.88, 0.93
REJECT = 0.3

#: Letters that symbols stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
#: Signs that may stand between the letters of a word, and signs that hide a letter.
BETWEEN = " ._-*~'`^/\\,"
HIDING = "*#%?"
#: Single letters in a row that are taken for one word, at most: longer runs are decoded whole, as words.
ONE_WORD = 24
#: Bytes of a suspicious word that is taken for one word, at most: so are longer ones.
ONE_SPAN = 40

_SEPARATORS = re.compile(f"[{re.escape(BETWEEN)}]+")
_CLASSES = 64
_BYTE_CLASS = np.full(256, 60, np.int64)
_BYTE_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_BYTE_CLASS[0x61:0x7B] = np.arange(1, 27)
_BYTE_CLASS[0x41:0x5B] = np.arange(1, 27)
_BYTE_CLASS[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)
_PREFIX_SALT = np.uint64(0x51A7F3D20C6E9B45)


def trigram_counts(data: np.ndarray) -> np.ndarray:
    c = _BYTE_CLASS[data]
    c = np.concatenate([[0, 0], c, [0]])
    return np.bincount(c[:-2] * _CLASSES * _CLASSES + c[1:-1] * _CLASSES + c[2:], minlength=_CLASSES**3)


class CharModel:
    """Interpolated trigram, bigram and unigram log probabilities over byte classes."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.1) / (c1.sum() + 0.1 * _CLASSES)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.logp = np.log(p3).astype(np.float32)

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.logp[a, b, c])


def decode(span: str, model: CharModel, beam: int = 48, several: bool = False) -> str:
    """The most likely word (with several: words) behind a suspicious span, by Viterbi over its lattice. States are the last two classes."""
    cls = _BYTE_CLASS
    # of each state the cost, and its text as (text before, last piece): linear in the span
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

    def grow(state: tuple[int, int], text: str, cost: float) -> tuple[tuple[int, int], float]:
        a, b = state
        for byte in text.encode("utf-8", "surrogatepass"):
            c = int(cls[byte])
            cost += model.step(a, b, c)
            a, b = b, c
        return (a, b), cost

    last = ""
    for ch in span.lower():
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options.append((ch, -0.05))
            if ch == last:
                options.append(("", -0.7))
        else:
            if ch not in " ":
                options.append((ch, -2.0))
            options += [(x, -1.0) for x in LEET.get(ch, "")]
            if ch in BETWEEN:
                options.append(("", -0.7))
                if several:  # a sign that parts words
                    options.append((" ", -0.7))
            if ch in HIDING:
                options += [(chr(x), -3.0) for x in range(97, 123)]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for state, (cost, text) in states.items():
            for out, price in options:
                to, total = grow(state, out, cost + price)
                if to not in new or total > new[to][0]:
                    new[to] = (total, (text, ch if out == " " else out) if out else text)
        states = dict(sorted(new.items(), key=lambda kv: -kv[1][0])[:beam])
        last = ch
    ends = [(cost + model.step(a, b, 0), text) for (a, b), (cost, text) in states.items()]
    best = max((cost for cost, _ in ends), default=0.0)
    return max((_text(t) for cost, t in ends if cost == best), default=span)


def _text(pieces: tuple | None) -> str:
    out = []
    while pieces is not None:
        pieces, last = pieces
        out.append(last)
    return "".join(reversed(out))


def _flags(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each nonspace word: whether it's suspicious by itself, and whether it is a single letter or stand-in."""
    n = len(w.start)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    data = w.data
    letter = (data >= 0x61) & (data <= 0x7A) | (data >= 0x80)
    stand = np.zeros(256, bool)
    stand[[ord(x) for x in "".join(LEET) + HIDING + "._-~^" if ord(x) < 128]] = True
    other = stand[data]
    # a stand-in with a letter right before or after it
    beside = np.zeros(len(data), bool)
    beside[1:] |= other[1:] & letter[:-1]
    beside[:-1] |= other[:-1] & letter[1:]
    third = np.zeros(len(data), bool)
    third[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 0x80)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([w.start, w.end])], axis=0)[0]
    lens = w.end - w.start
    letters, stands = count(letter), count(other)
    inner = count(beside)
    # points and the like at a word's end are no sign; digits and letters must mix
    tail = other[w.end - 1] & ~(np.isin(data[w.end - 1], [ord(x) for x in "$@0134578"]))
    mixed = (inner - tail > 0) & (letters > 0) & (letters + stands >= 3)
    single = (lens == 1) & (letter[w.start] | other[w.start])
    # letters of several bytes, and stand-ins like the euro sign
    for k in np.flatnonzero((lens > 1) & (count((data & 0xC0) != 0x80) == 1)).tolist():
        ch = data[w.start[k] : w.end[k]].tobytes().decode("utf-8", "replace")
        single[k] = ch.isalpha() or ch in LEET
    return mixed & (stands - tail > 0) | (count(third) > 0), single


def unobscured(w: W.Words) -> np.ndarray:
    """The bytes of the texts, with white space for suspicious spans. w: nonspace words."""
    suspicious, single = _flags(w)
    own = np.zeros(len(single) + 1, bool)
    own[w.ptr[:-1]] = True  # runs don't cross documents
    run = np.cumsum(~single | own[:-1] | np.concatenate([[True], ~single])[:-1])
    out = suspicious | single & (np.bincount(run)[run] >= 3)
    step = np.zeros(len(w.data) + 1, np.int8)
    step[w.start[out]] += 1
    step[w.end[out]] -= 1
    return np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, np.uint8(0x20), w.data)


def restored(w: W.Words, model: CharModel, cache: dict[bytes, bytes]) -> tuple[list[int], list[int], list[bytes]]:
    """(word at which it starts, word before which it ends, restored word or words) of the suspicious spans. w: nonspace words."""
    suspicious, single = _flags(w)
    at: list[int] = []
    upto: list[int] = []
    out: list[bytes] = []

    def look(k: int, e: int, raw: bytes) -> None:
        got = cache.get(raw)
        if got is None:
            got = decode(raw.decode("utf-8", "replace"), model, several=e - k > ONE_WORD or e == k + 1 and len(raw) > ONE_SPAN).encode("utf-8", "surrogatepass")
            if len(cache) < 50_000 and len(raw) <= ONE_SPAN:
                cache[raw] = got
        if got != raw or e - k > ONE_WORD:
            at.append(k)
            upto.append(e)
            out.append(got)

    for k in np.flatnonzero(suspicious).tolist():
        look(k, k + 1, w.data[w.start[k] : w.end[k]].tobytes())
    if single.any():
        own = np.zeros(len(single) + 1, bool)
        own[w.ptr[:-1]] = True  # runs don't cross documents
        begin = single & np.concatenate([[True], ~single[:-1] | own[1:-1]])
        for k in np.flatnonzero(begin).tolist():
            e = k + 1
            while e < len(single) and single[e] and not own[e]:
                e += 1
            if e - k >= 3:
                look(k, e, b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(k, e)))
    return at, upto, out


def restore_text(text: str, model: CharModel) -> str:
    """text with its suspicious spans restored (white space between words as single spaces)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    w = W.split_words(raw, np.array([0, len(raw)]), hashes=False)
    got = {k: (e, word) for k, e, word in zip(*restored(w, model, {}), strict=True)}
    out, k = [], 0
    while k < len(w.start):
        e, word = got.get(k) or (k + 1, raw[w.start[k] : w.end[k]].tobytes())
        out.append(word.decode("utf-8", "replace"))
        k = e
    return " ".join(out)


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of words (even), then of their beginnings (odd); 0 where a word is no longer than the beginning."""
    out = [W.word_hashes(data, start, end) & ~np.uint64(1)]
    for n in PREFIXES:
        long = end - start > n
        h = np.zeros(len(start), np.uint64)
        if long.any():
            h[long] = W.word_hashes(data, start[long], start[long] + n) ^ (_PREFIX_SALT + np.uint64(n)) | np.uint64(1)
        out.append(h)
    return out


def document_features(data: np.ndarray, offsets: np.ndarray, model: CharModel | None, cache: dict[bytes, bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document of each word, features of each word), of plain words and restored ones."""
    w = W.split_words(data, offsets, "alnum", hashes=False)
    doc, features = w.doc_of_word(), _features(w.data, w.start, w.end)
    if model is not None:
        spans = W.split_words(data, offsets, hashes=False)
        at, upto, out = restored(spans, model, cache)
        # where words end in a long run is a guess: all of its pieces count
        for k, e, word in zip(at[:], upto, out[:], strict=True):
            if e - k > ONE_WORD:
                letters = _SEPARATORS.sub("", word.decode("utf-8", "replace"))
                at.append(k)
                out.append(" ".join(letters[i:j] for i in range(len(letters)) for j in range(i + 3, min(i + ONE_WORD, len(letters)) + 1)).encode())
        if out:
            raw = np.frombuffer(b" ".join(out), np.uint8)
            more = W.split_words(raw, np.array([0, len(raw)]), "alnum", hashes=False)
            # a restored span may have several words
            owner = np.repeat(np.arange(len(out)), [len(x) + 1 for x in out])[more.start] if len(more.start) else np.empty(0, np.int64)
            doc = np.concatenate([doc, np.searchsorted(spans.ptr, np.array(at)[owner], "right") - 1])
            features = [np.concatenate(x) for x in zip(features, _features(more.data, more.start, more.end), strict=True)]
    return doc, features


@dataclass
class Model:
    chars: CharModel
    hashes: np.ndarray
    share: np.ndarray
    base: float

    def score(self, data: np.ndarray, offsets: np.ndarray, cache: dict[bytes, bytes]) -> np.ndarray:
        n = len(offsets) - 1
        first, second = np.full(n, self.base), np.zeros(n)
        if not len(self.hashes):
            return first
        doc, features = document_features(data, offsets, self.chars, cache)
        best, own = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
        for h in features:
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            p = np.where(self.hashes[at] == h, self.share[at], 0.0)
            best = np.maximum(best, p)
        own = features[0]
        hits = np.flatnonzero(best > 0)
        if len(hits):
            order = hits[np.lexsort((own[hits], -best[hits], doc[hits]))]
            d, p, h = doc[order], best[order], own[order]
            new = np.concatenate([[True], d[1:] != d[:-1]])
            first[d[new]] = np.maximum(self.base, p[new])
            top = h[new][np.cumsum(new) - 1]
            rest = np.flatnonzero(h != top)
            np.maximum.at(second, d[rest], p[rest])
        return np.clip(1 - (1 - first) * (1 - 0.1 * second), 0.0, 1.0)


def _in_training(id_col: Column, folds: int, held_out: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds != held_out


def _added(h: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, sorted, with the sums of its columns."""
    order = np.argsort(h, kind="stable")
    at = P.starts(h[order])
    return h[order][at], np.add.reduceat(sums[:, order], at, axis=1) if len(at) else sums


def _verdicts(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int) -> DataFrame:
    """id, toxic of the labelled training rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    return known.filter(_in_training(F.col("id"), folds, held_out)).groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))


def _character_model(d: DataFrame) -> CharModel:
    """Counted on all texts of d, but for suspicious spans: it is a model of what these hide."""

    def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.slices(batch.column(0)):
                total += trigram_counts(unobscured(W.split_words(data, offsets, hashes=False)))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    counts = np.zeros(_CLASSES**3, np.int64)
    for r in d.select("text").mapInArrow(chars, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"]] = r["n"]
    return CharModel(counts)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_features: int = MAX_FEATURES, folds: int = 4, held_out: int = 2, min_toxic: int = MIN_TOXIC, deviations: float = DEVIATIONS) -> Model:
    """Learns from all labelled rows whose crc32 of the id modulo ``folds`` isn't ``held_out``."""
    spark = docs.sparkSession
    verdicts = _verdicts(labels, id_col, label_col, folds, held_out)
    n_all, n_toxic = verdicts.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    if not n_toxic:
        return Model(CharModel(np.zeros(_CLASSES**3)), np.empty(0, np.uint64), np.empty(0), 0.0)
    d = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = _character_model(d)
    shared = spark.sparkContext.broadcast(model)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, bytes] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            h, sums = _added(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
            held.clear()
            bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            return P.batch_of([(n, squeeze(h[o], *map(narrow, sums[:, o]))) for n in range(buckets) if len(o := order[edge[n] : edge[n + 1]])])

        for batch in batches:
            own, verdict = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in W.slices(batch.column(1)):
                doc, features = document_features(data, offsets, shared.value, cache)
                h = np.concatenate(features)
                k = np.concatenate([doc] * len(features))
                k, h = k[h != 0], h[h != 0]
                order = np.lexsort((k, h))
                h, k = h[order], k[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]) if len(h) else np.empty(0, bool)
                h, k = h[new], k[new]
                half = own[a:b][k] * 40503 >> 4 & 1
                held.append(_added(h, np.stack([~verdict[a:b][k], verdict[a:b][k] & (half == 0), verdict[a:b][k] & (half == 1)]).astype(np.int64)))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield rows()
        if held:
            yield rows()

    prior = n_toxic / n_all

    def weigh(table: pa.Table) -> pa.Table:
        parts = [expand(x.as_py()) for x in table["packed"]]
        h, (clean, t0, t1) = _added(np.concatenate([x[0] for x in parts]), np.stack([np.concatenate([x[k] for x in parts]).astype(np.int64) for k in (1, 2, 3)]))
        t = t0 + t1
        n, z2 = t + clean, deviations**2
        share = (t / n + z2 / (2 * n) - deviations * np.sqrt((t / n) * (clean / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        good = (t >= min_toxic) & (np.minimum(t0, t1) > 0) & (t >= np.where(h & np.uint64(1), PURE_PREFIX, PURE) * n) & (share >= max(2 * prior, 0.15))
        return pa.table({"hash": h[good].view(np.int64), "share": share[good]})

    training = d.filter(_in_training(F.col("id"), folds, held_out)).join(verdicts.hint("shuffle_hash"), "id").select("id", "text", "toxic")
    found = training.mapInArrow(count, "bucket long, packed binary").groupBy("bucket").applyInArrow(weigh, "hash long, share double")
    kept = found.orderBy(F.desc("share"), "hash").limit(max_features).collect()
    order = sorted((np.int64(r["hash"]).astype(np.uint64), r["share"]) for r in kept)
    return Model(model, np.array([h for h, _ in order], np.uint64), np.array([s for _, s in order], np.float64), min(0.05, prior / 4))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each row, in place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[bytes, bytes] = {}
        for column in texts:
            parts = [shared.value.score(data, offsets, cache) for _, _, data, offsets in W.slices(column)]
            yield pa.array(np.concatenate(parts or [np.empty(0)]), pa.float64())

    return small_batches(docs).withColumn(out_col, run(F.col(text_col).cast("string")))


def reject(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = REJECT, **fitting) -> DataFrame:
    """docs without the documents that score at least ``threshold``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    out_col = free_name(docs, "_score")
    return score(docs, model, text_col=text_col, out_col=out_col).filter(F.col(out_col) < threshold).drop(out_col)
