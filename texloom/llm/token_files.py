"""Token-ID output: canonical, length-limited Huffman coding in independent blocks.

Layout of an output folder:

``codebook``  Parquet: ``id``, ``bits``. Codes are canonical: by length, then by id,
              counting up; no code is longer than ``MAX_BITS``.
``blocks``    Parquet, one row a block: ``part`` and ``seq`` (their order is the file's
              order), ``first`` (ids before it in its part), ``n_ids``, ``doc_ids``,
              ``doc_tokens``, ``payload`` (code bits, most significant bit first,
              zero padded), ``checkpoints`` (little-endian unsigned 32-bit bit
              offsets of every ``STEP``-th id), ``crc`` (of the payload).

Any block is decoded alone, and within a block any run between checkpoints;
``decode`` steps through all runs of many blocks at once with one table lookup
for each id.

Scale: documents are dealt by ranges of their id once, as text, and encoded once;
plain ids wait in the shared folder while they are counted. Counts are made in
each task and added up, at most one row for each id of the vocabulary; the
codebook is broadcast (bounded by the vocabulary, which is checked). Each task
writes its own part. Starts need only one sum for each part.

Defined cases: a null text is an empty one and has the end id alone. Documents
stand in ascending order of their id, nulls first; rows with equal ids in order
of a hash of their text, then the text. An empty table gives an empty output. A
code of one symbol has one bit. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import words as W
from .shared import new_path, small_batches

MAX_BITS = 16
#: Ids between checkpoints.
STEP = 128
#: Ids from which on a block is full; a document is never split.
BLOCK_IDS = 1 << 16
#: Words whose ids a Python worker keeps at most, and the bytes of a word that is kept: some 25 MB in all.
KEPT_WORDS, KEPT_BYTES = 600_000, 64
MAX_VOCABULARY = 1 << 16
#: Words that the tokenizer gets as one text.
RUN = 512


#: Kinds of normalizers, or none, that leave ASCII as it is but for its case.
_SAME_ASCII = (None, "Sequence", "NFC", "NFD", "NFKC", "NFKD", "Lowercase")


def _widths(tokenizer: dict) -> np.ndarray | None:
    """By id, the bytes of a token's text, 0 where they don't tell; None if the tokenizer's tokens aren't bytes, each a character."""
    model, pre = tokenizer["model"], tokenizer.get("pre_tokenizer") or {}
    last = [pre, *pre.get("pretokenizers", [])][-1]
    if model.get("type") != "BPE" or last.get("type") != "ByteLevel" or last.get("add_prefix_space", True):
        return None
    if any(model.get(x) for x in ("unk_token", "continuing_subword_prefix", "byte_fallback", "dropout")):
        return None
    suffix, added = model.get("end_of_word_suffix") or "", tokenizer.get("added_tokens") or []
    out = np.zeros(max([*model["vocab"].values(), *(x["id"] for x in added)], default=0) + 1, np.int64)
    for token, k in model["vocab"].items():
        out[k] = len(token.removesuffix(suffix))
    out[[x["id"] for x in added]] = 0
    return out


class Encoder:
    """Ids of whole texts. Words between white space are encoded once and kept for a while.

    The tokenizers that this is for drop white space and never join what it
    separates, so a text's ids are its words' ids one after another. Words are
    found by hash and compared byte by byte; a word that shares its hash with
    another one is encoded each time. When ``KEPT_WORDS`` are kept, those that didn't
    come again are forgotten; all are if more than half came again.

    The tokenizer gets runs of ``RUN`` words, as texts of their own. Where its tokens
    are bytes, the bytes of tokens tell which are a word's; a run whose tokens don't
    end where its words end, to the byte, is encoded word by word.
    """

    def __init__(self, tokenizer_json: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.end_id = end_id
        # words that differ in the case of A-Z alone are one to a tokenizer that lowers all letters
        parts = json.loads(tokenizer_json)
        steps = parts.get("normalizer") or {}
        steps = [steps, *steps.get("normalizers", [])]
        self.lower = any(x.get("type") == "Lowercase" for x in steps)
        # whether ASCII words, with one space between them, have as many bytes when normalized
        self.keeps_ascii = all(x.get("type") in _SAME_ASCII or (x.get("pattern"), x.get("content")) == ({"Regex": r"\s+"}, " ") for x in steps)
        self.widths = _widths(parts)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)  # by hash
        self.ids, self.ends = np.empty(0, np.intc), np.zeros(1, np.int64)  # by slot, as the words' bytes
        self.text, self.text_ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.again = np.empty(0, bool)

    def make_room(self) -> None:
        again = self.again
        if again.sum() > KEPT_WORDS // 2:
            return self.forget()
        stays, place = again[self.slots], np.cumsum(again) - 1
        self.hashes, self.slots = self.hashes[stays], place[self.slots[stays]].astype(np.int32)
        lens, sizes = np.diff(self.ends), np.diff(self.text_ends)
        self.ids, self.text = self.ids[np.repeat(again, lens)], self.text[np.repeat(again, sizes)]
        self.ends, self.text_ends = (np.concatenate([[0], np.cumsum(x[again])]) for x in (lens, sizes))
        self.again = np.zeros(len(self.hashes), bool)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one word's after another, and how many each has."""
        texts = [x.decode("utf-8", "replace") for x in words]
        plain = np.array([x.isascii() for x in texts], bool)
        order = np.argsort(~plain, kind="stable")  # words of ASCII alone stand together
        texts, n = [texts[k] for k in order.tolist()], int(plain.sum())
        runs = [texts[k : min(k + RUN, end)] for begin, end in ((0, n), (n, len(texts))) for k in range(begin, end, RUN)]
        found = [None] * len(runs) if self.widths is None else map(self._cut, runs, self._encoded([" ".join(x) for x in runs]))
        out = [self._one_by_one(run) if cut is None else cut for run, cut in zip(runs, found, strict=True)]
        ids, found_lens = np.concatenate([np.empty(0, np.intc), *(x for x, _ in out)]), np.concatenate([np.empty(0, np.int64), *(x for _, x in out)])
        lens, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        lens[order], begin[order] = found_lens, np.cumsum(found_lens) - found_lens
        return ids[np.repeat(begin - np.cumsum(lens) + lens, lens) + np.arange(len(ids))], lens

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = array("i"), []
        for own in self._encoded(words):
            ids.extend(own)
            lens.append(len(own))
        return np.array(ids, np.intc), np.array(lens, np.int64)

    def _cut(self, words: list[str], ids: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of the words as one text, and how many are each word's; nothing where bytes don't tell."""
        text, ids = " ".join(words), np.array(ids, np.intc)
        if not (self.keeps_ascii and text.isascii()):
            text = self.tokenizer.normalizer.normalize_str(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        space = np.flatnonzero(raw == 0x20)
        widths = self.widths[ids]
        if len(space) != len(words) - 1 or (widths < 1).any():
            return None
        ends = np.append(space, len(raw)) - np.arange(len(words))
        upto = np.concatenate([[0], np.cumsum(widths)])
        at = np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[at] != ends).any():
            return None
        return ids, np.diff(at, prepend=0)

    def learn(self, hashes: np.ndarray, words: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        """hashes: sorted and new."""
        at = np.searchsorted(self.hashes, hashes)
        slots = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(words), dtype=np.int32)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(words), np.uint8)])
        self.text_ends = np.concatenate([self.text_ends, self.text_ends[-1] + np.cumsum([len(x) for x in words])])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, each with its end id, and where each document's begin."""
        w = W.split_words(data, offsets, lower=self.lower)
        unique, back = np.unique(w.hash, return_inverse=True)
        first = np.empty(len(unique), np.int64)
        first[back] = np.arange(len(back))  # any of the words that share a hash
        if len(self.hashes) > KEPT_WORDS:
            self.make_room()
        raw = w.data.tobytes()
        cut = lambda which: [raw[a:b] for a, b in zip(w.start[which].tolist(), w.end[which].tolist(), strict=True)]
        at = np.searchsorted(self.hashes, unique)
        at[at == len(self.hashes)] = 0
        held = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        if held.any():
            self.again[self.slots[at[held]]] = True
        new = np.flatnonzero(~held)
        short = new[w.end[first[new]] - w.start[first[new]] <= KEPT_BYTES]
        if len(short):
            words = cut(first[short])
            self.learn(unique[short], words, *self.ids_of(words))
        # each word's ids lie at begin in ids: of the words that are kept, then of those that aren't
        at = np.searchsorted(self.hashes, unique)
        at[at == len(self.hashes)] = 0
        slot = self.slots[at] if len(self.hashes) else np.zeros(len(unique), np.int32)
        kept = held.copy()
        kept[short] = True
        ids, ends = self.ids, self.ends
        if kept.any():
            slot = slot[back]
            kept = kept[back]
            kept[kept] = W.same_bytes(w.data, w.start[kept], w.end[kept], self.text, self.text_ends[slot[kept]], self.text_ends[slot[kept] + 1])
        else:
            slot, kept = np.zeros(len(back), np.int32), np.zeros(len(back), bool)
        if not kept.all():
            others: dict[bytes, int] = {}
            which = np.flatnonzero(~kept)
            base = len(ends) - 1
            slot = slot.copy()
            slot[which] = [base + others.setdefault(x, len(others)) for x in cut(which)]
            more, lens = self.ids_of(list(others))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + np.cumsum(lens)])
        begin, lens = ends[slot], ends[slot + 1] - ends[slot]
        # words and document ends in one sequence
        n_docs = len(offsets) - 1
        ends = w.ptr[1:] + np.arange(n_docs)
        item_lens = np.ones(len(lens) + n_docs, np.int64)
        item_start = np.full(len(lens) + n_docs, -1, np.int64)
        is_word = np.ones(len(lens) + n_docs, bool)
        is_word[ends] = False
        item_lens[is_word], item_start[is_word] = lens, begin
        at = np.concatenate([[0], np.cumsum(item_lens)])
        src = np.arange(at[-1]) - np.repeat(at[:-1] - item_start, item_lens)
        out = np.full(at[-1], self.end_id, np.int32)
        real = np.repeat(is_word, item_lens)
        out[real] = ids[src[real]]
        return out, np.concatenate([[0], at[ends + 1]])


_encoders: dict[int, Encoder] = {}


def _encoder(shared, end_id: int) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    text = shared.value
    key = zlib.crc32(text.encode()) ^ end_id
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text, end_id)
    return _encoders[key]


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal code with at most max_bits bits for symbols with counts > 0, by package-merge."""
    n = len(counts)
    lens = np.zeros(n, np.int64)
    if n <= 1:
        return lens + 1
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.int64)
    # Each level merges the symbols with pairs of the level below; made[k] tells which items are symbols.
    made: list[np.ndarray] = []
    pairs = np.empty(0, np.int64)
    for _ in range(max_bits):
        items = np.concatenate([weight, pairs])
        by = np.argsort(items, kind="stable")
        made.append(by < n)
        items = items[by]
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for leaf in reversed(made):
        symbols = int(leaf[:take].sum())
        lens[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.empty(n, np.int64)
    out[order] = lens
    return out


@dataclass
class Code:
    """A canonical code: per id its code and length (0 if it has none), and the decoding table."""

    codes: np.ndarray
    bits: np.ndarray
    table_id: np.ndarray
    table_bits: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, bits: np.ndarray) -> Code:
        size = int(ids.max()) + 1 if len(ids) else 1
        codes, lens = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        table_id, table_bits = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.int64)
        code = 0
        last = 0
        for k in np.lexsort((ids, bits)).tolist():
            n = int(bits[k])
            code <<= n - last
            last = n
            codes[ids[k]], lens[ids[k]] = code, n
            a, b = code << (MAX_BITS - n), (code + 1) << (MAX_BITS - n)
            table_id[a:b], table_bits[a:b] = ids[k], n
            code += 1
        return Code(codes, lens, table_id, table_bits)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payload, and the bit offsets of every STEP-th id."""
        lens = self.bits[ids]
        end = np.cumsum(lens)
        at = end - lens
        word = at >> 5
        value = self.codes[ids] << (64 - (at & 31) - lens).astype(np.uint64)
        n = int(end[-1] + 31 >> 5) + 1 if len(ids) else 0
        out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n + 1) if n else np.zeros(1)
        if n:
            out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
        size = int(end[-1] + 7 >> 3) if len(ids) else 0
        return out.astype(np.uint32).astype(">u4").tobytes()[:size], at[::STEP].astype("<u4")

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> np.ndarray:
        """Ids of the blocks, one after another."""
        if not counts:
            return np.empty(0, np.int32)
        base = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
        raw = np.frombuffer(b"".join([*payloads, b"\0\0\0"]), np.uint8).astype(np.uint32)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        pos = np.concatenate([c.astype(np.int64) + 8 * b for c, b in zip(checkpoints, base[:-1], strict=True)])
        left = np.concatenate([np.minimum(STEP, n - np.arange(0, n, STEP)) for n in counts])
        first = np.concatenate([[0], np.cumsum(left)])[:-1]
        out = np.empty(int(left.sum()), np.int32)
        order = np.argsort(-left, kind="stable")  # lanes that end go from the tail
        pos, first, left = pos[order], first[order], left[order]
        ends = np.searchsorted(-left, -np.arange(1, STEP + 1), "right")
        for k in range(STEP):
            live = int(ends[k])
            if not live:
                break
            p = pos[:live]
            peek = window[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF
            out[first[:live] + k] = self.table_id[peek]
            p += self.table_bits[peek]
        return out


BLOCK_COLUMNS = ["part", "seq", "first", "n_ids", "doc_ids", "doc_tokens", "payload"]


def raw_blocks(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks in their order, their payload the plain ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[id_col].dataType.simpleString()
    d = small_batches(docs).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "tie").sortWithinPartitions("doc", "tie", "text").select("doc", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, first = _encoder(shared, end_id), TaskContext.get().partitionId(), 0, 0
        docs_, lens, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [[part], [seq], [first], [len(ids)], [pa.concat_arrays(docs_).to_pylist()], [np.concatenate(lens).tolist()], [ids.astype("<u4").tobytes()]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(docs_[0].type), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], BLOCK_COLUMNS)

        for batch in batches:
            for a, _, data, offsets in W.slices(batch.column(1), 1 << 20):
                all_ids, ptr = encoder.encode(data, offsets)
                k = 0
                while k < len(ptr) - 1:
                    e = max(k + 1, int(np.searchsorted(ptr, ptr[k] + BLOCK_IDS - held, "left")))
                    e = min(e, len(ptr) - 1)
                    docs_.append(batch.column(0).slice(a + k, e - k))
                    lens.append(np.diff(ptr[k : e + 1]))
                    parts.append(all_ids[ptr[k] : ptr[e]])
                    held += int(ptr[e] - ptr[k])
                    if held >= BLOCK_IDS:
                        yield block()
                        seq, first = seq + 1, first + held
                        docs_, lens, parts, held = [], [], [], 0
                    k = e
        if held:
            yield block()

    return d.mapInArrow(pack, f"part int, seq long, first long, n_ids long, doc_ids array<{kind}>, doc_tokens array<long>, payload binary")


def count_ids(blocks: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all blocks, by id; at most as many rows as the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for b in batch.column(0):
                n = np.bincount(np.frombuffer(b.as_py(), "<u4"))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    d = blocks.select("payload").mapInArrow(count, "id long, n long")
    return sorted((r["id"], r["n"]) for r in d.groupBy("id").agg(F.sum("n").alias("n")).collect())


def write(docs: DataFrame, path: str, tokenizer_json: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> None:
    """Writes the ids of all documents to a new folder. Texts are encoded once: plain ids stand in the shared folder until they are counted and coded."""
    spark = docs.sparkSession
    plain = new_path(spark, "plain-ids")
    raw_blocks(docs, tokenizer_json, end_id, id_col, text_col).write.option("compression", "zstd").parquet(plain)
    blocks = spark.read.parquet(plain)
    counts = count_ids(blocks)
    if len(counts) > MAX_VOCABULARY or max_bits > MAX_BITS:
        raise ValueError(f"at most {MAX_VOCABULARY} ids and {MAX_BITS} bits")
    ids, bits = np.array([i for i, _ in counts], np.int64), code_lengths(np.array([n for _, n in counts], np.int64), max_bits)
    spark.createDataFrame(pa.table({"id": ids, "bits": bits}).to_pandas(), "id long, bits long").coalesce(1).write.parquet(f"{path}/codebook")
    code = spark.sparkContext.broadcast(Code.of(ids, bits))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4):
                rows = batch.slice(k, 4)
                coded = [code.value.encode(np.frombuffer(b.as_py(), "<u4").astype(np.int64)) for b in rows.column(6)]
                payload = [p for p, _ in coded]
                new = [pa.array(payload, pa.binary()), pa.array([c.tobytes() for _, c in coded], pa.binary()), pa.array([zlib.crc32(p) for p in payload], pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:6], *new], [*BLOCK_COLUMNS, "checkpoints", "crc"])

    schema = T.StructType([*blocks.schema.fields, T.StructField("checkpoints", T.BinaryType()), T.StructField("crc", T.LongType())])
    blocks.select(BLOCK_COLUMNS).mapInArrow(encode, schema).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document: its id, start, n_tokens, ids_crc32 and, ``with_ids``, ids."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    code = spark.sparkContext.broadcast(Code.of(np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in sums], np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist(), strict=False))
    starts = spark.sparkContext.broadcast(before)
    doc_type = blocks.schema["doc_ids"].dataType.elementType

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8):
                rows = batch.slice(k, 8)
                part, first, n_ids, doc_ids, tokens, payload, checks, crc = (rows.column(rows.schema.get_field_index(c)) for c in ("part", "first", "n_ids", "doc_ids", "doc_tokens", "payload", "checkpoints", "crc"))
                raw = payload.to_pylist()
                if [zlib.crc32(p) for p in raw] != crc.to_pylist():
                    raise ValueError("a block's payload doesn't match its checksum")
                ids = code.value.decode(raw, [np.frombuffer(c, "<u4") for c in checks.to_pylist()], n_ids.to_pylist())
                lens = [np.array(x, np.int64) for x in tokens.to_pylist()]
                begin = np.concatenate([starts.value[p] + f + np.cumsum(n) - n for p, f, n in zip(part.to_pylist(), first.to_pylist(), lens, strict=True)])
                ptr = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
                flat = ids.astype("<u4")
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                out = [doc_ids.flatten(), pa.array(begin), pa.array(np.diff(ptr)), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(out, [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(unpack, f"{id_col} {doc_type.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def round_trip(docs: DataFrame, tokenizer_path: str, *, path: str | None = None, **options) -> DataFrame:
    """Writes the documents' ids to ``path`` (or a new folder of the shared one) and returns what the files hold."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, path, tokenizer_json(tokenizer_path), **options)
    return read(spark, path, id_col=options.get("id_col", "doc_id"), with_ids=False)
