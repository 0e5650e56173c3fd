"""Words that weak hashes take for one another."""

import random
import zlib

import numpy as np
import pytest

from texloom.llm import jaccard_join as op3, substring_dedup as op10, token_files as op4, words as W
from tests.llm import fixtures as X


def alike(n=10):
    """Two different words of 2 to the n bytes whose polynomial hashes modulo 2 to the 64 are equal."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def rows():
    a, b = alike()
    rest = [f"w{k}" for k in range(20)]
    return [(k, t, "en", "s", 1, 1, 0.5, 1) for k, t in enumerate([" ".join([*rest[:6], x, *rest[6:]]) for x in (a, b)] + [f"{a} {b}", f"{b} {a}", a, b, a])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), X.SCHEMA).coalesce(1)


def test_hashes_tell_bytes_apart():
    rng = random.Random(1)
    words = {*alike(10), *alike(7), *alike(3), "a", "aa", "a" * 8, "a" * 9, "a" * 16, "a" * 300, "a" * 301}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(3000)}
    words = sorted(words)
    raw = np.frombuffer(" ".join(words + words).encode(), np.uint8)
    w = W.split_words(raw, np.array([0, len(raw)]))
    n = len(words)
    assert len(set(w.hash[:n].tolist())) == n and (w.hash[:n] == w.hash[n:]).all()
    ends = np.arange(2 * n)
    other = (ends + n) % (2 * n)
    assert W.same_bytes(w.data, w.start, w.end, w.data, w.start[other], w.end[other]).all()
    other = (ends + 1) % (2 * n)
    assert not W.same_bytes(w.data, w.start, w.end, w.data, w.start[other], w.end[other]).any()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 20])
def test_window_hashes_know_every_place(n):
    h = W.mix(np.arange(1, 40, dtype=np.uint64))
    base = W.window_hash(h, n)
    assert len(base) == len(h) - n + 1 == len(set(base.tolist()))
    for k in range(n):
        other = h.copy()
        other[k] ^= np.uint64(1)
        assert W.window_hash(other, n)[0] != base[0]


def test_jaccard_join(docs):
    found = X.ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3.link_components(docs).collect())
    assert found == X.ordered(X.jaccard_components(rows()))


def test_substring_dedup(spark):
    a, b = alike()
    rest = [f"w{k}" for k in range(20)]
    data = [(k, " ".join([*rest[:6], x, *rest[6:12]]), None, None, 1, 1, 0.5, 1) for k, x in enumerate((a, b, a))]
    found = op10.dedup(spark.createDataFrame(data, X.SCHEMA).coalesce(1)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert X.ordered(tuple(r) for r in found.collect()) == X.ordered(X.dedup(data))


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = [t.encode(r[1], add_special_tokens=False).ids + [1] for r in rows()]
    found = sorted(op4.round_trip(docs, path).collect(), key=lambda r: r["doc_id"])
    assert [r["ids_crc32"] for r in found] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


@pytest.mark.parametrize("kept", [1 << 20, 3])
def test_encoder_compares_words(monkeypatch, kept):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(op4, "KEPT_WORDS", kept)
    monkeypatch.setattr(W, "word_hashes", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(5))
    e = op4.Encoder(op4.tokenizer_json(path), 1)
    texts = ["The cat and the dog, " + "x" * 70, "", "dog theé THE CAT hat 12 a,b  ", "bat rat", "The cat"]
    raw = [x.encode() for x in texts]
    for _ in range(2):
        ids, ptr = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [e.tokenizer.encode(x, add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("words", [["the", "dog.", "don't", "a,b", "x1y2"], ["théé", "e\u0301a", "\u0130x", "\u1e9e"], ["a\u00a0b", "\u00a0", "c"], ["a</w>", "</w>", "<|endoftext|>b", "c"], ["a\x1cb", "\0", "zz"]])
def test_words_are_encoded_in_runs(words):
    """Ids are those of each word by itself, and the tokenizer gets few texts for many words."""
    import public_tokenizers

    e = op4.Encoder(op4.tokenizer_json(public_tokenizers.path("word_bpe_49k.json")), 1)
    want = [e.tokenizer.encode(x, add_special_tokens=False).ids for x in words] * 300
    ids, lens = e.ids_of([x.encode() for x in words] * 300)
    assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [k for x in want for k in x]


def test_the_tokenizer_gets_few_texts():
    import public_tokenizers

    e = op4.Encoder(op4.tokenizer_json(public_tokenizers.path("word_bpe_49k.json")), 1)
    whole, given = e.tokenizer, []

    class Counting:
        normalizer = whole.normalizer

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    e.tokenizer = Counting()
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in ("ou", "ré", "st.", "n't") for c in map(str, range(50))]
    ids, lens = e.ids_of([x.encode() for x in words])
    assert ids.tolist() == [k for x in words for k in whole.encode(x, add_special_tokens=False).ids] and len(lens) == len(words)
    assert len(given) <= -(-len(words) // op4.RUN) + 1


def test_words_that_come_again_are_kept(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(op4, "KEPT_WORDS", 10)
    e = op4.Encoder(op4.tokenizer_json(public_tokenizers.path("word_bpe_49k.json")), 1)
    ids_of, given = e.ids_of, []
    monkeypatch.setattr(e, "ids_of", lambda words: given.extend(words) or ids_of(words))
    for k in range(12):
        text = "the théâtre " + " ".join(f"w{k}{c}" for c in "abcdef")
        ids, _ = e.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert len(e.hashes) == len(e.again) == len(e.ends) - 1 == len(e.text_ends) - 1 <= 10 + 8
    assert given.count(b"the") == given.count("théâtre".encode()) == 1 and given.count(b"w3a") == 1
