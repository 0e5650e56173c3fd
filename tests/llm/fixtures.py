"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, bucket long"
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def documents(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, texts = text(40), []
    base = text(120)
    texts += [base, base, base.upper()]
    for k in (1, 3, 8, 20):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz" + str(k)
        texts.append(" ".join(w))
    texts += [text(30) + " " + passage + " " + text(10), passage, passage + " " + passage, text(60)]
    texts += ["", " \n\t ", None, None, "one", "one two three", "One two THREE", "a b\x0bc\rd", "¿Qué? ñ 😀 \x00x"]
    texts += [text(6000), text(13), text(12), "same same same " * 30]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, None, -1, 0.5, None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[8], (None, base, None, None, None, None, None, None), (None, text(20), None, "s1", 1, 1, 1.0, 1)]
    rng.shuffle(rows)
    return rows


def shingle_sets(rows, n=5):
    out = []
    for r in rows:
        w = WORD.findall(low(r[1] or ""))
        out.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def jaccard_components(rows, percent=75):
    sets = shingle_sets(rows)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def dedup(rows, n=13):
    big = 1 << 63
    first = {}
    words = [WORD.findall(r[1] or "") for r in rows]
    ids = [big if r[0] is None else r[0] for r in rows]
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for r, i, w in zip(rows, ids, words, strict=True):
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(rows, items, n=13, share=20):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text or ""))
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add("" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for r in rows:
        w, hit, found = ALNUM.findall(low(r[1] or "")), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    hit.update(range(k, k + m))
                    found |= own
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)
