"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    w = SPACE.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_exclaims": text.count("!"),
    }


def good(text, repeated=50):
    """Policy v3; with ``repeated`` of 30 it is v2."""
    m = quality(text)
    return not (
        m["n_words"] < 50
        or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        or 10 * m["n_symbols"] > m["n_words"]
        or 100 * m["n_dup_lines"] > repeated * m["n_lines"]
        or 100 * m["n_upper"] > 40 * m["word_chars"]
        or 10 * m["n_exclaims"] > m["n_words"]
    )


def shingles(text):
    w = SPACE.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    """doc_id -> (set size, component) of (doc_id, text) pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def contamination(docs, items, window=10):
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    ids |= grams[g]
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


def repeats(docs, length=50):
    """doc_id -> (bytes, removed, spans, kept digest)."""
    first, out = {}, {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p = p * rate / k
        c += p
    return k


def copies(docs, weights, default, seed):
    """(doc_id, source, text) -> doc_id -> copies at the source's rate."""
    size, per = Counter(), {}
    for _, s, t in docs:
        size[s] += len((t or "").encode()) + 1
    total, share = sum(size.values()), sum(weights.get(s, default) for s in size)
    for d, s, _ in docs:
        rate = weights.get(s, default) / share * total / size[s]
        per[d] = poisson(unit(seed, 0, d), rate)
    return per
