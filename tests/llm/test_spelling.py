"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest

from lendlens.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    counts = Counter()
    for d, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_pairs(words):
    words = sorted(words)
    return {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def plain_groups(docs):
    n = plain_words(docs)
    near = {w: [] for w in n}
    for a, b in plain_pairs(n):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def last(w):
        return last(form[w]) if form[w] else w

    return sorted((w, form[w], last(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def vocabulary_frame(spark, words):
    return spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")


def pairs_of(df):
    got = [(r.a, r.b) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("letters,longest", [("ab", 8), ("abcdefgéß", 9)])
def test_pairs(spark, letters, longest):
    rng = random.Random(1)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(400)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "abcdefghij", "bcdefghij", "abcdefghi", "abcdefghijk", "aabbccdd", "aabccdd", "zzzzz"}
    assert pairs_of(spelling.trie_pairs(vocabulary_frame(spark, words))) == plain_pairs(words)


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TRIE_LETTERS", 7)
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 10))) for _ in range(300)}
    big = "".join(rng.choice("abcde") for _ in range(3000))
    words |= {big, big[1:], big[:-1], big[:700] + "z" + big[701:], "a" * 5000, "a" * 5001, "a" * 5003}
    got = spelling.near_words(vocabulary_frame(spark, words))
    want = plain_pairs(words)
    assert sorted((r.word, r.other) for r in got.collect()) == sorted(want | {(b, a) for a, b in want})


def test_group_variants(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéÀ×÷") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    docs = []
    for d in range(150):
        text = ""
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + "b" + w[k + 1 :]])
            text += rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", "\n", ", ", "1", "_", "漢", "’", "ā", "\x00"])
        docs.append((d, text))
    docs += [(None, "Colour colour COLOUR Color"), (None, None), (1000, ""), (1001, None), (7, "repeat repeat"), (7, "repeat repeat")]
    docs += [(2000 + k, w) for w, n in (("chainin", 4), ("chaining", 11), ("chainings", 30)) for k in range(n)]
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, word string, n int, node string")
    got = rows(spelling.group_variants(df))
    assert got == plain_groups(docs)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_slips_are_planted():
    docs = [(d, "incremental") for d in range(2000)]
    assert len(plain_words(docs)) > 1


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a bc 12"), (3, "twice twice")], "doc_id long, text string")
    assert rows(spelling.group_variants(df)) == []
    assert rows(spelling.group_variants(df.limit(0))) == []


def test_query_on_table(spark):
    from lendlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(QUERIES["op11_spelling_variants"](spark, sf)) == plain_groups(docs)
