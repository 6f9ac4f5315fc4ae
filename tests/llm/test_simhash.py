"""SimHash near-duplicates against a plain version."""

import random

import numpy as np
import pytest
import xxhash
from brute import SPACE, UPPER

from lendlens.llm import simhash


def plain_fingerprint(text):
    w = SPACE.findall((text or "").translate(UPPER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(id, fingerprint) pairs to id -> smallest reachable id."""
    ids = [d for d, _ in prints]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, least.get(find(i))) for i, d in enumerate(ids)), key=str)


def turned(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_fingerprints_agree_with_spark_hash(spark):
    row = spark.sql("SELECT xxhash64('é b c') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("é b c".encode(), 42)


@pytest.mark.parametrize("piece", [simhash._PIECE, 7])
def test_fingerprint(monkeypatch, piece):
    monkeypatch.setattr(simhash, "_PIECE", piece)
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "one TWO", "É é\x0b\x0cx y z", "a b c", "a b c d", "a a a a a a " * 50]
    texts += [" ".join(rng.choice(["Ab", "c", "\n", "é" * rng.randint(1, 9)]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(" \n") == 0


def test_ring_keeps_every_near_pair():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        d = a ^ turned(rng, a, rng.randint(0, 3))
        kept = [
            i for i, (mask, chains) in enumerate(simhash._FIRST)
            if not d & mask and all((d & c).bit_count() <= 3 * (k + 1) // 8 for k, c in enumerate(chains))
        ]
        assert kept
        i = kept[0]
        assert any(not d & mask for mask, _ in simhash._SECOND[i])
    assert {m.bit_count() for m, _ in simhash._FIRST} == {32}
    assert {m.bit_count() for m in simhash._EQUAL[24:]} == {48}


def star_components(spark, prints):
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.linked(nodes).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e.a)] = find(e.b)
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(find(x), []).append(i)
    return edges, sorted(groups.values())


def plain_groups(prints):
    groups = {}
    for d, r in plain_components(list(enumerate(prints))):
        groups.setdefault(r, []).append(d)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_links(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {turned(rng, c, rng.randint(0, 7)) for c in centres for _ in range(25)} | {0, 1, 7, 15, 31, (1 << 64) - 1}
    # a dense region: few bits are free
    prints |= {centres[0] ^ sum(1 << b for b in rng.sample(range(40, 52), rng.randint(0, 8))) for _ in range(120)}
    prints = sorted(prints)
    edges, groups = star_components(spark, prints)
    assert groups == plain_groups(prints)


def test_large_key_is_linked_whole(spark):
    """Several thousand fingerprints that share 48 bits leave fewer edges than members and keys."""
    rng = np.random.default_rng(4)
    low = rng.choice(1 << 16, 1500, replace=False).astype(np.uint64)
    prints = (np.uint64(0xABCDEF0123450000) | low).tolist()
    edges, groups = star_components(spark, prints)
    assert groups == plain_groups(prints)
    assert len(edges) < 24 * 25 * len(prints)


def test_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(8)]
    texts = [None, "", "  ", "x", "x", "X"]
    for t in base:
        texts += [t, t, t.upper()]
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "zz"
            texts.append("\t".join(w))
    ids = rng.sample(range(1000), len(texts) - 1) + [None]
    df = spark.createDataFrame(
        [(d, t, "a", 1, 2) for d, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id long, n int"
    )
    got = simhash.near_duplicates(df).collect()
    prints = [(d, plain_fingerprint(t)) for d, t in zip(ids, texts)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == plain_components(prints)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{x:016x}") for d, x in prints)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "q w e r t"), (None, "q w e r t"), (None, ""), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(4, 4), (None, 4), (None, None), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_query_on_table(spark):
    from lendlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    got = QUERIES["op13_simhash_duplicates"](spark, sf).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == plain_components(prints)
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{x:016x}" for d, x in prints}
