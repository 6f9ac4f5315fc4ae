"""Repeated strings and near-duplicates against plain versions."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from brute import near, repeats, shingles
from pyspark.sql import functions as F

from lendlens.llm import lsh_forest, repeat_dedup

SF = "/root/testdata/sf0.001"


def repeat_rows(spark, docs):
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, rid string, ord int")
    out = repeat_dedup.remove_repeats(df).collect()
    return sorted(
        (r.doc_id, (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())) for r in out
    )


def noise(rng, n, letters="abcdefgh éß漢"):
    return "".join(rng.choice(letters) for _ in range(n))


def cases():
    rng = random.Random(4)
    passage, long = noise(rng, 120), noise(rng, 3000)
    docs = [noise(rng, rng.randint(0, 400)) for _ in range(20)]
    docs += [noise(rng, 90) + passage + noise(rng, 90) for _ in range(12)]
    docs += [long, long, long[:1500] + "!" + long[1500:], long[700:2000], "a" * 700, "a" * 400, "ab" * 300, "", None]
    docs += [passage[20:60], noise(rng, 49), noise(rng, 50) * 2, "\n".join([long[:60]] * 30)]
    return list(zip(rng.sample(range(1000), len(docs)), docs))


@pytest.mark.parametrize("block", [repeat_dedup.BLOCK, 2])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(repeat_dedup, "BLOCK", block)
    docs = cases()
    assert repeat_rows(spark, docs) == sorted(repeats(docs).items())


def test_repeats_on_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert repeat_rows(spark, docs) == sorted(repeats(docs).items())


def test_repeats_ids(spark):
    text = "x" * 30 + "y" * 40
    got = dict(repeat_rows(spark, [(5, text), (5, text)]))
    assert got[5][1] == 0
    df = spark.createDataFrame([(None, text), (None, text), (7, text)], "doc_id long, text string")
    out = {(r.doc_id, len(r.kept)) for r in repeat_dedup.remove_repeats(df).collect()}
    assert out == {(7, 70), (None, 0)}
    assert repeat_rows(spark, []) == []


def test_repeats_name_rows_by_id_alone_where_they_can(spark, monkeypatch):
    """A hash of each text on every phrase, gram and context does not compress; only rows that share an id need one."""
    text, other = "x" * 30 + "y" * 40, "z" * 60
    kept = {}
    bucketed = repeat_dedup._bucketed

    def seen(rows, buckets):
        kept["base"] = bucketed(rows, buckets)
        return kept["base"]

    monkeypatch.setattr(repeat_dedup, "_bucketed", seen)
    df = spark.createDataFrame([(1, text), (5, text), (5, other), (7, other), (None, text), (None, other)], "doc_id long, text string")
    out = sorted((r.doc_id or 99, r.n_bytes, len(r.kept)) for r in repeat_dedup.remove_repeats(df).collect())
    assert out == [(1, 70, 70), (5, 60, 60), (5, 70, 0), (7, 60, 0), (99, 60, 0), (99, 70, 0)]
    names = {}
    for r in kept["base"].collect():
        names.setdefault(r.doc_id, set()).add(r.rid)
    assert names[1] == names[7] == {0}
    assert len(names[5]) == len(names[None]) == 2 and 0 not in names[5] | names[None]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows(spark, docs):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_shingles int, node string")
    return df, {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(df).collect()}


@pytest.mark.parametrize("rows", [lsh_forest.BLOCK_ROWS, 4])
def test_near(spark, monkeypatch, rows):
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", rows)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(12)]
    docs = [edited(rng, b, k % 5) for b in base for k in range(6)]
    docs += [None, "", "  \n", "few words", "FEW  words", "few word", "one two three four five", " ".join(base[0])]
    docs += [" ".join(base[1]).upper(), "same " * 300, "same " * 9]
    docs = list(zip(rng.sample(range(500), len(docs)), docs))
    df, got = near_rows(spark, docs)
    want = near(docs)
    assert got == want
    kept = lsh_forest.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if d == w[1]}


def test_near_copies_in_bounded_blocks(spark, monkeypatch):
    limit, held, link = 16, [], lsh_forest.link_blocks

    def watched(members, texts):
        counts = members.distinct().groupBy("bucket", "block").agg(F.countDistinct("node").alias("n"))
        held.append(counts.agg(F.max("n")).first()[0])
        return link(members, texts)

    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", limit)
    monkeypatch.setattr(lsh_forest, "link_blocks", watched)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    docs = [edited(rng, base, 1 + k % 2) for k in range(300)]
    # alike enough to share regions, not enough to be linked with all
    docs += [edited(rng, base, 3 + k % 3) for k in range(60)]
    docs = list(zip(rng.sample(range(1000), len(docs)), docs))
    assert near_rows(spark, docs)[1] == near(docs)
    assert held[0] <= limit + 2 and max(held) <= 2 * limit


def test_near_on_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert near_rows(spark, docs)[1] == near(docs)


def test_near_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(2, text), (2, text), (None, text), (None, "z"), (9, "q r")], "doc_id long, text string")
    got = sorted(lsh_forest.near_duplicates(df).collect(), key=str)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("2", "2", True), ("2", "2", True), ("9", "9", True), ("None", "2", False), ("None", "None", True),
    ]
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0


def test_shingle_sets_agree_with_tuples():
    texts = ["A b\tc  d e f", "a b c d e F", "x", None, "", "e d c b a " * 50, "É é"]
    sets = lsh_forest.shingle_sets(texts)
    plain = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_slices_hold_few_long_texts():
    texts = ["x" * 50_000] * 700 + [None, "", "y" * 5_000_000, "z"] + ["short"] * 1200
    batch = pd.DataFrame({"text": texts, "at": range(len(texts))})
    slices = list(lsh_forest._slices(iter([batch, batch.iloc[:0]])))
    assert [i for s in slices for i in s["at"]] == list(range(len(texts)))
    for s in slices:
        assert len(s) == 1 or len(s) <= 512 and sum(len(t or "") for t in s["text"]) <= 1 << 21


def test_linked_stars_both_ways(monkeypatch):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[:120] if i % 2 else pool, 100)) for i in range(60)]
    sets += [np.unique(np.append(sets[i], pool[i : i + 6])) for i in range(30)]

    def groups(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    want = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                want.append((j, i))
    assert groups(lsh_forest.linked_stars(sets)) == groups(want)
    monkeypatch.setattr(lsh_forest, "MATRIX_CELLS", 0)
    assert groups(lsh_forest.linked_stars(sets)) == groups(want)


def test_components_of_chains(spark):
    node = lambda i: F.unhex(F.md5(F.col(i).cast("string").cast("binary")))
    chain = spark.range(200).filter("id % 50 != 49").select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    found = lsh_forest.components(chain.select(node("x").alias("a"), node("y").alias("b")))
    assert found.count() == 200
    assert sorted(r["count"] for r in found.groupBy("root").count().collect()) == [50] * 4
