"""Codes of vectors against a plain version that compares everything with everything."""

import math
import random

import numpy as np
import pytest

from lendlens.llm import product_codes as pc


def plain(vectors, parts=4, entries=256, rounds=4, scale=1024):
    """(id, vector) pairs to [(id, codes, error)] and the codebooks."""
    kept = [(d, [math.floor(scale * c) for c in v]) for d, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        codes = [[min((far(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v in kept]
        if r < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [cut(v, p) for (_, v), c in zip(kept, codes) if c[p][1] == j]
                    if mine:
                        books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(d, [j for _, j in c], sum(e for e, _ in c)) for (d, _), c in zip(kept, codes)], books


def frame(spark, vectors):
    return spark.createDataFrame(
        [(d, v, i % 3 or None, "x", 1) for i, (d, v) in enumerate(vectors)],
        "vec_id long, embedding array<float>, label int, codes string, error int",
    )


def single(x):
    return float(np.float32(x))


def check(spark, vectors, **sizes):
    want, books = plain(vectors, **sizes)
    got = pc.compress(frame(spark, vectors), **sizes)
    rows = sorted(((r.id, list(r.codes), r.error) for r in got.codes.collect()), key=str)
    assert rows == sorted(want, key=str)
    assert got.codebooks.tolist() == books


def vectors_of(rng, n, width=8, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(6)]
    return [(i, [single(c + rng.gauss(0, 0.3)) for c in rng.choice(centres)]) for i in rng.sample(range(5 * n), n)]


def test_codes(spark):
    rng = random.Random(1)
    vectors = vectors_of(rng, 150)
    vectors += [(7, None), (8, [1.0] * 7 + [None]), (9, [math.nan] * 8), (10, [math.inf] + [0.0] * 7), (None, vectors[0][1])]
    vectors += vectors[:5] + [(-3, vectors[1][1]), (-2, vectors[1][1])]  # repeated rows, equal entries
    check(spark, vectors, entries=12, rounds=4)


def test_fewer_vectors_than_entries(spark):
    check(spark, vectors_of(random.Random(2), 5))
    check(spark, [(1, [0.5, -0.5, 0.25, 0.0])])


def test_large_components(spark):
    """Beyond what a double multiplies exactly."""
    check(spark, vectors_of(random.Random(3), 40, spread=100_000.0), entries=6, rounds=2)
    with pytest.raises(Exception, match="after scaling"):
        pc.compress(frame(spark, [(1, [1e9] * 4)]))


def test_empty(spark):
    got = pc.compress(frame(spark, [(1, None), (2, [None])]))
    assert got.codes.collect() == [] and got.codebooks.size == 0
    assert pc.with_group_error(got.codes, "keep_0", "total").collect() == []


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="one length"):
        pc.compress(frame(spark, [(1, [1.0] * 4), (2, [1.0] * 8)]))


def test_bounds_spare_scans_and_stay_right():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (20, 6))
    x = centres[rng.integers(0, 20, 3000)] + rng.integers(-150, 150, (3000, 6))
    history = [centres + rng.integers(-300, 300, centres.shape)]
    state = pc.scan(x, history[0], 0)
    scanned = []
    for _ in range(6):
        history.append(history[-1] + rng.integers(-60, 60, centres.shape))
        state, n = pc.update(x, np.stack(history), state)
        full = pc.scan(x, history[-1], 0)
        assert (state.entry == full.entry).all()
        scanned.append(n)
    assert sum(scanned) < len(x)


def test_net_moves_are_below_summed_steps():
    """An entry that goes and comes back has not moved."""
    a, b = np.zeros((3, 2), dtype=np.int64), np.full((3, 2), 30, dtype=np.int64)
    assert pc.net_moves(np.stack([a, b, a])).tolist()[0] == [0, 0, 0]
    moves = np.array([[5.0, 2.0, 9.0]])
    assert pc.farthest_other(moves).tolist() == [[9.0, 9.0, 5.0]]


def test_group_error_and_hex(spark):
    rows = spark.createDataFrame([(1, None, [0, 255], 4), (2, None, [16, 1], 5), (3, 7, [1, 1], 1)], "id long, g int, codes array<long>, error long")
    got = {r.id: (r.total, r.code) for r in pc.with_group_error(rows, "g", "total").withColumn("code", pc.hex_codes()).collect()}
    assert got == {1: (9, "00ff"), 2: (9, "1001"), 3: (1, "0101")}
