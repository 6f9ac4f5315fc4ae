"""Chunk-wise learning against plain numpy, and the grid search against its own scores."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lendlens.operators import fairness, minibatch, modeling


@pytest.fixture(scope="module")
def chunked(spark):
    """1000 rows in five uneven chunks; the label leans on the first of three features."""
    i = F.col("id")
    x = F.array(((i * 37) % 101 - 50) / 25, ((i * 53) % 97 - 48) / 24, F.lit(1.0))
    label = (((i * 37) % 101 - 50) / 25 + ((i * 71) % 11 - 5) / 10 > 0.4).cast("int")
    return spark.range(1000).select("id", x.alias("x"), label.alias("y"), F.when(i < 600, i % 2).otherwise(2 + i % 3).alias("chunk"))


def plainly(rows, step, epochs=1, balanced=True, weights=(0.0, 0.0, 0.0), bias=0.0, steps=0):
    """The same walk, row by row."""
    share = {c: sum(r.y == c for r in rows) for c in (0, 1)}
    w, history = np.array(weights), []
    for chunk in sorted({r.chunk for r in rows}) * epochs:
        mine = [r for r in rows if r.chunk == chunk]
        x, y = np.array([r.x for r in mine]), np.array([r.y for r in mine])
        cw = np.array([len(rows) / (2 * share[r.y]) if balanced else 1.0 for r in mine])
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        size = step.rate / (1 + step.decay * steps)
        loss = (cw * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / cw.sum()
        w, bias, steps = w - size * ((cw * (p - y)) @ x / cw.sum() + step.penalty * w), bias - size * (cw * (p - y)).sum() / cw.sum(), steps + 1
        history.append((steps, chunk, len(mine), loss, bias, *w))
    return history


@pytest.mark.parametrize("balanced", [True, False])
def test_walk_equals_numpy(chunked, balanced):
    step = minibatch.Step(0.7, 0.1, 0.02)
    state, taken = minibatch.train(chunked.repartition(7), "chunk", "x", "y", 3, step, balanced, epochs=2)
    got = [(r.step, r.chunk, r.n, r.loss, r.bias, *r.weights) for r in taken.orderBy("step").collect()]
    want = plainly(chunked.collect(), step, 2, balanced)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-10)
    assert state == minibatch.State(got[-1][5:], got[-1][4], 10)


def test_walk_goes_on_where_it_stopped(chunked):
    step = minibatch.Step(0.5, 0.2)
    whole, _ = minibatch.train(chunked, "chunk", "x", "y", 3, step, balanced=False)
    half, _ = minibatch.train(chunked.filter("chunk < 2"), "chunk", "x", "y", 3, step, balanced=False)
    rest, _ = minibatch.train(chunked.filter("chunk >= 2"), "chunk", "x", "y", 3, step, balanced=False, start=half)
    assert half.steps == 2 and rest.steps == 5
    assert np.allclose(rest.weights, whole.weights) and np.isclose(rest.bias, whole.bias)


@pytest.mark.parametrize("numbers", [800, 4 * 310, 4_000_000])
def test_blocks_of_any_size_take_the_same_steps(spark, chunked, monkeypatch, numbers):
    """Chunks of 300 and about 133 rows: the larger ones summed by Spark, or some or all of them walked in blocks."""
    monkeypatch.setattr(minibatch, "BLOCK_NUMBERS", numbers)
    step = minibatch.Step(0.7, 0.1, 0.02)
    state, taken = minibatch.train(chunked.repartition(7), "chunk", "x", "y", 3, step, epochs=2)
    got = [(r.step, r.chunk, r.n, r.loss, r.bias, *r.weights) for r in taken.orderBy("step").collect()]
    want = plainly(chunked.collect(), step, 2)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-10)
    assert state.steps == 10


def test_many_small_chunks_need_few_jobs(spark):
    """A job for each of 300 chunks took minutes."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("chunk"), F.array(F.col("id") % 7 - 3.0).alias("x"), (F.col("id") % 2).alias("y"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-small-chunks", "")
    try:
        state, taken = minibatch.train(rows, "chunk", "x", "y", 1)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert state.steps == 300 and taken.count() == 300
    assert len(tracker.getJobIdsForGroup("many-small-chunks")) < 60


def test_vectors_learn_as_arrays_and_scores_rank(chunked):
    state, _ = minibatch.train(chunked, "chunk", "x", "y", 3, minibatch.Step(1.0), epochs=3)
    vectors = chunked.withColumn("x", array_to_vector("x"))
    other, _ = minibatch.train(vectors, "chunk", "x", "y", 3, minibatch.Step(1.0), epochs=3)
    assert np.allclose(state.weights, other.weights)
    scored = minibatch.score(vectors, "x", state)
    assert fairness.auc(scored, actual="y").first().auc_roc > 0.9


def test_odd_rows(spark, chunked):
    schema = "chunk long, x array<double>, y int"
    odd = spark.createDataFrame([(0, [1.0, None], 1), (0, None, 1), (1, [0.0, 1.0], None), (None, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)], schema)
    state, taken = minibatch.train(odd, "chunk", "x", "y", 2, balanced=False)
    assert [(r.step, r.chunk, r.n) for r in taken.orderBy("step").collect()] == [(1, 0, 1), (2, 2, 1)]
    assert state.weights[0] > 0 and state.weights[1] == 0
    nothing, empty = minibatch.train(odd.limit(0), "chunk", "x", "y", 2)
    assert nothing == minibatch.State((0.0, 0.0)) and empty.isEmpty()
    with pytest.raises(Exception, match="has not 4 features"):
        minibatch.train(chunked, "chunk", "x", "y", 4)
    with pytest.raises(ValueError):
        minibatch.train(chunked, "chunk", "x", "y", 3, start=minibatch.State((0.0,)))


def test_extreme_margins_stay_finite(spark):
    rows = spark.createDataFrame([(0, [1e6], 0), (0, [-1e6], 1)], "chunk long, x array<double>, y int")
    state, taken = minibatch.train(rows, "chunk", "x", "y", 1, balanced=False, start=minibatch.State((1.0,)))
    assert taken.first().loss == 1e6 and np.isfinite(state.weights[0])


@pytest.mark.parametrize("how", [{"folds": 3}, {"train_ratio": 0.7}])
def test_search_keeps_its_scores(chunked, how):
    df = chunked.select("id", "y", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.when(F.col("id") % 4 > 0, "k").alias("c"))
    found = modeling.tune(df, "decision_tree", "y", ["a", "b"], ["c"], {"maxDepth": [0, 3]}, "id", **how)
    folds = 3 if "folds" in how else 1
    areas = {(r.fold, r.setting): r.auc for r in found.folds.collect()}
    assert set(areas) == {(f, s) for f in range(folds) for s in (0, 1)}
    for r in fairness.auc(found.scored, ["fold", "setting"]).collect():
        assert r.auc_roc == areas[r.fold, r.setting]
    # a stump of depth 0 gives every row one score
    assert all(areas[f, 0] == 0.5 and areas[f, 1] > 0.8 for f in range(folds))
    n = found.scored.filter("setting = 1").count()
    assert n == found.scored.select("id").distinct().count()
    assert n == 1000 if folds == 3 else 200 < n < 400
    assert found.model.stages[-1].getOrDefault("maxDepth") == 3
    assert [r.params for r in found.settings.orderBy("setting").collect()] == ["maxDepth=0", "maxDepth=3"]


def test_search_without_a_grid(chunked):
    df = chunked.select("id", "y", F.col("x")[0].alias("a"))
    found = modeling.tune(df, "logistic", "y", ["a"], id_column="id", folds=2)
    assert [(r.setting, r.params) for r in found.settings.collect()] == [(0, "")]
