"""Logistic regression learned chunk by chunk.

A chunk is a mini-batch of any size, and one step is taken per chunk, in the order of the chunk numbers
(:func:`sampling.interleave` deals classes evenly over them). The gradient of a large chunk is summed over
all of its rows by Spark. Small chunks, each of which would cost a job of its own, are walked one after the
other in blocks of bounded size, a job per block; a step needs the weights that the step before it left, so
there is nothing to do side by side in them. Training can stop after any chunk and go on later from the state
it had.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlens.operators.fairness import with_class_weights
from lendlens.operators.ranks import slice_of
from lendlens.shared import delete_path, forget, new_path, settle

#: Numbers (rows times their width) of a block: about a second's work of one task. A larger chunk is a block by itself.
BLOCK_NUMBERS = 4_000_000
_SUMS = "gradient array<double>, pull double, weight double, loss double, n bigint"
_STEPS = "step bigint, chunk bigint, n bigint, loss double, bias double, weights array<double>"


@dataclass(frozen=True)
class State:
    """What has been learned after ``steps`` chunks."""

    weights: tuple[float, ...]
    bias: float = 0.0
    steps: int = 0


@dataclass(frozen=True)
class Step:
    """Size of a step: ``rate / (1 + decay * steps)``, and an L2 ``penalty`` on the weights."""

    rate: float = 0.1
    decay: float = 0.0
    penalty: float = 0.0

    def apply(self, state: State, gradient: np.ndarray, pull: float) -> State:
        """State after a step down the mean gradient of a chunk."""
        weights, bias = _stepper(self)(np.asarray(state.weights), state.bias, state.steps, gradient, pull)
        return State(tuple(float(w) for w in weights), float(bias), state.steps + 1)


def _stepper(step: Step):
    """:meth:`Step.apply` on plain numbers; like :func:`_summing` made anew, so that tasks do not need this package."""
    rate, decay, penalty = step.rate, step.decay, step.penalty

    def apply(weights, bias, steps, gradient, pull):
        size = rate / (1 + decay * steps)
        return weights - size * (gradient + penalty * weights), bias - size * pull

    return apply


def as_array(df: DataFrame, features: str) -> Column:
    """The feature column as an array of doubles, whether it is an array or a vector."""
    c = F.col(features)
    return c.cast("array<double>") if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(c)


def _summing():
    """Function of a batch: gradient, pull on the bias, weight, loss and rows, summed over its rows."""

    def sums(b: pa.RecordBatch, weights: np.ndarray, bias: float) -> tuple:
        x = b.column("x")
        if not (pc.list_value_length(x).to_numpy(zero_copy_only=False) == len(weights)).all():
            raise ValueError(f"a row has not {len(weights)} features")
        flat = x.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(x), len(weights))
        y, w = b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False)
        margin = flat @ weights + bias
        # exp never overflows here: its argument is not positive
        small = np.exp(-np.abs(margin))
        chance = np.where(margin >= 0, 1 / (1 + small), small / (1 + small))
        error = w * (chance - y)
        loss = w * (np.maximum(margin, 0) - margin * y + np.log1p(small))
        return error @ flat, float(error.sum()), float(w.sum()), float(loss.sum()), len(y)

    return sums


def gradient_sums(batch: DataFrame, state: State) -> DataFrame:
    """One row of sums over ``batch`` (columns ``x``, ``y``, ``w``): gradient, pull on the bias, weight, loss, rows.

    Every task reduces its rows to one row of sums, so what is shuffled is as wide as the weights
    and as long as the tasks. A row of another length than the weights fails the job; a null in a
    feature counts as 0, rows without label or features are left out.
    """
    weights, bias, sums_of = np.asarray(state.weights, dtype="float64"), state.bias, _summing()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, pull, weight, loss, n = np.zeros(len(weights)), 0.0, 0.0, 0.0, 0
        for b in batches:
            gradient, pull, weight, loss, n = (a + s for a, s in zip((gradient, pull, weight, loss, n), sums_of(b, weights, bias)))
        row = {"gradient": [gradient.tolist()], "pull": [pull], "weight": [weight], "loss": [loss], "n": [n]}
        yield pa.RecordBatch.from_pydict(row)

    sums = batch.filter("x IS NOT NULL AND y IS NOT NULL").mapInArrow(reduce, _SUMS)
    totals = sums.select("pull", "weight", "loss", "n", F.posexplode("gradient").alias("at", "g")).groupBy("at").agg(
        *[F.sum(c).alias(c) for c in ("g", "pull", "weight", "loss", "n")]
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "g")))  # one entry per weight
    return totals.agg(
        F.transform(ordered, lambda t: t["g"]).alias("gradient"),
        *[F.max(c).alias(c) for c in ("pull", "weight", "loss", "n")],
    )


def walk_block(block: DataFrame, state: State, step: Step) -> DataFrame:
    """One row per step over the chunks of ``block`` (columns ``chunk``, ``x``, ``y``, ``w``), in their order.

    One task takes the whole block, row batch by row batch, so a block is to be small. Rows count as in
    :func:`gradient_sums`.
    """

    sums_of, step_down, begin = _summing(), _stepper(step), (np.asarray(state.weights, dtype="float64"), state.bias)
    steps = state.steps
    names = ["step", "chunk", "n", "loss", "bias", "weights"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), at, taken = begin, steps, []

        def parts():
            """Each batch's stretches of one chunk, and a last one without rows."""
            for b in batches:
                chunks = b.column("chunk").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
                yield from ((int(chunks[lo]), b.slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:]) if lo < hi)
            yield None, None

        number, sums = None, None
        for chunk, part in parts():
            if chunk != number:
                if sums is not None and sums[2]:
                    gradient, pull, weight, loss, n = sums
                    weights, bias = step_down(weights, bias, at, gradient / weight, pull / weight)
                    at += 1
                    taken.append((at, number, n, loss / weight, float(bias), weights.tolist()))
                number, sums = chunk, (np.zeros(len(weights)), 0.0, 0.0, 0.0, 0)
            if part is not None:
                sums = tuple(a + s for a, s in zip(sums, sums_of(part, weights, bias)))
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in taken], kind) for i, kind in enumerate(types)], names)

    usable = block.filter("x IS NOT NULL AND y IS NOT NULL").select("chunk", "x", "y", "w")
    return usable.coalesce(1).sortWithinPartitions("chunk").mapInArrow(walk, _STEPS)


def _blocks(sizes: Sequence[tuple[int, int]], most: int) -> list[list[int]]:
    """Consecutive chunks of (chunk, rows) together up to ``most`` rows, a larger one by itself."""
    blocks, held = [], 0
    for chunk, rows in sizes:
        if not blocks or held + rows > most:
            blocks.append([])
            held = 0
        blocks[-1].append(chunk)
        held += rows
    return blocks


def _in_blocks(rows: DataFrame, blocks: Sequence[Sequence[int]], large: Sequence[bool], path: str) -> None:
    """Write ``rows`` in one folder per block: a block of small chunks by one task, a large chunk by all."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = settle(spark.createDataFrame([([b[0] for b in blocks[1:]], list(large))], "cuts array<bigint>, large array<boolean>"))
    placed = rows.withColumn("__bounds", bounds.select(F.struct("cuts", "large")).scalar())
    placed = placed.withColumn("block", slice_of(F.col("chunk"), F.col("__bounds.cuts"), len(blocks)))
    # rows of one file in turn, whatever they hold
    turn = F.when(F.get("__bounds.large", F.col("block")), F.monotonically_increasing_id() % n).otherwise(0)
    spread = placed.withColumn("__turn", turn).repartition(max(n, len(blocks)), "block", "__turn")
    spread.drop("__bounds", "__turn").write.partitionBy("block").parquet(path)
    forget(bounds)


def train(
    df: DataFrame,
    chunk: str,
    features: str,
    label: str,
    n_features: int,
    step: Step = Step(),
    balanced: bool = True,
    epochs: int = 1,
    start: State | None = None,
) -> tuple[State, DataFrame]:
    """Walk the chunks of ``df`` in order, ``epochs`` times, from ``start`` or from zero.

    ``balanced`` weights the classes equally, over all rows. The rows are settled, then written once more in
    blocks of up to :data:`BLOCK_NUMBERS` numbers, of whole chunks, one folder each. A block of several chunks is
    walked by one task; the gradient of a chunk that is larger by itself is summed by all.
    Returns the last state and one row per step: ``step``, ``chunk``, ``n``, mean ``loss`` before the
    step, and ``bias`` and ``weights`` after it. Chunks without usable rows take no step.
    """
    if n_features < 1:
        raise ValueError("there are no features")
    spark = df.sparkSession
    state = start or State((0.0,) * n_features)
    if len(state.weights) != n_features:
        raise ValueError(f"the state has {len(state.weights)} weights, the rows have {n_features} features")
    weighted = with_class_weights(df, label, "__weight") if balanced else df.withColumn("__weight", F.lit(1.0))
    narrow = weighted.select(
        F.col(chunk).cast("bigint").alias("chunk"),
        as_array(df, features).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.coalesce(F.col("__weight").cast("double"), F.lit(0.0)).alias("w"),
    )
    rows = settle(narrow.filter("chunk IS NOT NULL"))
    counted = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted((r["chunk"], r["n"]) for r in counted.collect())  # a row per step of the walk
    most = max(1, BLOCK_NUMBERS // (n_features + 1))
    blocks = _blocks(sizes, most)
    count = dict(sizes)
    large = [len(b) == 1 and count[b[0]] > most for b in blocks]
    path = new_path(spark)
    if blocks:
        _in_blocks(rows, blocks, large, path)
    forget(rows)
    history = []
    for number in list(range(len(blocks))) * epochs:
        mine = spark.read.schema(narrow.schema).parquet(f"{path}/block={number}")
        if large[number]:
            found = gradient_sums(mine.select("x", "y", "w"), state).first()
            if not found["weight"]:
                continue
            state = step.apply(state, np.asarray(found["gradient"]) / found["weight"], found["pull"] / found["weight"])
            history.append((state.steps, blocks[number][0], found["n"], found["loss"] / found["weight"], state.bias, list(state.weights)))
        else:
            taken = [tuple(r) for r in walk_block(mine, state, step).collect()]  # a row per step
            if taken:
                history += taken
                state = State(tuple(taken[-1][5]), taken[-1][4], taken[-1][0])
    delete_path(spark, path)
    kept = spark.createDataFrame(history, _STEPS)
    return state, kept


def score(df: DataFrame, features: str, state: State, name: str = "score") -> DataFrame:
    """``df`` with the chance of the positive class; nulls in features count as 0."""
    weights = F.array(*[F.lit(w) for w in state.weights])
    products = F.zip_with(as_array(df, features), weights, lambda x, w: F.coalesce(x, F.lit(0.0)) * w)
    margin = F.aggregate(products, F.lit(float(state.bias)), lambda acc, p: acc + p)
    return df.withColumn(name, 1 / (1 + F.exp(-margin)))
