"""Compressing vectors to codes of nearest codebook entries, with norm-of-sum bounds.

Every part of a vector has a codebook that is refined in rounds. A part carries its entry, a bound from
above on the distance to it and one from below on the distance to any other entry, each with the round
it was found in. The codebooks of all rounds are kept, so a later round widens a bound by the net way an
entry has gone since that round, which is never more than the sum of its steps. Only where the bounds
then overlap is the distance to the own entry, and after that to all entries, worked out again; distances are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlens.shared import forget, settle

#: Components have to be smaller than this after scaling, so that squared distances are exact in 64 bits.
LARGEST = 1 << 28
_SLACK = 1e-9  # far above the rounding of a square root, far below a distance of one
_ROWS = 4096


class Compressed(NamedTuple):
    """``codes``: id, keep columns, ``codes`` (one entry number a part) and ``error``; ``codebooks``: part, entry, position."""

    codes: DataFrame
    codebooks: np.ndarray


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows by entries), exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0), 1)
    if 4 * x.shape[1] * int(largest) ** 2 < 1 << 53:  # every term is a whole number that a double holds
        a, b = x.astype(float), entries.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


class Bounds(NamedTuple):
    """State of one part of some rows: entry, bounds and the rounds these were found in."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_at: np.ndarray
    lower_at: np.ndarray


def scan(x: np.ndarray, entries: np.ndarray, now: int) -> Bounds:
    """Nearest entries by comparison with all, ties to the lower number."""
    entry, upper, lower = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    for lo in range(0, len(x), _ROWS):
        part = slice(lo, lo + _ROWS)
        d = distances(x[part], entries)
        entry[part] = d.argmin(1)
        best = np.partition(d, 1, axis=1) if d.shape[1] > 1 else d
        upper[part] = np.sqrt(best[:, 0])
        if d.shape[1] > 1:
            lower[part] = np.sqrt(best[:, 1])
    at = np.full(len(x), now, dtype=np.int64)
    return Bounds(entry, upper, lower, at, at)


def net_moves(history: np.ndarray) -> np.ndarray:
    """Distance of every entry now from where it was in each round (round by entry)."""
    gone = (history[-1] - history).astype(float)
    return np.sqrt((gone * gone).sum(-1))


def farthest_other(moves: np.ndarray) -> np.ndarray:
    """For every round and entry, the longest net move among the other entries."""
    if moves.shape[1] == 1:
        return np.zeros_like(moves)
    top = np.argsort(moves, axis=1)[:, -2:]
    values = np.take_along_axis(moves, top, axis=1)
    return np.where(np.arange(moves.shape[1]) == top[:, 1:], values[:, :1], values[:, 1:])


def update(x: np.ndarray, history: np.ndarray, old: Bounds) -> tuple[Bounds, int]:
    """Nearest entries of the last codebook of ``history``, and how many rows were compared with all entries."""
    now, entries = len(history) - 1, history[-1]
    moves = net_moves(history)
    others = farthest_other(moves)
    entry, upper, upper_at = old.entry.copy(), old.upper.copy(), old.upper_at.copy()
    lower, lower_at = old.lower.copy(), old.lower_at.copy()
    least = lower - others[lower_at, entry]
    apart = lambda most, least: most * (1 + _SLACK) + _SLACK < least * (1 - _SLACK)
    doubt = np.flatnonzero(~apart(upper + moves[upper_at, entry], least))
    own = ((x[doubt] - entries[entry[doubt]]) ** 2).sum(1)
    upper[doubt], upper_at[doubt] = np.sqrt(own), now
    doubt = doubt[~apart(upper[doubt], least[doubt])]
    found = scan(x[doubt], entries, now)
    for mine, new in zip((entry, upper, lower, upper_at, lower_at), found):
        mine[doubt] = new
    return Bounds(entry, upper, lower, upper_at, lower_at), len(doubt)


_STATE = {"codes": pa.int64(), "upper": pa.float64(), "lower": pa.float64(), "upper_at": pa.int64(), "lower_at": pa.int64()}
_STATE_SQL = "codes array<bigint>, upper array<double>, lower array<double>, upper_at array<bigint>, lower_at array<bigint>"


def _rows(column, width: int, kind) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(matrix.ravel(), type=kind))


def _assign(rows: DataFrame, keep: list[str], history: np.ndarray, first: bool) -> DataFrame:
    """Rows with the state and the error for the last codebooks of ``history`` (round, part, entry, position)."""
    _, parts, _, width = history.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            x = _rows(batch.column("x"), parts * width, np.int64).reshape(n, parts, width)
            states = []
            for p in range(parts):
                if first:
                    states.append(scan(x[:, p], history[-1, p], 0))
                else:
                    old = Bounds(*[_rows(batch.column(c), parts, kind.to_pandas_dtype())[:, p] for c, kind in _STATE.items()])
                    states.append(update(x[:, p], history[:, p], old)[0])
            error = sum(((x[:, p] - history[-1, p][s.entry]) ** 2).sum(1) for p, s in enumerate(states))
            columns = [batch.column(c) for c in [*keep, "x"]]
            columns += [_lists(np.stack([s[i] for s in states], axis=1), kind) for i, kind in enumerate(_STATE.values())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(error, type=pa.int64())], names=[*keep, "x", *_STATE, "error"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, "x"])
    return rows.mapInArrow(of, f"{schema}, {_STATE_SQL}, error bigint")


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """Number of parts at every entry and their component sums (part, entry, 1 + position); whole numbers.

    Each task sends a row per entry and position at most, so what comes back has the size of the codebooks.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), dtype=np.int64)
        for batch in batches:
            x = _rows(batch.column("x"), parts * width, np.int64).reshape(len(batch), parts, width)
            codes = _rows(batch.column("codes"), parts, np.int64)
            for p in range(parts):
                np.add.at(total[p, :, 0], codes[:, p], 1)
                np.add.at(total[p, :, 1:], codes[:, p], x[:, p])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "s"])

    found = state.select("x", "codes").mapInArrow(of, "at bigint, s bigint").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(parts * entries * (1 + width), dtype=np.int64)
    for r in found:
        out[r["at"]] = r["s"]
    return out.reshape(parts, entries, 1 + width)


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    keep: tuple[str, ...] = ("label",),
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> Compressed:
    """Codes of all vectors after ``rounds`` of refining the codebooks, and the codebooks.

    Components become ``floor(scale * x)``; a part's codebook starts as that part of the ``entries`` vectors
    with the smallest ids (ties by content, null ids last) and has fewer entries if there are fewer vectors. A
    round gives each part its nearest entry, ties to the lower number, then replaces an entry by the
    floored mean of its parts; unused entries stay. Codes and errors belong to the last codebooks.

    Left out are null vectors and those with null or non-finite components. Repeated rows get the same
    answer; an empty table gives no rows and codebooks without entries. All vectors left need one length that
    ``parts`` divides and scaled components below :data:`LARGEST`; others raise an error. ``id`` and
    the columns of ``keep`` come back as ``id`` and ``keep_0``, …, whatever they are called; further columns are ignored.

    The vectors are rewritten with their state each round and the copy before is deleted. Codebooks and
    their history (``rounds + 1`` of them) are all that a task holds besides its batch.
    """
    named = [f"keep_{i}" for i in range(len(keep))]
    rows = vectors.select(
        F.col(id_column).alias("id"), *[F.col(c).alias(n) for c, n in zip(keep, named)], F.col(vector).cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) * scale < LARGEST, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit(f"components have to be below {LARGEST} after scaling")).cast("bigint")
    )
    rows = rows.filter(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    state = settle(rows.select("id", *named, F.transform("v", whole).alias("x")))
    least, most = state.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least is None:
        none = state.select("id", *named, F.array().cast("array<bigint>").alias("codes"), F.lit(0).cast("bigint").alias("error"))
        return Compressed(none, np.zeros((parts, 0, 0), dtype=np.int64))
    if least != most or least % parts:
        raise ValueError(f"vectors need one length that {parts} divides; found {least} to {most}")
    width = least // parts
    seeds = state.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    books = np.array([r["x"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, width).swapaxes(0, 1)
    history = [books]
    for now in range(rounds + 1):
        after = settle(_assign(state, ["id", *named], np.stack(history), now == 0))
        forget(state)
        state = after
        if now < rounds:
            total = _sums(state, parts, len(seeds), width)
            n, sums = total[:, :, :1], total[:, :, 1:]
            history.append(np.where(n > 0, sums // np.maximum(n, 1), history[-1]))  # // floors
    return Compressed(state.select("id", *named, "codes", "error"), history[-1])


def hex_codes(codes: str = "codes"):
    """Two lower-case hex digits a part."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_group_error(codes: DataFrame, group: str, name: str) -> DataFrame:
    """``codes`` with the error summed over all rows with an equal ``group``, nulls together."""
    total = settle(codes.groupBy(F.struct(F.col(group).alias("g")).alias("__g")).agg(F.sum("error").alias(name)))
    return codes.withColumn("__g", F.struct(F.col(group).alias("g"))).join(total, "__g").drop("__g")
