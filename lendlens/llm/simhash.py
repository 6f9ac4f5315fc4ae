"""Near-duplicate documents by SimHash fingerprints, with pigeonring filtering of the candidates.

The 64 bits are cut into a ring of eight segments. If two fingerprints differ in at most three bits, the
ring has a place from which every run of consecutive segments stays within its proportional budget: the
first ``l`` segments differ in at most ``3 l / 8`` bits, rounded down. So two segments are equal, and of the
three that follow at most one differs. The equal ones make a key of 32 bits by which candidates meet;
pairs that break the budget of a longer chain are dropped before all 64 bits are compared.

A key with many fingerprints is not compared as it is: the same ring is laid over its 32 free bits, which
gives keys of 48 bits. Only 16 bits are free then, so no group has more than 65,536 members.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.lsh_forest import components
from lendlens.shared import forget, settle

SHINGLE, SEED = 3, 42
BITS, BUDGET, SEGMENTS = 64, 3, 8
#: Fingerprints of one key that are compared pair by pair; larger groups get longer keys.
GROUP = 1024
_PIECE = 1 << 20  # bytes of text that are split into words at a time
_SPACES = b" \t\n\v\f\r"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + _PIECE)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[begin:end].split()
        begin = end


def fingerprint(text: str | None) -> int:
    """64 bits; one is set if it is set in over half the hashes of the text's shingles, repeats included.

    Words are runs of anything but space and tab to carriage return, after lower-casing A-Z. A text of
    fewer than three words has its whole sequence as one shingle; null, empty and blank ones give zero.
    """
    votes, n = np.zeros(BITS, dtype=np.int64), 0

    def count(hashes: list[int]) -> None:
        nonlocal votes, n
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)

    words: list[bytes] = []
    for piece in _pieces((text or "").encode("utf-8", "replace").lower()):
        words += piece
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends - sizes).tolist(), ends[SHINGLE - 1 :].tolist())
            count([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans])
            words = words[1 - SHINGLE :]
    if n == 0 and words:
        count([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed number, of every row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch["text"].tolist()], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": values.view(np.int64)})

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(of, f"doc_id {dict(docs.dtypes)[id_column]}, fp bigint")


def ring(bits: Sequence[int]) -> list[tuple[int, list[int]]]:
    """(bits that have to be equal, bits of the chains of 1, 2, … segments) for every start and skipped segment.

    ``bits`` are the positions that the ring is laid over, in order.
    """
    width = len(bits) // SEGMENTS
    segments = [sum(1 << b for b in bits[i * width : (i + 1) * width]) for i in range(SEGMENTS)]
    budgets = [BUDGET * size // SEGMENTS for size in range(1, SEGMENTS + 1)]
    equal, one = budgets.count(0), budgets.count(1)  # segments without a difference, then with one at most
    out = []
    for start in range(SEGMENTS):
        order = segments[start:] + segments[:start]
        chains = [sum(order[:size]) for size in range(1, SEGMENTS + 1)]
        for skipped in order[equal : equal + one]:
            out.append((sum(order[: equal + one]) - skipped, chains))
    return out


_FIRST = ring(range(BITS))
_SECOND = [ring([b for b in range(BITS) if not mask >> b & 1]) for mask, _ in _FIRST]
_CHAIN_BUDGETS = np.array([BUDGET * size // SEGMENTS for size in range(1, SEGMENTS + 1)] * 2)
#: Chains by ring number: the rings over all bits, then those over the free bits of each of these.
_CHAINS = np.array(
    [chains * 2 for _, chains in _FIRST] + [chains + own for (_, chains), inner in zip(_FIRST, _SECOND) for _, own in inner],
    dtype=np.uint64,
)
_EQUAL = [mask for mask, _ in _FIRST] + [mask | own for (mask, _), inner in zip(_FIRST, _SECOND) for own, _ in inner]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _pairs_of_small(fp: np.ndarray, kind: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of places; all groups at once, by the distance of two members in their group."""
    live, step = np.arange(len(fp)), 0
    while True:
        step += 1
        live = live[live + step < end[live]]
        if not len(live):
            return
        i = live
        differing = fp[i] ^ fp[i + step]
        for chains, budget in zip(_CHAINS.T, _CHAIN_BUDGETS):
            near = np.bitwise_count(differing & chains[kind[i]]) <= budget
            i, differing = i[near], differing[near]
        near = np.bitwise_count(differing) <= BUDGET
        yield i[near], i[near] + step


def _pairs_of_large(fp: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of places of one sorted group, by looking up each fingerprint with up to three free bits turned."""
    free = [1 << b for b in range(BITS) if not _EQUAL[kind] >> b & 1]
    for k in range(1, BUDGET + 1):
        for bits in combinations(free, k):
            other = fp ^ np.uint64(sum(bits))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            i = np.flatnonzero((fp[at] == other) & (other > fp))
            yield i, at[i]


def _stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(centre, member) places that connect what the pairs connect: fewer than members, however many pairs there are."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of the groups; rows come sorted by ring, key and fingerprint."""

    def of(kind: np.ndarray, fp: np.ndarray, new: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        end = np.repeat(starts + sizes, sizes)
        large = np.repeat(sizes > GROUP, sizes)
        found = [_stars(len(fp), _pairs_of_small(fp, kind, np.where(large, 0, end)))]
        for lo, size in zip(starts[sizes > GROUP], sizes[sizes > GROUP]):
            centre, member = _stars(size, _pairs_of_large(fp[lo : lo + size], int(kind[lo])))
            found.append((centre + lo, member + lo))
        centre, member = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": fp[centre].view(np.int64), "b": fp[member].view(np.int64)}).drop_duplicates()

    waiting: pd.DataFrame | None = None
    for batch in batches:
        waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        kind, key = waiting["ring"].to_numpy(), waiting["key"].to_numpy()
        new = np.append(True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))
        cut = int(np.flatnonzero(new)[-1])  # the last group may go on
        if cut:
            yield of(kind[:cut], waiting["fp"].to_numpy()[:cut].view(np.uint64), new[:cut])
            waiting = waiting.iloc[cut:].reset_index(drop=True)
    if waiting is not None and len(waiting):
        kind, new = waiting["ring"].to_numpy(), np.zeros(len(waiting), dtype=bool)
        new[0] = True
        yield of(kind, waiting["fp"].to_numpy().view(np.uint64), new)


def _keys(masks: Sequence[Column]) -> Column:
    """(place, key) of every mask."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(m).alias("key")) for i, m in enumerate(masks)]))


def linked(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all that differ in at most three bits.

    ``nodes`` is read twice. Of a group only a spanning star leaves its task.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def groups(rows: DataFrame) -> DataFrame:
        sorted_rows = rows.repartition(n, "ring", "key").sortWithinPartitions("ring", "key", "fp")
        return sorted_rows.select("ring", "key", "fp").mapInPandas(_link, "a bigint, b bigint")

    rows = nodes.select("fp", _keys([F.lit(_signed(m)) for m, _ in _FIRST]).alias("k"))
    rows = rows.select(F.col("k.place").alias("ring"), "k.key", "fp")
    hot = settle(rows.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("ring", "key"))
    if hot.isEmpty():
        return groups(rows).distinct()
    inner = [
        F.element_at(F.array(*[F.lit(_signed(mask | ring_[s][0])) for (mask, _), ring_ in zip(_FIRST, _SECOND)]), F.col("ring") + 1)
        for s in range(len(_FIRST))
    ]
    deep = rows.join(hot, ["ring", "key"], "left_semi").select("ring", "fp", _keys(inner).alias("k"))
    number = (len(_FIRST) + F.col("ring") * len(_FIRST) + F.col("k.place")).alias("ring")
    deep = deep.select(number, "k.key", "fp")
    return groups(rows.join(hot, ["ring", "key"], "left_anti")).union(groups(deep)).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fingerprint`` (16 hex digits) and component_id.

    Rows are linked if their fingerprints differ in at most three bits; ``component_id`` is the smallest id
    connected by links. Null, empty and blank texts have fingerprint zero and are linked like any other.
    Repeated rows get the same answer, and very long texts are hashed piece by piece. Null ids name a
    component only if all its ids are null. Other columns are ignored; an empty table gives no rows.

    Rows with one fingerprint are one node from the start, so copies cost nothing after that.
    """
    rows = settle(fingerprints(docs, id_column, text))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    edges = settle(linked(nodes.select("fp")))
    roots = components(edges)
    # a fingerprint that one row has and no other is near names itself
    named = settle(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .filter("n > 1 OR root IS NOT NULL")
        .select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = settle(named.join(smallest, "root").select("fp", "component_id"))
    forget(nodes, edges, named)
    text_of = F.lpad(F.lower(F.hex("fp")), BITS // 4, "0")
    out = rows.join(answer, "fp", "left")
    return out.select("doc_id", text_of.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
