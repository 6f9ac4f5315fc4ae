"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lendlens.llm.common import or_empty
from lendlens.operators.ranks import running_totals
from lendlens.shared import new_path, settle

#: Bytes of text per written file, about.
PIECE_BYTES = 32 << 20
#: Most old and new shards a plan may have; the plan is solved on the driver.
MAX_SHARDS = 4096


def even_capacities(total: int, shards: int) -> list[int]:
    """Shares of ``total`` that differ by one byte at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def solve_transfers(
    sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> dict[tuple[int, int], int]:
    """Cheapest flow of all old bytes into the new capacities: (old, new) -> bytes.

    Successive shortest paths in the residual graph. ``cost`` is per byte; by default a byte that stays
    in its shard is free. The capacities have to hold all bytes.
    """
    n, m = len(sizes), len(capacities)
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards cannot hold the old ones")
    supply, room = list(sizes), list(capacities)
    flow: dict[tuple[int, int], int] = {}
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(supply):
        # nodes: old 0..n-1, new n..n+m-1; a queue-based Bellman-Ford, as returned flow has negative cost
        dist: list[float] = [0 if s else float("inf") for s in supply] + [float("inf")] * m
        came = [-1] * (n + m)
        queue, queued = deque(i for i in range(n) if supply[i]), [bool(s) for s in supply] + [False] * m
        while queue:
            u = queue.popleft()
            queued[u] = False
            if u < n:
                ways = ((n + j, price[u][j]) for j in range(m))
            else:
                ways = ((i, -price[i][u - n]) for i in range(n) if flow.get((i, u - n)))
            for v, c in ways:
                if dist[u] + c < dist[v]:
                    dist[v], came[v] = dist[u] + c, u
                    if not queued[v]:
                        queue.append(v)
                        queued[v] = True
        end = min((n + j for j in range(m) if room[j]), key=lambda v: dist[v])
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        amount = min(supply[path[-1]], room[end - n])
        steps = list(zip(path[1:], path))
        for u, v in steps:
            if u >= n:
                amount = min(amount, flow[v, u - n])
        for u, v in steps:
            if u < n:
                flow[u, v - n] = flow.get((u, v - n), 0) + amount
            else:
                flow[v, u - n] -= amount
        supply[path[-1]] -= amount
        room[end - n] -= amount
    return {k: v for k, v in flow.items() if v}


def affected_shards(transfers: dict[tuple[int, int], int], shards: int) -> list[int]:
    """New shards whose content changes: those that lose or gain a byte."""
    return sorted({x for (i, j), v in transfers.items() if i != j and v for x in (i, j) if x < shards})


def _size(text: Column) -> Column:
    return (F.octet_length(or_empty(text)) + 1).cast("bigint")


def _place(id_column: str, text: str, tie: Column | None) -> dict[str, Column]:
    """Sort key of a row in its old shard: largest first, then by hash, then by ``tie``."""
    key = {"neg": -_size(F.col(text)), "h": F.xxhash64(id_column, text)}
    return key if tie is None else {**key, "tie": tie}


def plan(
    docs: DataFrame, old: Column, shards: int, id_column: str = "doc_id", text: str = "text", tie: Column | None = None
) -> tuple[DataFrame, dict]:
    """Cut points of every old shard, and the transfers they carry out.

    The rows of an old shard are laid out by size, largest first. The first bytes stay, the next blocks
    go to the shards that the flow names; a row belongs to the block that holds its middle, so a block
    misses its bytes by about its smallest rows. One row per old shard and block: ``old``, ``upto``
    (the block's last sort key) and ``shard``.
    """
    place = _place(id_column, text, tie)
    narrow = docs.select(
        old.cast("int").alias("old"), _size(F.col(text)).alias("size"), *[c.alias(k) for k, c in place.items()]
    )
    sums = {r["old"]: r["n"] for r in narrow.groupBy("old").agg(F.sum("size").alias("n")).limit(MAX_SHARDS + 1).collect()}
    if len(sums) > MAX_SHARDS or any(o is None or o < 0 for o in sums):
        raise ValueError(f"old shards have to be numbers from 0, at most {MAX_SHARDS} of them")
    sizes = [sums.get(i, 0) for i in range(max(sums, default=-1) + 1)]
    transfers = solve_transfers(sizes, even_capacities(sum(sizes), shards))
    blocks, at = [], dict.fromkeys(sums, 0)
    for (i, j), v in sorted(transfers.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        blocks.append((i, at[i], at[i] + v, j))
        at[i] += v
    spark = docs.sparkSession
    bounds = spark.createDataFrame(blocks, "old int, lo bigint, hi bigint, shard int")
    laid = running_totals(narrow, list(place), {"end": "size"}, ["old"])
    middle = F.col("end") - F.ceil(F.col("size") / 2)
    cuts = (
        laid.join(bounds, "old")
        .filter((middle >= F.col("lo")) & (middle < F.col("hi")))
        .groupBy("old", "shard")
        .agg(F.max(F.struct(*place)).alias("upto"))
        .groupBy("old")
        .agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("blocks"))  # at most one per new shard
    )
    return settle(cuts), transfers


def assign(
    docs: DataFrame, old: Column, cuts: DataFrame, id_column: str = "doc_id", text: str = "text", tie: Column | None = None
) -> DataFrame:
    """``docs`` with ``__old`` and ``__shard``; each row finds its block in its old shard's few cut points."""
    key = F.struct(*[c.alias(k) for k, c in _place(id_column, text, tie).items()])
    keyed = docs.select("*", old.cast("int").alias("__old"), key.alias("__key"))
    cuts = cuts.select(F.col("old").alias("__o"), "blocks")
    placed = keyed.join(cuts, F.col("__old") == F.col("__o"))
    own = F.get(F.filter("blocks", lambda b: F.col("__key") <= b["upto"]), F.lit(0))["shard"]
    return placed.select(*docs.columns, "__old", own.alias("__shard"))


def row_place() -> Column:
    """File and position of a row of a written table: tells equal rows apart, the same in every pass."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def write_shards(placed: DataFrame, shards: int, only: Sequence[int] | None = None, path: str | None = None, mean_bytes: int = 0) -> str:
    """Write the shards ``only`` (all if None) as folders of files of about :data:`PIECE_BYTES`; returns the path.

    The rows of a shard are dealt evenly over its files, so no file or task holds a shard.
    """
    path = path or new_path(placed.sparkSession)
    pieces = max(1, -(-mean_bytes // PIECE_BYTES))
    if only is not None:
        placed = placed.filter(F.col("__shard").isin(*only) if only else F.lit(False))
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(pieces)).cast("int")
    dealt = placed.repartitionById(shards * pieces, F.col("__shard") * pieces + deal)
    dealt.withColumn("__at", F.col("__shard")).write.partitionBy("__at").parquet(path)
    return path


def read_shards(df: DataFrame) -> DataFrame:
    """Written shards with ``__slot``, the row's place in its shard: files by name, rows by position."""
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = settle(rows.groupBy("__shard", "__file").agg(F.count(F.lit(1)).alias("n")))
    before = W.partitionBy("__shard").orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    starts = settle(files.select(F.col("__file").alias("__f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))
    slot = (F.col("__start") + F.col("__row")).cast("bigint")
    return rows.join(starts, F.col("__file") == F.col("__f")).select(*df.columns, slot.alias("__slot"))


def reshard(
    docs: DataFrame, old: Column, shards: int, id_column: str = "doc_id", text: str = "text", whole: bool = True, tie: Column | None = None,
) -> DataFrame:
    """Put ``docs`` into shards 0 to ``shards`` - 1 of near-equal bytes, moving as few bytes as possible.

    ``old`` gives a row's present shard, a number from 0 (at most :data:`MAX_SHARDS`). A row counts the
    UTF-8 bytes of its text plus one; null counts as empty. Returns the rows read back from the written
    files, with struct column ``__place`` of ``old``, ``shard`` and ``slot`` (gapless from 0 in a
    shard). With ``whole`` false only shards that gain or lose rows are written and returned.
    Rows equal in id and text stay together; all others are split wherever the flow cuts. ``tie``, a column that
    tells equal rows apart and is the same in every pass (see :func:`row_place`), splits them too. Null ids
    and extra columns are carried. An empty table gives no rows.
    """
    cuts, transfers = plan(docs, old, shards, id_column, text, tie)
    placed = assign(docs, old, cuts, id_column, text, tie)
    only = None if whole else affected_shards(transfers, shards)
    path = write_shards(placed, shards, only, mean_bytes=sum(transfers.values()) // shards)
    written = docs.sparkSession.read.schema(placed.schema).parquet(path)
    place = F.struct(F.col("__old").alias("old"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
    return read_shards(written).select(*docs.columns, place.alias("__place"))
