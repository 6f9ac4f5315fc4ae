"""Near-duplicate documents by banded LSH of MinHash signatures, in place of an LSH forest.

Every tree reads the signatures from its own offset. Documents that agree on its first :data:`DEPTH`
values, a band, form a region; the depth is fixed and neighbours by longest common prefix are not sought; a region that is too large for one block is sorted by the whole order
and cut by rank, so that a block is bounded however alike its texts are. Inside a block, links are
decided on full shingle sets, and only a spanning star of each linked set leaves the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.common import or_empty
from lendlens.llm.rolling import Stretches, mixed
from lendlens.operators.ranks import running_totals
from lendlens.shared import settle

SHINGLE = 5
#: Orders of the forest and values that make a region; a pair of similarity s shares none with
#: probability (1 - s ** DEPTH) ** TREES, 2e-6 at 0.75.
TREES, DEPTH = 24, 3
#: Nodes and shingles of a slice of a region, at most; a node with more shingles is a slice of its own, or ends one.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
#: Cells of the 0/1 matrix of a block, at most; larger blocks are compared by lists.
MATRIX_CELLS = 1 << 24
_FIRST = 8  # sets of a block that are compared with all before the others
_CHUNK = 1 << 19  # bytes of text that are hashed at a time
_SLICE_ROWS, _SLICE_CHARS = 512, 1 << 21  # texts whose sets are worked out at a time, and their characters
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _word_hashes(data: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, end to end, and the text each belongs to."""
    flat = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    space = _SPACE[flat]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = Stretches(flat).hash(starts, ends)
    text_ends = np.cumsum([len(d) + 1 for d in data])
    return words, np.searchsorted(text_ends, starts, side="right")


def shingle_sets(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs of anything but space and tab to carriage return, after lower-casing A-Z. A text of
    fewer than five words has its whole sequence as one shingle; null, empty or blank ones have none.
    """
    out: list[np.ndarray] = []
    data = [b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]
    begin = size = 0
    for i in range(len(data) + 1):
        if i == len(data) or (i > begin and size + len(data[i]) > _CHUNK):
            if i > begin:
                out += _sets(data[begin:i])
            begin, size = i, 0
        if i < len(data):
            size += len(data[i])
    return out


def _sets(data: Sequence[bytes]) -> list[np.ndarray]:
    words, owner = _word_hashes(data)
    first = np.searchsorted(owner, np.arange(len(data) + 1))
    total = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        total = total * _MIX + words[k : k + len(total)]
    total = mixed(total)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            sets.append(np.unique(total[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = short * _MIX + w
            sets.append(mixed(np.array([short], dtype=np.uint64)))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def signatures(sets: Sequence[np.ndarray], values: int = TREES * DEPTH) -> np.ndarray:
    """MinHash values (rows by sets) as 32-bit integers; the sets must not be empty."""
    factors = np.random.default_rng(11).integers(1, 1 << 62, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), values), dtype=np.int32)
    for k, a in enumerate(factors):
        out[:, k] = (np.minimum.reduceat(flat * a, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def linked_stars(sets: Sequence[np.ndarray], probes: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """Star edges (centre, member) of the sets that are connected by links, decided on the full sets.

    Two sets are linked if 100 times their intersection is at least 75 times their union. Shingles of
    one set alone are left out of the products; the others make a 0/1 matrix if it stays small, and
    lists by shingle otherwise. A few sets are compared with all first; the largest set of linked ones
    is then connected already, so only the others are compared with all. With ``probes`` just these are
    compared with all.
    """
    g = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    if g == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 175 * both >= 75 * n.sum() else []
    owner = np.repeat(np.arange(g), n)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    number = np.cumsum(times > 1) - 1
    token, vocabulary = number[token], int((times > 1).sum())
    root = np.arange(g)
    if vocabulary == 0:
        return []
    if g * vocabulary <= MATRIX_CELLS:
        matrix = np.zeros((g, vocabulary), dtype=np.float32)
        matrix[owner, token] = 1
        near = lambda i: 175 * (matrix[i] @ matrix.T) >= 75 * (n[i][:, None] + n[None, :])
        step = 256
    else:
        by = np.argsort(token, kind="stable")
        lists = np.split(owner[by], np.cumsum(np.bincount(token, minlength=vocabulary))[:-1])
        own = np.split(token, np.cumsum(np.bincount(owner, minlength=g))[:-1])

        def near(i: np.ndarray) -> np.ndarray:
            rows = [np.bincount(np.concatenate([lists[t] for t in own[k]] or [np.empty(0, int)]), minlength=g) for k in i]
            return 175 * np.stack(rows) >= 75 * (n[i][:, None] + n[None, :])

        step = 16
    def meet(i: np.ndarray) -> None:
        for k, row in zip(i, near(i)):
            # relabel every root met by this row to the smallest one
            met = np.unique(root[row])
            if len(met) and (len(met) > 1 or met[0] != root[k]):
                met = np.union1d(met, root[k])
                root[np.isin(root, met)] = met[0]

    if probes is None:
        meet(np.unique(np.linspace(0, g - 1, min(g, _FIRST)).astype(int)))
        main = np.bincount(root).argmax()  # a root is a member of its set
        todo = np.flatnonzero(root != root[main])
    else:
        main, todo = None, np.asarray(probes, dtype=int)
    for lo in range(0, len(todo), step):
        i = todo[lo : lo + step]
        meet(i if main is None else i[root[i] != root[main]])
    return [(int(root[k]), k) for k in range(g) if root[k] != k]


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smaller batches, so that the sets of few texts are held at a time, however long the texts are.

    A text of more than :data:`_SLICE_CHARS` characters is a slice of its own.
    """
    for batch in batches:
        lo = chars = 0
        for i, text in enumerate(batch["text"]):
            own = len(text or "")
            if i > lo and (i - lo == _SLICE_ROWS or chars + own > _SLICE_CHARS):
                yield batch.iloc[lo:i]
                lo, chars = i, 0
            chars += own
        if lo < len(batch):
            yield batch.iloc[lo:]


def sketch(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``k`` (MD5 of id and text), n_shingles, node and sig.

    ``node`` is a 128-bit digest of the shingle set, so texts with equal sets share it; node and sig are
    null without shingles.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_column]}, k string, n_shingles bigint, node binary, sig array<int>"

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            sets = shingle_sets(batch["text"].tolist())
            nodes: list = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sigs: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            for lo in range(0, len(full), 256):
                part = full[lo : lo + 256]
                for i, s in zip(part, signatures([sets[i] for i in part])):
                    sigs[i] = s
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].array, "k": batch["k"].array, "n_shingles": [len(s) for s in sets], "node": nodes, "sig": sigs}
            )

    return docs.select(F.col(id_column).alias("doc_id"), row_key(id_column, text).alias("k"), F.col(text).cast("string").alias("text")).mapInPandas(of, schema)


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """Names a row by id and text; rows equal in both share it."""
    parts = F.coalesce(F.col(id_column).cast("string"), F.lit("-")), or_empty(F.col(text))
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def regions(classes: DataFrame) -> DataFrame:
    """Members (bucket, tree, large, node) of every region with two nodes or more; ``large`` ones need cutting."""
    tree = lambda t, k: F.get(F.col("sig"), F.lit((t * DEPTH + k) % (TREES * DEPTH)))
    orders = F.array(
        *[
            F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *[tree(t, k) for k in range(DEPTH)]).alias("bucket"))
            for t in range(TREES)
        ]
    )
    rows = classes.select("node", "n_shingles", F.explode(orders).alias("o")).select("node", "n_shingles", "o.*")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("g"), F.sum("n_shingles").alias("s")).filter("g > 1")
    sizes = sizes.select("bucket", ((F.col("g") > BLOCK_ROWS) | (F.col("s") > BLOCK_SHINGLES)).alias("large"))
    return rows.join(sizes, "bucket").select("bucket", "tree", "large", "node")


def cut_evenly(members: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``members`` with ``name``, the number of a row's slice of its bucket in ``order``, which has to be total.

    A slice has at most :data:`BLOCK_ROWS` rows, and its last row begins within :data:`BLOCK_SHINGLES`
    shingles of it, however alike the rows are.
    """
    counted = members.withColumn("__one", F.lit(1).cast("bigint"))
    laid = running_totals(counted, order, {"__at": "__one", "__upto": "n_shingles"}, ["bucket"])
    # both terms never fall along the order, so their sum names each pair of them
    own = F.floor((F.col("__at") - 1) / BLOCK_ROWS) + F.floor((F.col("__upto") - F.col("n_shingles")) / BLOCK_SHINGLES)
    return laid.select(*members.columns, own.cast("bigint").alias(name))


def slices(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (bucket, block, node, n_shingles) of large regions, cut in the order of their signatures.

    The order reads the whole signature from the tree's own offset, ties by the node.
    """
    around = F.slice(F.concat("sig", "sig"), F.col("tree") * DEPTH + DEPTH + 1, F.lit((TREES - 1) * DEPTH))
    rows = large.join(classes.select("node", "sig", "n_shingles"), "node")
    rows = rows.select("bucket", around.alias("around"), "node", "n_shingles")
    return cut_evenly(rows, ["around", "node"], "block").select("bucket", "block", "node", "n_shingles")


def leaders(cut: DataFrame) -> DataFrame:
    """Two nodes of every large region as members of each of its slices, so that groups of near copies meet."""
    ends = cut.groupBy("bucket").agg(F.array(F.min("node"), F.max("node")).alias("nodes"), F.max("block").alias("last"))
    each = ends.select("bucket", F.explode("nodes").alias("node"), F.sequence(F.lit(0).cast("bigint"), "last").alias("blocks"))
    return each.select("bucket", F.explode("blocks").alias("block"), "node")


def unsettled_pairs(cut: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Members (bucket, block, node, probe) that still have to be compared across slices; None if nothing is left.

    In each large region the nodes outside its largest component are cut into slices themselves, and each
    of these meets every slice of the region. All other pairs of nodes are connected already.
    """
    labelled = settle(cut.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    counts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("parts"))
    main = settle(main.filter("parts > 1").select("bucket", F.col("m.root").alias("main")))
    if main.isEmpty():
        return None
    rest = labelled.join(main, "bucket").filter("root != main").select("bucket", "block", "node", "n_shingles")
    rest = settle(cut_evenly(rest, ["block", "node"], "probe_block").select("bucket", "probe_block", "node"))
    wide = labelled.groupBy("bucket").agg((F.max("block") + 1).alias("across"))
    sizes = settle(rest.groupBy("bucket").agg((F.max("probe_block") + 1).alias("down")).join(wide, "bucket"))
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1)
    probes = rest.join(sizes, "bucket").select("*", F.explode(upto("across")).alias("block"), F.lit(True).alias("probe"))
    others = labelled.join(sizes, "bucket").select("*", F.explode(upto("down")).alias("probe_block"), F.lit(False).alias("probe"))
    named = ["bucket", (F.col("probe_block") * F.col("across") + F.col("block")).alias("block"), "node", "probe"]
    return probes.select(*named).union(others.select(*named))


def link_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that are connected inside a block; ``members`` has bucket, block, node.

    With a column ``probe`` only the nodes that have it true are compared with all of their block.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probing = "probe" in members.columns
    flag = F.col("probe") if probing else F.lit(True).alias("probe")
    rows = members.join(texts, "node").select("bucket", "block", "node", flag, "text")
    grouped = rows.repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "node", F.desc("probe"))

    def edges_of(nodes: list[bytes], sets: list[np.ndarray], probes: list[int]) -> list[tuple[bytes, bytes]]:
        pairs = linked_stars(sets, probes if probing else None) if len(nodes) > 1 else []
        return [(nodes[i], nodes[j]) for i, j in pairs]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, sets, probes = None, [], [], []
        for batch in _slices(batches):
            found: list[tuple[bytes, bytes]] = []
            hashed = shingle_sets(batch["text"].tolist())
            for now, node, probe, s in zip(zip(batch["bucket"], batch["block"]), batch["node"], batch["probe"], hashed):
                if now != key:
                    found += edges_of(nodes, sets, probes)
                    key, nodes, sets, probes = now, [], [], []
                if not nodes or nodes[-1] != node:
                    if probe:
                        probes.append(len(nodes))
                    nodes.append(bytes(node))
                    sets.append(s)
            yield pd.DataFrame(found, columns=["a", "b"])
        yield pd.DataFrame(edges_of(nodes, sets, probes), columns=["a", "b"])

    return grouped.mapInPandas(link, "a binary, b binary").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node connected with each node of ``edges``.

    Each round takes the smallest label among the neighbours, then jumps to the label's own label, so
    the rounds grow with the logarithm of a component's width. Minima are combined before the shuffle,
    and each round is written to the shared folder.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnsRenamed({"node": "b", "root": "r"}), "b")
        lower = seen.groupBy("a").agg(F.min("r").alias("r"))
        step = labels.join(lower.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "r").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        step = settle(step.join(jump, "low").select("node", F.col("root").alias("was"), F.least("low", "far").alias("root")))
        labels = step.select("node", "root")
        if step.filter("was != root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, k, n_shingles, component_id and kept.

    Documents are linked if the Jaccard similarity of their shingle sets is 0.75 or more;
    ``component_id`` is the smallest id connected by links, and ``kept`` marks the rows with that id.
    Texts without shingles are linked with nothing. Ties do not arise, as ids decide; repeated rows get
    the same answer; null ids never name a component unless all its ids are null. Other columns are
    ignored and an empty table gives no rows.

    Equal sets are one node from the start. A region of one slice is settled there. A larger one is cut
    into slices, each with two nodes of the whole region; then the nodes that are not in its largest
    component meet all slices, two at a time, so no link inside a region is lost whatever its size.
    """
    rows = settle(sketch(docs, id_column, text))
    classes = settle(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.min("k").alias("k"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    )
    members = settle(regions(classes))
    needed = members.select("node").distinct().join(classes.select("node", "k"), "node")
    source = docs.select(row_key(id_column, text).alias("k"), F.col(text).cast("string").alias("text"))
    texts = settle(source.join(needed, "k").select("node", "text"))
    blocks = members.filter("NOT large").select("bucket", F.lit(0).cast("bigint").alias("block"), "node")
    large, cut = members.filter("large"), None
    if not large.isEmpty():
        cut = settle(slices(large, classes))
        blocks = blocks.union(cut.select("bucket", "block", "node")).union(leaders(cut))
    edges = settle(link_blocks(blocks, texts))
    roots = components(edges)
    pairs = None if cut is None else unsettled_pairs(cut, roots)
    if pairs is not None:
        edges = settle(edges.union(link_blocks(pairs, texts)))
        roots = components(edges)
    named = classes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    named = settle(named)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = settle(named.join(smallest, "root").select("node", "component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(answer, "node", "left").select("doc_id", "k", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each group of near-duplicates the document with the smallest id."""
    kept = near_duplicates(docs, id_column, text).filter("kept").select(F.col("k").alias("__kept")).distinct()
    return docs.withColumn("__k", row_key(id_column, text)).join(settle(kept), F.col("__k") == F.col("__kept"), "left_semi").select(*docs.columns)
