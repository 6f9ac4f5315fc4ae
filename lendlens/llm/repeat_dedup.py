"""Removal of repeated byte strings by prefix-free parsing.

Texts are cut into phrases where a rolling hash triggers; neighbouring phrases overlap by one byte less
than a string, so every string lies in one phrase. The distinct phrases are the dictionary, the lists
of phrases the parse. The parse alone settles all strings of a phrase that an earlier document has. The
rest, the first copies in the dictionary, is compared by suffixes: strings are grouped by their
smallest gram, and the suffixes around the grams that several documents have are ranked in blocks by
prefix doubling, down to the length of a string. Equal ranks are equal strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lendlens.llm.common import or_empty
from lendlens.llm.rolling import BASES, Stretches
from lendlens.shared import forget, new_path, settle

#: Bytes of a string that must not repeat, and of the gram that stands for it.
LENGTH, GRAM = 50, 20
#: Bytes that a trigger looks at, and the mean distance of triggers.
TRIGGER, DISTANCE = 16, 128
#: Contexts whose suffixes are ranked together; a gram with more is compared string by string in Spark.
BLOCK = 20_000
_SIDE = LENGTH - GRAM  # a string reaches this far to either side of its gram
_CHUNK = 1 << 19
_LAST = (1 << 63) - 1


class _Texts:
    """Some texts as one array of bytes with their bounds."""

    def __init__(self, data: Sequence[bytes]):
        self.flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.sizes = np.array([len(d) for d in data], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.stretches = Stretches(self.flat)
        self.lasts = self.ends - LENGTH  # last start of a string; before starts if there is none

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and next start of every phrase that holds a string."""
        hit = self.stretches.grams(TRIGGER) % np.uint64(DISTANCE) == 0
        at = np.union1d(np.flatnonzero(hit), self.starts[self.sizes > 0])
        owner = np.searchsorted(self.ends, at, side="right")
        at, owner = at[at <= self.lasts[owner]], owner[at <= self.lasts[owner]]
        following = np.append(at[1:], 0)
        last = np.append(owner[1:] != owner[:-1], True) if len(at) else np.zeros(0, dtype=bool)
        following[last] = self.lasts[owner[last]] + 1
        return owner, at, following


def _batches(texts: Sequence) -> Iterator[tuple[int, _Texts]]:
    """Texts (null as empty) in chunks of about half a megabyte, with the number of the first."""
    begin = size = 0
    for i in range(len(texts) + 1):
        length = len(texts[i] or "") if i < len(texts) else 0
        if i == len(texts) or (i > begin and size + length > _CHUNK):
            if i > begin:
                yield begin, _Texts([b"" if t is None else t.encode("utf-8") for t in texts[begin:i]])
            begin, size = i, 0
        size += length


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ord_, rid = batch["ord"].to_numpy(), batch["rid"].to_numpy()
        for first, t in _batches(batch["text"].tolist()):
            owner, at, following = t.phrases()
            stop = np.minimum(following + LENGTH - 1, t.ends[owner])
            yield pd.DataFrame(
                {
                    "ord": ord_[first + owner],
                    "rid": rid[first + owner],
                    "start": (at - t.starts[owner]).astype(np.int32),
                    "h1": t.stretches.hash(at, stop).view(np.int64),
                    "h2": Stretches(t.flat, BASES[1]).hash(at, stop).view(np.int64),
                }
            )


def _open_starts(t: _Texts, first: int, settled: Sequence) -> np.ndarray:
    """For every byte, whether a string starts there whose phrase is not settled."""
    owner, at, following = t.phrases()
    edge = np.zeros(len(t.flat) + 1, dtype=np.int32)
    known = [np.empty(0, np.int64)] + [
        np.asarray(settled[first + i], dtype=np.int64) + t.starts[i]
        for i in range(len(t.sizes))
        if settled[first + i] is not None
    ]
    live = ~np.isin(at, np.concatenate(known))
    edge[at[live]] += 1
    edge[following[live]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """First position of the smallest value in each window, by doubling.

    Values are compared by their upper 40 bits in texts of any length, so that the choice depends on a
    window's content alone; the position takes the place of the lower bits while it fits there.
    """
    low = np.uint64(24)
    values = values >> low << low
    packed = len(values) <= 1 << 24
    best = values | np.arange(len(values), dtype=np.uint64) if packed else np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.minimum(a, b) if packed else np.where(values[b] < values[a], b, a)
        span += step
    return (best & np.uint64((1 << 24) - 1)).astype(np.int64) if packed else best


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ord_, rid, settled = batch["ord"].to_numpy(), batch["rid"].to_numpy(), batch["settled"].tolist()
        for first, t in _batches(batch["text"].tolist()):
            grams = t.stretches.grams(GRAM)
            if len(t.flat) < LENGTH:
                continue
            starts = np.flatnonzero(_open_starts(t, first, settled)[: len(t.flat) - LENGTH + 1])
            at = np.unique(_sliding_argmin(grams, _SIDE + 1)[starts])
            owner = np.searchsorted(t.ends, at, side="right")
            yield pd.DataFrame(
                {
                    "ord": ord_[first + owner],
                    "rid": rid[first + owner],
                    "pos": (at - t.starts[owner]).astype(np.int32),
                    "gram": grams[at].view(np.int64),
                }
            )


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for ord_, rid, text, places in zip(batch["ord"], batch["rid"], batch["text"], batch["places"]):
            data = text.encode("utf-8")
            rows += [(ord_, rid, p, min(p, _SIDE), data[max(0, p - _SIDE) : p + GRAM + _SIDE]) for p in places.tolist()]
        yield pd.DataFrame(rows, columns=["ord", "rid", "pos", "lead", "ctx"])


def string_classes(contexts: Sequence[bytes], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the string at each offset of each context, and whether there is one.

    Contexts are laid so that their grams share a column; ranks of 8, 16, ... bytes are doubled up to
    the largest power within :data:`LENGTH`, and two overlapping ranks make the class of a string. What
    lies outside a context counts as zero bytes, which no string that is there reaches.
    """
    n, width = len(contexts), LENGTH + _SIDE
    lens = np.array([len(c) for c in contexts], dtype=np.int64)
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(_SIDE - left, lens)
    laid = np.zeros((n, width), dtype=np.uint8)
    laid[np.repeat(np.arange(n), lens), column] = flat
    span = 8  # eight bytes are a number themselves
    rank = np.zeros((n, width - span + 1), dtype=np.uint64)
    for k in range(span):
        rank = (rank << np.uint64(8)) | laid[:, k : k + width - span + 1]

    def ranked(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.int64)

    def doubled(rank: np.ndarray, step: int, keep: int) -> np.ndarray:
        return ranked(rank[:, :keep] * (int(rank.max()) + 1) + rank[:, step : step + keep])

    rank = ranked(rank)
    while 2 * span <= LENGTH:
        rank = doubled(rank, span, width - 2 * span + 1)
        span *= 2
    classes = doubled(rank, LENGTH - span, _SIDE + 1)
    offset = np.arange(_SIDE + 1)[None, :]
    there = (offset >= _SIDE - left[:, None]) & (offset + LENGTH <= (_SIDE - left + lens)[:, None])
    return classes, there


def _masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def of(block: pd.DataFrame) -> pd.DataFrame:
        gram, first = block["gram"].to_numpy(), block["first"].to_numpy()
        mask = np.zeros(len(block), dtype=np.int64)
        # a gram with one context has no other context to share a string with
        same = gram[1:] == gram[:-1]
        several = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if len(several):
            own = first[several]
            classes, there = string_classes(block["ctx"].take(several).tolist(), block["lead"].to_numpy()[several])
            least = np.full(int(classes.max()) + 1, _LAST, dtype=np.int64)
            np.minimum.at(least, classes[there], np.broadcast_to(own[:, None], classes.shape)[there])
            seen = there & (least[classes] < own[:, None])
            mask[several] = (seen.astype(np.int64) << np.arange(_SIDE + 1)[None, :]).sum(axis=1)
        return pd.DataFrame({"gram": gram, "cid": block["cid"], "first": first, "mask": mask})

    waiting: pd.DataFrame | None = None
    for batch in batches:
        waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if len(waiting) < BLOCK:
            continue
        gram = waiting["gram"].to_numpy()
        cut = int(np.argmax(gram == gram[-1]))  # rows are sorted by gram; the last gram may go on
        if cut:
            yield of(waiting.iloc[:cut])
            waiting = waiting.iloc[cut:].reset_index(drop=True)
    if waiting is not None and len(waiting):
        yield of(waiting)


def _local(lists: Sequence, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of several lists (null as empty) end to end, and the base of the list each comes from."""
    full = [np.empty(0, np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in lists]
    return np.concatenate(full), np.repeat(base, [len(x) for x in full])


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        settled, places, masks = batch["settled"].tolist(), batch["places"].tolist(), batch["masks"].tolist()
        for first, t in _batches(batch["text"].tolist()):
            rows = slice(first, first + len(t.sizes))
            _, at, following = t.phrases()
            start, base = _local(settled[rows], t.starts)
            whole = np.isin(at, start + base)
            pos, base = _local(places[rows], t.starts)
            row, offset = np.nonzero(_local(masks[rows], t.starts)[0][:, None] >> np.arange(_SIDE + 1)[None, :] & 1)
            single = (pos + base)[row] - _SIDE + offset
            size = len(t.flat) + 1
            edge = np.bincount(np.concatenate((at[whole], single)), minlength=size)
            edge -= np.bincount(np.concatenate((following[whole] - 1, single)) + LENGTH, minlength=size)
            gone = np.cumsum(edge[:-1]) > 0
            # runs end where a text ends
            begins = gone & ~np.insert(gone[:-1], 0, False) if len(gone) else gone
            begins[t.starts[t.sizes > 0]] = gone[t.starts[t.sizes > 0]]
            ends = gone & ~np.append(gone[1:], False) if len(gone) else gone
            ends[t.ends[t.sizes > 0] - 1] = gone[t.ends[t.sizes > 0] - 1]
            a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            owner = np.searchsorted(t.ends, a, side="right")
            turns = np.stack((a - t.starts[owner], b - t.starts[owner]), axis=1).ravel()
            cut = 2 * np.searchsorted(owner, np.arange(1, len(t.sizes)))
            left = t.flat[~gone].tobytes()
            upto = np.concatenate(([0], np.cumsum(~gone)))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[rows].array,
                    "n_bytes": t.sizes,
                    "edges": np.split(turns, cut),
                    "kept": [left[upto[x] : upto[y]] for x, y in zip(t.starts, t.ends)],
                }
            )


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` as a table in the shared folder, bucketed by row: joins by ``rid`` and ``ord`` leave the texts in place."""
    name = f"parsed_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, "rid", "ord").write.bucketBy(buckets, "rid", "ord").option("path", new_path(rows.sparkSession))
    writer.option("compression", "zstd").format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, ``spans`` removed (start, end in bytes) and ``kept`` bytes.

    Removed is every byte covered by a string of :data:`LENGTH` bytes that also starts in a row with a
    smaller id; strings are judged on the input and never cross rows. Null texts are empty. Ids are
    integers; rows with equal ids are not smaller than each other, and a null id counts as larger than
    all others. Other columns are ignored; an empty table gives no rows.

    Texts are shuffled once, into a bucketed table. A row is named by its id and, where several rows share that, by a
    hash of its text; other rows have zero there, which compresses to nothing in all that moves. Phrases, grams
    and contexts are the rows that move; equal contexts are combined before they do. A gram is ranked in one task with its distinct contexts
    up to :data:`BLOCK` of them; one with more is spread over tasks string by string.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = or_empty(F.col(text))
    ord_ = F.coalesce(F.col(id_column).cast("bigint"), F.lit(_LAST))
    shared = docs.groupBy(ord_.alias("ord")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(shared.select("ord", F.lit(True).alias("shared")))  # written, so that few are broadcast
    named = docs.select(F.col(id_column).alias("doc_id"), ord_.alias("ord"), content.alias("text")).join(shared, "ord", "left")
    digest = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary")))
    rid = F.when(F.col("shared"), digest).otherwise(F.lit(0).cast("bigint"))
    base = _bucketed(named.select("doc_id", "ord", rid.alias("rid"), "text"), n)
    forget(shared)
    # rows equal in id and text share ord and rid, and so all results
    parsed = base.select("ord", "rid", "text").mapInPandas(_parse, "ord bigint, rid bigint, start int, h1 bigint, h2 bigint")
    parsed = settle(parsed)
    firsts = parsed.groupBy("h1", "h2").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi")
    firsts = settle(firsts.select("h1", "h2", "lo"))  # written, so that a phrase of very many texts is split in the join
    earlier = parsed.join(firsts, ["h1", "h2"]).filter("lo < ord").select("ord", "rid", "start")
    settled = settle(earlier.groupBy("rid", "ord").agg(F.collect_list("start").alias("settled")))
    forget(parsed, firsts)

    rows = base.join(settled, ["rid", "ord"], "left").select("ord", "rid", "text", "settled")
    anchors = rows.mapInPandas(_anchors, "ord bigint, rid bigint, pos int, gram bigint")
    whole = W.partitionBy("gram")
    several = anchors.select("*", F.min("ord").over(whole).alias("lo"), F.max("ord").over(whole).alias("hi")).filter("lo < hi")
    places = settle(several.groupBy("rid", "ord").agg(F.collect_set("pos").alias("places")))

    found = base.join(places, ["rid", "ord"]).select("ord", "rid", "text", "places")
    found = found.mapInPandas(_contexts, "ord bigint, rid bigint, pos int, lead int, ctx binary")
    gram = F.xxhash64(F.substring("ctx", F.col("lead") + 1, F.lit(GRAM)))
    found = settle(found.select("*", gram.alias("gram"), F.xxhash64("lead", "ctx").alias("cid")), "zstd")
    contexts = settle(
        found.groupBy("gram", "cid").agg(F.min("ord").alias("first"), F.min("lead").alias("lead"), F.min("ctx").alias("ctx")), "zstd"
    )
    forget(places)
    many = settle(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("gram"))
    few = contexts.join(many, "gram", "left_anti").repartition(n, "gram").sortWithinPartitions("gram")
    masks = few.mapInPandas(_masks, "gram bigint, cid bigint, first bigint, mask bigint")
    if not many.isEmpty():
        masks = masks.unionByName(_string_by_string(contexts.join(many, "gram")))
    size = F.octet_length("ctx")
    # offsets whose string lies inside the context
    low, high = _SIDE - F.col("lead"), F.least(F.lit(_SIDE), _SIDE - F.col("lead") + size - LENGTH)
    powers = F.array(*[F.lit(1 << i) for i in range(_SIDE + 2)])
    inside = F.when(high >= low, F.get(powers, high + 1) - F.get(powers, low)).otherwise(0)
    marked = found.withColumn("inside", inside.cast("bigint")).drop("ctx", "lead").join(settle(masks), ["gram", "cid"])
    marked = marked.withColumn("mask", F.when(F.col("ord") > F.col("first"), F.col("inside")).otherwise(F.col("mask")))
    marked = marked.filter("mask != 0").groupBy("rid", "ord").agg(F.collect_list(F.struct("pos", "mask")).alias("m"))
    marks = settle(marked.select("rid", "ord", F.col("m.pos").alias("places"), F.col("m.mask").alias("masks")))
    forget(found, contexts, many)

    last = base.join(settled, ["rid", "ord"], "left").join(marks, ["rid", "ord"], "left")
    last = last.select("doc_id", "text", "settled", "places", "masks")
    kind = dict(docs.dtypes)[id_column]
    out = last.mapInPandas(_remove, f"doc_id {kind}, n_bytes bigint, edges array<bigint>, kept binary")
    spans = F.transform(
        F.sequence(F.lit(0), F.size("edges") - 2, F.lit(2)),
        lambda i: F.struct(F.get("edges", i).alias("start"), F.get("edges", i + 1).alias("end")),
    )
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", "n_bytes", F.when(F.size("edges") > 0, spans).otherwise(nothing).alias("spans"), "kept")


def _string_by_string(contexts: DataFrame) -> DataFrame:
    """Masks of grams with very many contexts: each string meets its equals by a combined minimum."""
    offsets = F.sequence(F.lit(0), F.lit(_SIDE))
    rows = contexts.select("gram", "cid", "first", "lead", "ctx", F.explode(offsets).alias("o"))
    start = F.col("o") - (_SIDE - F.col("lead"))
    rows = rows.filter((start >= 0) & (start + LENGTH <= F.octet_length("ctx")))
    rows = rows.select("gram", "cid", "first", "o", F.substring("ctx", start + 1, F.lit(LENGTH)).alias("s"))
    least = rows.groupBy("s", "o").agg(F.min("first").alias("lo"))
    bit = F.expr("shiftleft(1L, o)")  # o has its own bit
    seen = rows.join(least, ["s", "o"]).select("gram", "cid", "first", F.when(F.col("lo") < F.col("first"), bit).otherwise(0).alias("b"))
    return seen.groupBy("gram", "cid", "first").agg(F.bit_or("b").alias("mask"))
