"""Benchmark decontamination by winnowing.

Of every ten consecutive words the smallest of the six five-word hashes is kept as a fingerprint, so
two texts that share ten words share the fingerprint too, whatever surrounds them. Only fingerprints
are joined; each hit is then extended to the whole window and checked against the document's words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.common import NON_WORD_RUN, ascii_lower, let, or_empty, split_words
from lendlens.shared import settle

GRAM = 5
_LOW = (1 << 31) - 1  # a packed fingerprint has 33 bits of hash above 31 bits of position


def words_of(text: Column) -> Column:
    """Lower-case words of a text; null has none."""
    return split_words(ascii_lower(or_empty(text)), NON_WORD_RUN)


def _hash_at(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(n)])


def _fingerprints(words: Column, window: int, gram: int) -> Column:
    """For each window of words, the packed smallest gram hash in it; ties go to the first position."""
    packed = F.transform(
        F.sequence(F.lit(0), F.size(words) - gram),
        lambda i: F.shiftleft(F.shiftright(_hash_at(words, i, gram), 31), 31).bitwiseOR(i.cast("bigint")),
    )
    least = lambda g, s: F.least(*[F.get(g, s + k) for k in range(window - gram + 1)])
    minima = let(packed, lambda g: F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda s: least(g, s)))
    return F.when(F.size(words) >= window, minima)


def _benchmark_windows(items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows with their fingerprint, windows by item, and the short item lengths.

    A window is named by its length and a 64-bit hash of its words. Both tables are written, so their
    size is known when they are joined.
    """
    words = words_of(F.col("text"))
    each = let(
        words,
        lambda w: F.transform(
            _fingerprints(w, window, gram), lambda p, at: F.struct(p.alias("p"), at.alias("at"), _hash_at(w, at, window).alias("win"))
        ),
    )
    long = items.select("item_id", F.explode(F.array_distinct(each)).alias("x")).select(
        "item_id",
        F.lit(window).alias("len"),
        F.shiftright("x.p", 31).alias("fp"),
        (F.col("x.p").bitwiseAND(_LOW) - F.col("x.at")).cast("int").alias("back"),
        "x.win",
    )
    short = items.select("item_id", let(words, lambda w: F.struct(F.size(w).alias("len"), _chain(w).alias("win"))).alias("x"))
    short = short.filter(F.col("x.len").between(1, window - 1)).select(
        "item_id", "x.len", F.col("x.win").alias("fp"), F.lit(0).alias("back"), "x.win"
    )
    every = settle(long.unionByName(short))
    windows = settle(every.select("len", "fp", "back", "win").distinct())
    members = settle(every.select("len", "win", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct())
    # at most window - 1 numbers
    lengths = sorted(r[0] for r in windows.filter(F.col("len") < window).select("len").distinct().collect())
    return windows, members, lengths


def _chain(words: Column) -> Column:
    """One hash of a whole array of words."""
    return F.aggregate(words, F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x))


def _every_stretch(size: int) -> Callable[[Column], Column]:
    """For short items: the number of words, and hash and position of every ``size`` words in a row."""

    def of(words: Column) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
        one = lambda s: F.struct(_chain(F.slice(words, s + 1, F.lit(size))).alias("fp"), s.alias("at"))
        return F.struct(F.size(words).alias("n"), F.transform(starts, one).alias("p"))

    return of


def _covered(hits: Column) -> Column:
    """Words covered by (start, len) spans that are sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        stop = x["s"] + x["len"]
        return F.struct(
            F.greatest(acc["end"], stop).cast("int").alias("end"),
            (acc["total"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], x["s"]))).cast("int").alias("total"),
        )

    return F.aggregate(hits, zero, step, lambda acc: acc["total"])


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with its verified hits, and the benchmark windows by item.

    First frame: the columns of ``docs``, ``__key`` (MD5 of the text) and ``__hit``, a struct of
    ``n_words``, ``spans`` (sorted array of start, len and win, in words) and ``n_hit``. Second frame:
    len, win and item (id as string).

    ``items`` needs item_id and text. Words are runs of digits, letters and non-ASCII characters after
    lower-casing A-Z. A document word is hit if it is inside an occurrence of ``window`` consecutive
    item words, or of the whole item if that is shorter. Null and empty texts have no words and are
    never hit; an empty benchmark hits nothing; repeated rows and null ids keep their rows, as hits are
    joined by text. A null item id counts as the empty string. The text of every document is shuffled
    once; fingerprints are not shuffled if the benchmark's fit Spark's broadcast threshold.
    """
    windows, members, lengths = _benchmark_windows(items.select("item_id", "text"), window, gram)
    text = F.col("text")
    key = F.md5(text.cast("binary"))
    texts = docs.filter(text.isNotNull()).select(key.alias("__key"), "text")
    numbered = lambda w, prints: F.struct(F.size(w).alias("n"), prints.alias("p"))
    prints = texts.select(
        "__key", let(words_of(text), lambda w: numbered(w, F.array_distinct(_fingerprints(w, window, gram)))).alias("__x")
    )
    prints = prints.select("__key", F.col("__x.n").alias("__n"), F.explode(F.col("__x.p")).alias("__p"))
    found = prints.select(
        "__key",
        "__n",
        F.lit(window).alias("len"),
        F.shiftright("__p", 31).alias("fp"),
        F.col("__p").bitwiseAND(_LOW).cast("int").alias("at"),
    )
    for size in lengths:
        found = found.unionByName(
            texts.select("__key", let(words_of(text), _every_stretch(size)).alias("__x"))
            .select("__key", F.col("__x.n").alias("__n"), F.explode("__x.p").alias("x"))
            .select("__key", "__n", F.lit(size).alias("len"), "x.fp", "x.at")
        )
    start = (F.col("at") - F.col("back")).cast("int")
    candidates = (
        found.join(windows, ["len", "fp"])
        .filter((start >= 0) & (start + F.col("len") <= F.col("__n")))
        .select("__key", start.alias("s"), "len", "win")
        .distinct()
        .groupBy("__key")
        .agg(F.array_sort(F.collect_list(F.struct("s", "len", "win"))).alias("__c"))
    )

    def same(w: Column, c: Column) -> Column:
        whole = F.when(c["len"] == window, _hash_at(w, c["s"], window)).otherwise(_chain(F.slice(w, c["s"] + 1, c["len"])))
        return c["win"] == whole

    def checked(w: Column) -> Column:
        nothing = F.array().cast("array<struct<s:int,len:int,win:bigint>>")
        spans = F.coalesce(F.when(F.col("__c").isNotNull(), F.filter("__c", lambda c: same(w, c))), nothing)
        return let(
            spans,
            lambda x: F.struct(
                F.size(w).cast("bigint").alias("n_words"), x.alias("spans"), _covered(x).cast("bigint").alias("n_hit")
            ),
        )

    joined = docs.withColumn("__key", key).join(candidates, "__key", "left")
    return joined.select(*docs.columns, "__key", let(words_of(text), checked).alias("__hit")), members


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, n_hit, ``items`` (sorted ids) and contaminated."""
    hits, members = find_hits(docs.select("doc_id", "text"), items, window)
    hits = settle(hits.select("doc_id", "__key", "__hit.*"))
    by_text = (
        hits.filter("n_hit > 0")
        .select("__key", F.explode("spans").alias("c"))
        .select("__key", "c.len", "c.win")
        .distinct()
        .join(members, ["len", "win"])
        .select("__key", "item")
        .distinct()
        .groupBy("__key")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return hits.join(by_text, "__key", "left").select(
        "doc_id",
        "n_words",
        F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["len"].alias("len"))).alias("spans"),
        "n_hit",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Rows of ``docs`` without any benchmark window, with their own columns only."""
    hits, _ = find_hits(docs, items, window)
    return hits.filter("__hit.n_hit = 0").select(*docs.columns)
