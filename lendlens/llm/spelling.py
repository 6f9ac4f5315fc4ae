"""Grouping spelling variants: words that one edit turns into each other, by a relational trie frontier.

The words make two tries, one of the words and one of the reversed words; a node is named by its path,
and the edge table has one row per node with the letters of its children. A state (word, position, node,
edits) says that the word up to the position turns into the node's path by so many edits, none or one. All
states whose nodes have one depth are joined with the edges of that depth, which gives the states of the next.

Either the first half of a word is untouched by the edit or the last half is. States therefore start
without an edit in the middle of the word, in either trie, where few paths go on. As nearness goes both ways, only replacements
by larger letters and deletions are made; the pairs found are turned round afterwards.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlens.llm.common import or_empty
from lendlens.llm.rolling import BASES, powers
from lendlens.shared import delete_path, forget, new_path, settle

LEAST_LETTERS, LEAST_TIMES, SLIPS = 5, 3, 97
#: Words of more letters are compared by hashes of their one-letter deletions instead of letter by letter.
TRIE_LETTERS = 48
_NOT_LETTERS = r"[^a-z\x{C0}-\x{FF}]+"
_GAPS = "".join(c for c in map(chr, range(128)) if not c.isalpha())


def _runs(text: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Pieces between ASCII characters that are no letters, A-Z lower-cased, and the runs of letters in a piece.

    Most texts need no regular expression that way: only a piece with other characters is searched by one.
    """
    plain = F.translate(text, string.ascii_uppercase + _GAPS, string.ascii_lowercase + " " * len(_GAPS))
    return F.split(plain, " "), lambda piece: F.when(
        F.octet_length(piece) == F.char_length(piece), F.array(piece)
    ).otherwise(F.split(piece, _NOT_LETTERS))


def words(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with their planted slips, of at least five letters and three occurrences.

    Letters are A-Z, a-z and the code points C0 to FF; only A-Z are lower-cased. A run whose unsigned
    CRC-32 with the id, ``<id>:<run>``, is divisible by 97 loses the letter at that number modulo its length.
    """
    pieces, runs_in = _runs(or_empty(F.col(text)))
    long_enough = lambda name: F.char_length(name) >= LEAST_LETTERS
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(pieces).alias("piece"))
    runs = runs.filter(long_enough("piece")).select("id", F.explode(runs_in(F.col("piece"))).alias("run")).filter(long_enough("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    slipped = runs.withColumn("h", h).select(F.when(F.col("h") % SLIPS == 0, without).otherwise(F.col("run")).alias("word"))
    counted = slipped.filter(long_enough("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= LEAST_TIMES)


def _letter(word: Column, position: Column) -> Column:
    """Letter at a position counted from 0; empty beyond the end."""
    return F.substring(word, position + 1, F.lit(1))


def _by_depth(spark: SparkSession, rows: DataFrame, schema: str) -> tuple[str, DataFrame]:
    path = new_path(spark)
    rows.write.partitionBy("depth").parquet(path)
    return path, spark.read.schema(schema + ", depth int").parquet(path)


def trie_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of words of at most :data:`TRIE_LETTERS` letters that one edit turns into each other.

    ``vocabulary`` has distinct words. States without an edit follow a word's own path, so they are there
    from the start; one join makes all their one-edit states. Then there is a join for each depth of the
    tries; every edge and state takes part in one of them.
    """
    spark = vocabulary.sparkSession
    known = vocabulary.select("word").filter(F.char_length("word") <= TRIE_LETTERS)
    both = F.explode(
        F.array(
            F.struct(F.lit(False).alias("back"), F.col("word").alias("word")),
            F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")),
        )
    )
    word, depth, node, c = F.col("word"), F.col("depth"), F.col("node"), F.col("c")
    size = F.char_length("word")
    laid = settle(known.select(both.alias("w")).select("w.*"))
    half = F.floor(size / 2).cast("int")
    paths = laid.select("back", "word", F.explode(F.sequence(half, size - 1)).alias("depth"))
    paths = paths.withColumn("node", F.substring(word, F.lit(1), depth))
    edges_path, edges = _by_depth(
        spark,
        paths.groupBy("depth", "back", "node").agg(F.collect_set(_letter(word, depth)).alias("letters")),
        "back boolean, node string, letters array<string>",
    )

    here, following = _letter(word, depth), _letter(word, depth + 1)
    move = lambda position: F.struct(position.alias("position"), F.concat(node, c).alias("node"))
    replaced = F.when(c > here, move(depth + 1))
    # of equal letters side by side only the last is deleted; the letter after it leads to the next depth
    deleted = F.when((c == following) & (following != here), move(depth + 2))
    free = paths.filter(F.when(F.col("back"), depth >= size - half).otherwise(True))
    first = free.join(edges, ["depth", "back", "node"]).select("depth", "back", "word", "node", F.explode("letters").alias("c"))
    first = first.filter((c > here) | (c == following)).select(depth + 1, "back", "word", F.explode(F.array(replaced, deleted)).alias("s"))
    first = first.filter("s IS NOT NULL").toDF("depth", "back", "word", "s").select("depth", "back", "word", "s.*")
    states_path, states = _by_depth(spark, first, "back boolean, word string, position int, node string")

    levels, position = [states.drop("depth")], F.col("position")
    last = known.agg(F.max(F.char_length("word"))).first()[0] or 0
    open_ = position < size
    for now in range(LEAST_LETTERS // 2 + 1, last):
        mine = states.filter(depth == now).drop("depth").filter(open_)
        if len(levels) > 1:
            mine = mine.unionByName(levels[-1].filter(open_))
        joined = mine.join(edges.filter(depth == now).drop("depth"), ["back", "node"])
        onward = _letter(word, position)
        grown = joined.filter(F.array_contains("letters", onward))
        levels.append(settle(grown.select("back", "word", (position + 1).alias("position"), F.concat(node, onward).alias("node"))))
    # a word is used up at the end of its path, or one letter later: its last letter deleted
    found = laid.select("back", "word", F.substring(word, F.lit(1), size - 1).alias("node"))
    for level in levels:
        found = found.unionByName(level.filter(position == size).select("back", "word", "node"))
    turned = lambda name: F.when(F.col("back"), F.reverse(name)).otherwise(F.col(name))
    found = found.select(turned("word").alias("a"), turned("node").alias("b"))
    found = found.join(known.withColumnRenamed("word", "b"), "b", "left_semi")
    pairs = settle(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(laid, *levels[1:])
    delete_path(spark, edges_path)
    delete_path(spark, states_path)
    return pairs


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of every word (place -1) and of the word without each of its letters."""
    for batch in batches:
        for name, word in zip(batch["name"], batch["word"]):
            letters = np.array([ord(c) for c in word], dtype=np.uint64) + np.uint64(1)
            power, inverse = powers(BASES[0], len(letters) + 1)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(letters * power[: len(letters)])))
            rest = (sums[-1] - sums[1:]) * inverse[1]  # what follows a letter moves one place down
            hashes = np.append(sums[:-1] + rest, sums[-1]).view(np.int64)
            places = np.append(np.arange(len(letters)), -1)
            yield pd.DataFrame({"name": name, "place": places.astype(np.int32), "h": hashes})


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter turns one word into the other."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[[one_edit(a, b) for a, b in zip(batch["a"], batch["b"])]]


def long_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, as :func:`trie_pairs` gives, with at least one word of more than :data:`TRIE_LETTERS` letters.

    Words without the same letter, or one without a letter and the other whole, have equal hashes; the
    words themselves are compared after that. The rows are as many as letters and name words by their
    digest; those that meet are neighbours but for chance, so no group is larger than the alphabet.
    """
    some = vocabulary.filter(F.char_length("word") >= TRIE_LETTERS).select(F.md5(F.col("word").cast("binary")).alias("name"), "word")
    forms = settle(some.mapInPandas(_deletions, "name string, place int, h bigint"))
    less, whole = forms.filter("place >= 0"), forms.filter("place = -1")
    other = lambda side: side.withColumnRenamed("name", "other")
    shorter = less.join(other(whole).drop("place"), "h").select("name", "other")
    replaced = less.join(other(less), ["place", "h"]).filter("name < other").select("name", "other")
    found = settle(shorter.union(replaced).distinct())
    named = found.join(some.withColumnRenamed("word", "x"), "name").join(other(some).withColumnRenamed("word", "y"), "other")
    pairs = named.filter(F.greatest(F.char_length("x"), F.char_length("y")) > TRIE_LETTERS)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = settle(pairs.mapInPandas(_confirmed, "a string, b string"))
    forget(forms, found)
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Every pair (word, other) of words at one inserted, deleted or replaced letter, both ways round."""
    pairs = trie_pairs(vocabulary)
    if not vocabulary.filter(F.char_length("word") > TRIE_LETTERS).isEmpty():
        pairs = pairs.union(long_pairs(vocabulary))
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root): the last word on the way from form to form. ``forms`` has word and form, null at the end.

    Each round doubles the way that is known, and on it counts at least double, so few rounds are needed.
    """
    reach = settle(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = reach.select("word", "root").join(onward, "root", "left")
        step = settle(known.select("word", F.coalesce("further", "root").alias("root"), "further"))
        forget(reach)
        reach = step
        if reach.filter("further IS NOT NULL").isEmpty():
            return reach.select("word", "root")
    raise RuntimeError("forms go round in a circle")


def group_variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of ``docs`` (see :func:`words`): word, form, root, n, n_near, form_n.

    ``n_near`` counts the words at one edit. ``form`` is the most frequent of these (ties: the first in
    code-point order) if it occurs at least twice as often as the word, else null; ``form_n`` is its count. ``root``
    is the last word on the way from form to form, the word itself without a form.

    Null and empty texts have no words; null ids count as the empty id; repeated rows count each time. Other
    columns are ignored, an empty table gives no rows, and words may be of any length.
    """
    vocabulary = settle(words(docs, id_column, text))
    counts = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(vocabulary).join(counts, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    taken = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best"))
    forms = settle(
        vocabulary.join(near, "word", "left").select(
            "word",
            taken["form"].alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            (-taken["less"]).alias("form_n"),
        )
    )
    out = forms.join(roots(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
