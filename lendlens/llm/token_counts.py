"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens in batches; the distinct ones that a worker has not met lately lie end
to end in one array of symbols. In each round every sequence looks up the ranks of its neighbouring
pairs, takes its lowest and merges all its occurrences, all sequences at once. What survives is counted.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from lendlens.llm.common import or_empty

#: Pre-token pattern of byte-level BPE vocabularies of this kind (fixed value); white space by its Unicode property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct pre-tokens whose counts a worker remembers; beyond that it starts anew. Speed only.
MEMO = 200_000
#: Characters of text that are cut into pre-tokens at a time.
PIECE = 1 << 20


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of such vocabularies for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merge ranks of a ``tokenizer.json`` and the counting of symbols that survive them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normaliser or prefix space is needed")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = {s: i for i, s in enumerate(dict.fromkeys([*_byte_symbols(), *(a + b for a, b in merges)]))}
        stand_ins = {b: s for s, b in _byte_symbols().items()}
        self.of_byte = np.array([ids[stand_ins[b]] for b in range(256)], dtype=np.int64)
        self.n = len(ids)
        keys = np.array([ids[a] * self.n + ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(PRE_TOKEN)
        self.memo: dict[str, int] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.keys))

    def count_symbols(self, words: Sequence[str]) -> np.ndarray:
        """Symbols left of each non-empty word after all merges."""
        data = [w.encode("utf-8") for w in words]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        counts = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(data)), sizes)
        none = len(self.keys)
        while len(symbols) > 1:
            inside = owner[1:] == owner[:-1]
            rank = np.where(inside, self._pair_ranks(symbols[:-1], symbols[1:]), none)
            best = np.full(len(counts), none)
            np.minimum.at(best, owner[:-1], rank)
            merge = (rank == best[owner[:-1]]) & (rank < none)
            if not merge.any():
                break
            # of overlapping occurrences in a run (a a a) the first, third, ... merge
            at = np.flatnonzero(merge)
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            left = np.ones(len(symbols), dtype=bool)
            left[at + 1] = False
            counts -= np.bincount(owner[at], minlength=len(counts))
            # words without a pair to merge are done
            going = best < none
            left &= going[owner]
            symbols, owner = symbols[left], owner[left]
        return counts

    def _pieces(self, text: str) -> Iterator[str]:
        """The text between special strings; each special string is one token of its own."""
        parts = [text]
        for s in self.special:
            parts = [p for part in parts for p in part.split(s)]
        return (p for p in parts if p)

    def count(self, texts: Sequence[str]) -> list[int]:
        """Tokens of each text; special strings in it count one each."""
        totals, memo, find = [], self.memo, self.pattern.findall
        pending: list[tuple[int, Counter]] = []
        size = 0
        for i, text in enumerate(texts):
            totals.append(sum(text.count(s) for s in self.special))
            for piece in self._pieces(text):
                pending.append((i, Counter(find(piece))))
            size += len(text)
            if size >= PIECE:
                self._settle(pending, totals, memo)
                pending, size = [], 0
        self._settle(pending, totals, memo)
        return totals

    def _settle(self, pending: list[tuple[int, Counter]], totals: list[int], memo: dict[str, int]) -> None:
        new = list({w for _, words in pending for w in words if w not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({w for _, words in pending for w in words})
        if new:
            memo.update(zip(new, self.count_symbols(new).tolist()))
        for i, words in pending:
            totals[i] += sum(memo[w] * n for w, n in words.items())


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """One merger per worker and vocabulary file."""
    return RankMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a ``tokenizer.json`` on every machine. A null text counts as empty:
    no bytes, no tokens. Texts are counted whole, without begin or end tokens; a special string inside
    a text is one token. Null ids and repeated rows keep their rows; other columns are ignored. No
    shuffle: batches of rows are counted where they are read.
    """

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = merger(vocabulary)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    t = or_empty(F.col(text))
    counted = docs.select(id_column, F.octet_length(t).cast("bigint").alias("n_bytes"), tokens(t).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
