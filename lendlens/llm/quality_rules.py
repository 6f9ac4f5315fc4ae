"""Quality rules as a ledger of measurements and failure bits.

Each text is measured once. Every rule is evaluated once on the measurements and leaves one bit, so a
policy is a mask: adopting, loosening or comparing policies never touches the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.common import SPACE_RUN, let, or_empty, split_words

SYMBOLS = "#*$%&|<>"
_GRAM = 3


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements of :func:`measures`."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


#: The position of a rule is its bit; append new rules, never reorder.
RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 40 * m["word_chars"]),
    Rule("exclamations", lambda m: 10 * m["n_exclaims"] > m["n_words"]),
    Rule("mostly_repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
)
BASE = ("too_few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document. Never change one, add a version.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "shouting", "exclamations"),
    "v3": (*BASE, "symbols", "mostly_repeated_lines", "shouting", "exclamations"),
}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def policy_mask(policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """Bit mask of a policy version or of a list of rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << bits[n] for n in set(names))


def _count_chars(text: Column, chars: str) -> Column:
    """Occurrences of ASCII characters: what deleting them takes from the length."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("bigint")


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of one width, from their sorted starts."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(
            (s + width).cast("int").alias("end"),
            (acc["total"] + s + width - F.greatest(acc["end"], s)).cast("int").alias("total"),
        )

    return F.aggregate(starts, zero, step, lambda acc: acc["total"])


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the words hold twice or more; texts without one skip the sort."""
    n = F.size(words)
    grams = F.transform(
        F.sequence(F.lit(0), n - _GRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(_GRAM)])
    )

    def starts(ranked: Column) -> Column:
        last = F.size(ranked) - 1
        twice = F.filter(
            ranked,
            lambda x, k: ((k > 0) & (F.get(ranked, k - 1)["h"] == x["h"]))
            | ((k < last) & (F.get(ranked, k + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def count(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(let(ranked, starts), _GRAM)).otherwise(0)

    return F.when(n >= _GRAM, let(grams, count)).otherwise(0)


def measures(text: Column) -> Column:
    """Struct of all :data:`MEASURES` of the whole text.

    A null text has no words and no lines; all its measurements are 0. Windows are compared by a 64-bit
    hash of their words, within one text only. A repeated line is one with a word that equals an
    earlier line.
    """
    t = or_empty(text)

    def of(words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]")),
            "n_symbols": _count_chars(t, SYMBOLS),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines),
            "n_upper": _count_chars(t, "A-Z"),
            "n_exclaims": _count_chars(t, "!"),
        }
        return F.struct(*[found[k].cast("bigint").alias(k) for k in MEASURES])

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(split_words(t, SPACE_RUN), lambda w: let(lines, lambda x: of(w, x)))


def failure_bits(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Bigint with bit i set if rule i fails."""
    m = {k: found[k] for k in MEASURES}
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, every measurement and ``fail_bits``.

    Null ids and repeated rows each keep their own row; other columns of ``docs`` are not carried, so
    clashing names do no harm. An empty table gives an empty ledger.
    """
    measured = docs.select(id_column, measures(F.col(text)).alias("__m"))
    return measured.select(id_column, "__m.*", failure_bits(F.col("__m"), rules).alias("fail_bits"))


def passes(fail_bits: Column, policy: str | Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return fail_bits.bitwiseAND(F.lit(policy_mask(policy, rules)).cast("bigint")) == 0


def keep_good(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that pass the policy, with their own columns only.

    A null or empty text has too few words and goes; repeated rows and null ids are judged one by one, by
    their text alone. Very long texts are measured whole. An empty table stays empty.
    """
    return docs.filter(let(measures(F.col(text)), lambda m: passes(failure_bits(m), policy)))


def ablations(book: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: failures, failures no other rule of it catches, and the pass count without it.

    The ledger is first counted by its bits, at most ``2 ** len(rules)`` rows whatever its size; all
    figures are bitwise sums over those counts.
    """
    mask = policy_mask(policy, rules)
    counts = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("__n"))
    bits = [(i, r.name) for i, r in enumerate(rules) if mask >> i & 1]
    options = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule"), F.lit(1 << i).cast("bigint").alias("own")) for i, name in bits])
    per = counts.select("*", F.explode(options).alias("__o"))
    own = F.col("__o.own")
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("__n"))), F.lit(0))
    return per.groupBy(F.col("__o.bit").alias("bit"), F.col("__o.rule").alias("rule")).agg(
        total(failed.bitwiseAND(own) != 0).alias("failed"),
        total(failed == own).alias("failed_alone"),
        total(failed.bitwiseAND(F.bitwise_not(own)) == 0).alias("kept_without"),
    )
