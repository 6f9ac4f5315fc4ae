"""Language identification in two levels: the family first, then the languages within it.

Both levels are one-versus-one linear support vector machines on frequencies of hashed two- and
three-byte grams. A margin is a mean of gram weights, so a text of any length is scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lendlens.shared import settle

#: Language families by ISO 639-1 code (fixed values); a language not listed is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "pa", "ur"],
}
UNDETERMINED = "und"
DIMS = 1 << 14
#: Labelled texts per language that the models are fitted on, at most.
PER_LANGUAGE = 300
_SCALE = 16.0  # brings gram frequencies of a usual text to about unit length
_CHUNK = 1 << 20  # bytes of text whose grams are held at a time
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str, families: Mapping[str, Sequence[str]] = FAMILIES) -> str:
    return next((f for f, langs in families.items() if lang in langs), f"only:{lang}")


def _space_out() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    letters = set(range(ord("a"), ord("z") + 1))
    table[[b for b in range(128) if b not in letters]] = 32
    return table


_TABLE = _space_out()


def gram_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of lower-cased texts, end to end, and where each text starts.

    Bytes that are neither ASCII letters nor parts of other characters count as spaces, runs of spaces
    as one; each text is set between spaces. A text has two grams per remaining byte, so never none.
    """
    data = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    flat = _TABLE[np.frombuffer(b"".join(data), dtype=np.uint8)]
    sizes = np.array([len(d) for d in data])
    owner = np.repeat(np.arange(len(data)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
    keep[starts] = True
    flat, owner = flat[keep].astype(np.uint32), owner[keep]
    first = np.searchsorted(owner, np.arange(len(data)))
    a, b = flat, np.append(flat[1:], 32).astype(np.uint32)
    c = np.append(b[1:], 32).astype(np.uint32)
    two = a | (b << 8)
    three = two | (c << 16) | np.uint32(1 << 24)
    codes = np.empty(2 * len(flat), dtype=np.int32)
    for k, gram in enumerate((two, three)):
        codes[k::2] = (gram * np.uint32(2654435761)) >> np.uint32(32 - 14)
    return codes, 2 * first


def chunks(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about ``_CHUNK`` characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > _CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Duels:
    """One-versus-one machines: pair i separates ``pairs[i][0]`` (positive) from ``pairs[i][1]``."""

    labels: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (DIMS, pairs)
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, ties by the sum of margins, and its mean probability in its own duels."""
        n = len(margins)
        if len(self.labels) == 1:
            return np.zeros(n, dtype=int), np.ones(n)
        votes, sums = np.zeros((n, len(self.labels))), np.zeros((n, len(self.labels)))
        trust = np.zeros((n, len(self.labels)))
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            trust[:, i] += p
            trust[:, j] += 1 - p
        won = np.argmax(votes + 1e-6 * np.tanh(sums), axis=1)
        return won, trust[np.arange(n), won] / (len(self.labels) - 1)


@dataclass
class Model:
    """The family level and one set of duels per family."""

    families: Duels
    within: dict[str, Duels]

    def predict(self, texts: Sequence[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        levels = [self.families, *self.within.values()]
        weights = np.concatenate([d.weights for d in levels], axis=1)
        bias = np.concatenate([d.bias for d in levels])
        for lo, hi in chunks(texts):
            codes, first = gram_codes(texts[lo:hi])
            total = np.diff(np.append(first, len(codes)))[:, None]
            # one machine at a time keeps the gathered weights small
            sums = [np.add.reduceat(weights[codes, k], first, dtype=np.float64) for k in range(weights.shape[1])]
            margins = (np.stack(sums, axis=1) * _SCALE / total if sums else np.zeros((hi - lo, 0))) + bias
            fam, fam_p = self.families.decide(margins[:, : len(self.families.pairs)])
            choice, sure = np.empty(hi - lo, dtype=object), np.zeros(hi - lo)
            at = len(self.families.pairs)
            for name, duels in self.within.items():
                mine = fam == self.families.labels.index(name)
                own, p = duels.decide(margins[mine, at : at + len(duels.pairs)])
                choice[mine], sure[mine] = np.array(duels.labels, dtype=object)[own], p
                at += len(duels.pairs)
            for i, t in enumerate(texts[lo:hi]):
                known = _LETTER.search(t) is not None
                langs.append(choice[i] if known else UNDETERMINED)
                scores.append(float(fam_p[i] * sure[i]) if known else 0.0)
        return langs, scores


def _fit_pair(rows: np.ndarray, codes: np.ndarray, values: np.ndarray, sign: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge machine by accelerated gradient steps; classes weigh the same."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    norms = np.bincount(rows, weights=values**2, minlength=len(sign)) + 1
    step = 1 / (2 * norms.max() + 1e-3)
    w, b = np.zeros(DIMS), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        f = np.bincount(rows, weights=values * vw[codes], minlength=len(sign)) + vb
        slope = -2 * share * sign * np.maximum(0, 1 - sign * f)
        new_w = vw - step * (np.bincount(codes, weights=values * slope[rows], minlength=DIMS) + 1e-4 * vw)
        new_b = vb - step * slope.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return w, b


def _fit_duels(labels: list[str], truth: np.ndarray, rows: np.ndarray, codes: np.ndarray, values: np.ndarray) -> Duels:
    pairs = list(combinations(range(len(labels)), 2))
    weights, bias = np.zeros((DIMS, len(pairs)), dtype=np.float32), np.zeros(len(pairs))
    for k, (i, j) in enumerate(pairs):
        used = (truth == labels[i]) | (truth == labels[j])
        at = np.cumsum(used) - 1
        mine = used[rows]
        sign = np.where(truth[used] == labels[i], 1.0, -1.0)
        weights[:, k], bias[k] = _fit_pair(at[rows[mine]], codes[mine], values[mine], sign)
    return Duels(labels, pairs, weights, bias)


def fit(examples: pd.DataFrame, families: Mapping[str, Sequence[str]] = FAMILIES) -> Model | None:
    """Model of rows (lang, codes, freqs); None without rows."""
    if not len(examples):
        return None
    lang = examples["lang"].to_numpy(dtype=object)
    sizes = examples["codes"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(examples)), sizes)
    codes = np.concatenate(examples["codes"].to_numpy()).astype(np.int64)
    values = np.concatenate(examples["freqs"].to_numpy()).astype(np.float64) * _SCALE
    family = np.array([family_of(x, families) for x in lang], dtype=object)
    names = sorted(set(family))
    top = _fit_duels(names, family, rows, codes, values)
    within = {}
    for name in names:
        own = family == name
        at = np.cumsum(own) - 1
        mine = own[rows]
        within[name] = _fit_duels(sorted(set(lang[own])), lang[own], at[rows[mine]], codes[mine], values[mine])
    return Model(top, within)


def _short_piece(text: str) -> str:
    """A few words from the middle, so that the models also learn from short texts."""
    words = text.split()
    return " ".join(words[len(words) // 2 :][:8])


def training_examples(labelled: DataFrame, per_language: int, text: str, lang: str) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, by a hash of the text, as gram frequencies.

    Each language is thinned by its own count of distinct texts and reduced to distinct ones before they
    are ranked, so neither a language's rows nor the copies of a text meet in one task. Each text gives two rows, itself and a short piece of it.
    """
    usable = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    digest = F.xxhash64("text", F.lit(7))
    key = F.pmod(digest, F.lit(1 << 30)) / float(1 << 30)
    distinct = usable.select("lang", digest.alias("h")).distinct()  # only counted, so a chance match does no harm
    counts = settle(distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    thinned = usable.withColumn("key", key).join(counts, "lang").filter(F.col("key") * F.col("n") < 2 * per_language)
    thinned = thinned.select("lang", "text", "key").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key", "text"))
    chosen = thinned.select("lang", "text", rank.alias("rank")).filter(F.col("rank") <= per_language).select("lang", "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x for t in batch["text"] for x in (t, _short_piece(t))]
            out = []
            for lo, hi in chunks(texts):
                codes, first = gram_codes(texts[lo:hi])
                for part in np.split(codes, first[1:]):
                    found, n = np.unique(part, return_counts=True)
                    out.append((found.astype(np.int32), (n / len(part)).astype(np.float32)))
            langs = [x for lang in batch["lang"] for x in (lang, lang)]
            yield pd.DataFrame({"lang": langs, "codes": [c for c, _ in out], "freqs": [v for _, v in out]})

    return chosen.mapInPandas(grams, "lang string, codes array<int>, freqs array<float>")


def held_out(id_column: str = "doc_id") -> Column:
    """True for the third of the ids that is never learned from; a null id is learned from."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def identify(
    docs: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE, families: Mapping[str, Sequence[str]] = FAMILIES,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` (0 to 1); only the text is looked at.

    The models are fitted on the driver from at most ``2 * per_language`` short gram vectors per
    language of ``labelled``. ``und`` with score 0 if the text is null or has no letter, or if
    ``labelled`` has no usable row; a single known language always wins with score 1. Equal texts get
    equal results. Columns of ``docs`` named lang_pred or score are replaced.
    """
    model = fit(training_examples(labelled, per_language, text, lang).toPandas(), families)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages, not by rows

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = texts.fillna("").tolist()
            if shared.value is None:
                langs, scores = [UNDETERMINED] * len(known), [0.0] * len(known)
            else:
                langs, scores = shared.value.predict(known)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*kept, predict(F.col(text).cast("string")).alias("__p"))
    return found.select(*kept, "__p.lang_pred", "__p.score")
