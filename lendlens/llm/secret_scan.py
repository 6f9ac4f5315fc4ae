"""Secret scanning: a wide candidate search, then a random forest that removes false findings.

The forest sees how a candidate looks (length, character transitions, dictionary coverage) and where it
stands (path-like or assigned, neighbouring words), never the words of the candidate itself.
"""

from __future__ import annotations

import math
import random
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.llm.common import SPACE_RUN, or_empty, split_words
from lendlens.shared import settle

#: Shortest candidate.
MIN_CHARS = 16
#: Words in the dictionary: the corpus's most frequent ones, counted over all documents.
DICTIONARY_WORDS = 5000
#: Labelled findings per class that the forest is fitted on, at most.
PER_CLASS = 5000
#: Shortest value of an assignment to a name that speaks for a secret.
MIN_KEYED = 8
#: Names, or parts of names, before a candidate that speak for a secret, and those that speak for a digest (fixed values).
KEY_WORDS = frozenset("token secret password passwd passphrase pwd apikey auth authorization credential bearer key".split())
DIGEST_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest revision etag hash blob tree integrity fingerprint".split())
FEATURES = (
    "n_chars", "class_changes", "entropy", "digit_share", "upper_share", "symbol_share", "hex_share", "longest_run",
    "dictionary_share", "in_path", "in_url", "assigned", "quoted", "key_word_near", "number_near", "words_before",
)
_CANDIDATE = regex.compile(rf"[A-Za-z0-9+/_=\-]{{{MIN_CHARS},}}")
_WORD = regex.compile(r"\w+")
_PART = regex.compile(r"[A-Z]?[a-z]+\d*|[A-Z]+(?![a-z])\d*|\d+")
_NAMED = regex.compile(r"[A-Za-z_][\w\-]*=(?!=*$)")
_KEYED = regex.compile(
    r"(?:(?i:token|secret|passwo?r?d|passphrase|pwd|key|auth|authorization|credential)s?[\"'`\]]{0,2}\s{0,3}(?::=|=>|[:=])\s{0,3}(?i:(?:bearer|basic|token)\s+)?"
    rf"(?:\"([^\"\n]{{{MIN_KEYED},512}})\"|'([^'\n]{{{MIN_KEYED},512}})'|`([^`\n]{{{MIN_KEYED},512}})`|([^\s\"'`,;<>(){{}}\[\]]{{{MIN_KEYED},}}))"
    rf"|\b(?i:bearer)\s+([A-Za-z0-9._~+/=\-]{{{MIN_CHARS},}}))"
)
_FORMAT = regex.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w\-]{35}|npm_\w{36}"
    r"|xox[abprs]-[\w\-]{10,}|[sr]k_(?:live|test)_\w{16,}|eyJ[\w\-]+\.eyJ[\w\-]+\.[\w\-]+"
)
_HEX = regex.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})")
_HARMLESS = regex.compile(
    r"[\d\-/]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(?:1|256|384|512)-.*|.*(?i:x{4,}|\*{4,}|your|example|changeme|placeholder|\$\{).*"
)


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS, text: str = "text") -> list[str]:
    """The ``size`` most frequent lower-case words of 3 to 12 letters over all texts; ties by the word.

    A histogram of the counts in eighths of a power of two, at most 512 rows, tells from which count on
    there are enough words; only those are ordered, so no task and not the driver gets a share of
    candidates from every partition.
    """
    words = docs.select(F.explode(split_words(F.lower(or_empty(F.col(text))), SPACE_RUN)).alias("w"))
    counts = words.filter(F.col("w").rlike(r"^\p{L}{3,12}$")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    steps = counts.groupBy("step").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, 0
    for row in steps:
        total, least = total + row["words"], row["step"]
        if total >= size:
            break
    return [r["w"] for r in counts.filter(F.col("step") >= least).orderBy(F.desc("n"), "w").limit(size).collect()]


def _coverage(token: str, words: frozenset[str]) -> float:
    """Share of the characters inside a dictionary word, looked for from left to right, longest first."""
    low, at, covered = token.lower(), 0, 0
    while at < len(low):
        hit = next((k for k in range(min(12, len(low) - at), 2, -1) if low[at : at + k] in words), 0)
        covered += hit
        at += hit or 1
    return covered / len(low)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(text: str, start: int, end: int, words: frozenset[str]) -> tuple[float, ...]:
    """The :data:`FEATURES` of one candidate of a text."""
    token = text[start:end]
    n = len(token)
    kinds = [_kind(c) for c in token]
    runs = [0]
    for a, b in zip(kinds, kinds[1:]):
        runs[-1] += a == b
        if a != b:
            runs.append(0)
    counts = Counter(token)
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    names = _WORD.findall(before)[-3:]
    near = names + _WORD.findall(after)[:2]
    lead = before.rstrip()
    bare = lead.rstrip("\"'` ")
    return (
        float(n),
        (len(runs) - 1) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        sum(c in "0123456789abcdefABCDEF" for c in token) / n,
        float(max(runs) + 1),
        _coverage(token, words),
        float(token.count("/") > 1 or before[-1:] in ("/", "\\")),
        float("://" in before[-30:] and " " not in before[before.rfind("://") :]),
        float(bare[-1:] in ("=", ":")),
        float(before[-1:] in ("\"", "'", "`")),
        float(not KEY_WORDS.isdisjoint(_parts(names))),
        float(any(w.isdigit() for w in near)),
        float(len(near)),
    )


def _parts(names: list[str]) -> set[str]:
    """Lower-case names and the parts they are made of (by ``_``, ``-`` or case), without a plural s."""
    return {w.lower().removesuffix("s") for name in names for w in (name, *_PART.findall(name))}


def evidence(text: str, start: int, end: int) -> int | None:
    """What is known of a candidate without its features: 1 for a token format or a key-sized hexadecimal value,
    0 for numbers, UUIDs, placeholders and named digests, else None."""
    token = text[start:end]
    if _FORMAT.fullmatch(token):
        return 1
    if _HARMLESS.fullmatch(token):
        return 0
    if _HEX.fullmatch(token) and text[max(0, start - 1) : start] not in ("/", "\\"):
        return int(DIGEST_WORDS.isdisjoint(_parts(_WORD.findall(text[max(0, start - 60) : start])[-3:])))
    return None


def _is_candidate(text: str, start: int, end: int) -> bool:
    """Has a digit, or is the value of an assignment."""
    return any(c.isdigit() for c in text[start:end]) or text[max(0, start - 4) : start].rstrip("\"'` ")[-1:] in ("=", ":")


def spans(text: str) -> list[tuple[int, int]]:
    """Where candidates stand, in order: values given to key names, and other runs without the name before a ``=``."""
    keyed = [m.span(m.lastindex) for m in _KEYED.finditer(text)]
    out, k = list(keyed), 0
    for m in _CANDIDATE.finditer(text):
        lo, hi = m.span()
        while k < len(keyed) and keyed[k][1] <= lo:
            k += 1
        pieces, at, j = [], lo, k
        while j < len(keyed) and keyed[j][0] < hi:
            if keyed[j][0] > at and not regex.fullmatch(r"[\w\-]+=+", text[at : keyed[j][0]]):
                pieces.append((at, keyed[j][0]))
            at, j = max(at, keyed[j][1]), j + 1
        if at < hi:
            pieces.append((at, hi))
        for a, b in pieces:
            name = _NAMED.match(text[a:b])
            if name and b - a - name.end() >= MIN_CHARS:
                a += name.end()
            if b - a >= MIN_CHARS and _is_candidate(text, a, b):
                out.append((a, b))
    return sorted(out)


def candidates(docs: DataFrame, words: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate of every whole text: doc_id, start, value, evidence and all features.

    A candidate is a run of at least :data:`MIN_CHARS` letters, digits or ``+/_=-`` with a digit in it
    or an assignment before it, or any value of at least :data:`MIN_KEYED` characters given to a name that
    speaks for a secret; ``start`` counts characters from 0. Null and empty texts have none,
    repeated rows give their candidates again, null ids stay null. ``words`` is bounded by its caller.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_column]}, start bigint, value string, evidence int, " + ", ".join(f"{f} double" for f in FEATURES)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(words)
        for batch in batches:
            ids, rows = [], []
            for at, t in enumerate(batch["text"]):
                if t is None:
                    continue
                for lo, hi in spans(t):
                    ids.append(at)
                    rows.append((lo, t[lo:hi], evidence(t, lo, hi), *describe(t, lo, hi, known)))
            out = pd.DataFrame(rows, columns=["start", "value", "evidence", *FEATURES]).astype({"evidence": "Int32"})
            out.insert(0, "doc_id", batch["doc_id"].take(ids).array)
            yield out

    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInPandas(find, schema)


def weak_label() -> Column:
    """Label of a finding where no reviewer's is at hand: its evidence, null if there is none."""
    return F.col("evidence")


def reviewed(each: int = 60, seed: int = 13) -> list[tuple[str, int, int, int]]:
    """Fixed list of (text, start, end, label) that stands for reviewed findings: ``each`` per form of value."""
    rng = random.Random(seed)
    of = lambda n, letters: "".join(rng.choices(letters, k=n))
    word = lambda: of(rng.randint(4, 9), string.ascii_lowercase)
    mixed = string.ascii_letters + string.digits
    secrets = (
        lambda: of(rng.choice((32, 40, 48, 64)), "0123456789abcdef"),
        lambda: rng.choice(("glpat-", "npm_", "sk_live_", "xoxb-")) + of(rng.randint(20, 40), mixed),
        lambda: of(rng.randint(20, 64), mixed + "+/_-"),
        lambda: of(rng.randint(9, 16), mixed + "!@#$%&*"),
        lambda: "ASIA" + of(16, string.ascii_uppercase + string.digits),
    )
    sites = ('{}_passwd = "', "{}-credential: '", "DB_PASSWD=", 'slack_token: "', "{}Passphrase = ", "Authorization: token ", "auth {} bearer ")
    harmless = (
        lambda: (f"{word()} {word()} ", of(16, string.digits)),
        lambda: (f"id {word()}: ", str(uuid.UUID(int=rng.getrandbits(128)))),
        lambda: (rng.choice(("commit ", "sha256: ", 'md5 = "', "revision ")), of(rng.choice((32, 40, 64)), "0123456789abcdef")),
        lambda: ("see ", "/" + "/".join(word() for _ in range(4)) + of(2, string.digits)),
        lambda: ("https://host.org/", "-".join(word() for _ in range(4)) + "-" + of(3, string.digits)),
        lambda: (f"{word()} = ", "_".join(word() for _ in range(3)) + of(1, string.digits)),
        lambda: (rng.choice(('password = "', "api_key: ", "token=")), rng.choice(("your_token_here", "changeme-changeme", "xxxxxxxxxxxxxxxx"))),
        lambda: (rng.choice(("key: ", "auth: ", "password: ")), word() + word()),
    )
    rows = [(rng.choice(sites).format(word()), make(), 1) for make in secrets for _ in range(each)]
    rows += [(*make(), 0) for make in harmless for _ in range(each)]
    out = []
    for lead, value, label in rows:
        lead = f"{word()} {word()} {lead}"
        quote = lead[-1] if lead[-1] in "\"'" else ""
        out.append((f"{lead}{value}{quote} {word()} {word()}", len(lead), len(lead) + len(value), label))
    return out


def remove_false_findings(found: DataFrame, labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 5) -> DataFrame:
    """``found`` with ``score``, the forest's share for a secret, and ``kept`` (a half or more).

    ``labelled`` has the features and ``label`` (0 or 1); at most about :data:`PER_CLASS` distinct
    rows of each class, by a hash of the row, fit the forest. With one class only every score is that class; with
    no labelled row nothing is removed and every score is 1.
    """
    usable = labelled.filter(F.col("label").isin(0, 1)).select(*FEATURES, F.col("label").cast("double").alias("label"), "value").distinct()
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return found.withColumn("score", F.lit(float(next(iter(totals), 1.0)))).withColumn("kept", F.col("score") >= 0.5)
    key = F.pmod(F.xxhash64("value", *FEATURES, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, PER_CLASS / totals[1.0]).otherwise(PER_CLASS / totals[0.0])
    sample = usable.filter(key < share).coalesce(2)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(vector.transform(sample))
    model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__probability")
    scored = model.transform(vector.transform(found)).withColumn("score", F.get(vector_to_array("__probability"), F.lit(1)))
    return scored.select(*found.columns, "score", (F.col("score") >= 0.5).alias("kept"))


def scan(docs: DataFrame, trained_on: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All findings of ``docs`` with score and kept; the forest learns from rows where ``trained_on`` holds
    and that have evidence, and from the list of :func:`reviewed` forms.

    ``trained_on`` is a condition on ``doc_id``.
    """
    words = dictionary(docs, text=text)
    found = settle(candidates(docs, words, id_column, text))
    known = frozenset(words)
    fixed = [(*describe(t, lo, hi, known), label, t[lo:hi]) for t, lo, hi, label in reviewed()]
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label int, value string"
    own = found.filter(trained_on).select(*FEATURES, weak_label().alias("label"), "value")
    return remove_false_findings(found, own.union(docs.sparkSession.createDataFrame(fixed, schema)))
