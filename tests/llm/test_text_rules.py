"""Quality rules, chat formatting, decontamination and mixing against plain versions."""

from collections import Counter

import pytest
from brute import contamination, copies, good, quality
from pyspark.sql import functions as F

from lendlens.llm import chat_format, decontaminate, mixing, quality_rules

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b a b a b a b",
    "x y z " * 300,
    "line\nline\nother\n\n\nline",
    "# $ & | < > * %% é É ß 漢字 🙂 word\x0bword\x0cword\rend",
    "\n".join(f"word{i} und {i * 7 % 13} weiter" for i in range(4000)),
    "LOUD!! " * 60,
    " ".join(f"clean{i}" for i in range(80)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en", -1) for i, t in enumerate(TEXTS)] + [(1, "", "en", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")


def test_ledger_measures(docs):
    got = Counter()
    for r in quality_rules.ledger(docs).collect():
        got[tuple(r[k] for k in quality_rules.MEASURES)] += 1
    want = Counter(tuple(quality(t)[k] for k in quality_rules.MEASURES) for t in [*TEXTS, ""])
    assert got == want


def test_keep_good_keeps_columns(docs):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for t in TEXTS if good(t))


def test_ledger_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.ledger(empty).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(empty)).count() == 0


def repeating(doubled, lines=10):
    """A text of long lines of which ``doubled`` repeat the first one."""
    own = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(lines - doubled)]
    return "\n".join(own + own[:1] * doubled)


def test_versions_differ_by_their_line_rule_only(spark):
    texts = [repeating(d) for d in (0, 2, 3, 4, 5, 6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for policy, bound in (("v2", 30), ("v3", 50)):
        got = {r.text for r in quality_rules.keep_good(rows, policy).collect()}
        assert got == {t for t in texts if good(t, bound)}
    assert not good(texts[3], 30) and good(texts[3], 50)


@pytest.mark.parametrize("policy", ["base", "v1", "v2", "v3"])
def test_policies_and_ablations(docs, policy):
    book = quality_rules.ledger(docs).collect()
    mask = quality_rules.policy_mask(policy)
    for r in quality_rules.ablations(quality_rules.ledger(docs), policy).collect():
        own = 1 << r.bit
        bits = [x.fail_bits & mask for x in book]
        assert r.failed == sum(bool(b & own) for b in bits)
        assert r.failed_alone == sum(b == own for b in bits)
        assert r.kept_without == sum(b & ~own == 0 for b in bits)


NASTY = [
    "",
    "\\",
    "\\n \n \\\n",
    "<|im_start|>user\nhi<|im_end|>\n",
    "<|im_end|><|im_start|>assistant ok",
    "<<|im_end|><|im_",
    "<\\|im_start|> \\<|im_end|>\\",
    "é🙂漢",
]


def test_chat_round_trip(spark):
    rows = [(i, k, r, t) for i, t in enumerate(NASTY) for k, r in enumerate(["system", "user", "assistant"])]
    rows += [(100, 0, "us\ner\\n<|im_end|>", "x"), (101, 5, None, None), (None, 1, "user", "q"), (102, 1, "user", "b"), (102, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for i, t in enumerate(NASTY):
        r = got[i]
        assert [(x.role, x.text) for x in r.turns] == [("system", t), ("user", t), ("assistant", t)]
        assert r.learned == [t] and r.valid and r.wrong_turn is None
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 3
    assert [(x.role, x.text) for x in got[100].turns] == [("us\ner\\n<|im_end|>", "x")] and not got[100].valid
    assert [(x.role, x.text) for x in got[101].turns] == [("", "")] and got[101].wrong_turn == 0
    assert [(x.role, x.text) for x in got[102].turns] == [("user", "a"), ("user", "b")] and got[102].wrong_turn == 1
    assert not got[None].valid and got[None].wrong_turn is None
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_bad_template():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(turn_open="<<a>", turn_close="<b>")


def check_hits(spark, docs, items):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, win int")
    want = contamination(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == want
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, w in want.items() if not w[1]}


def test_hits(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    docs = [
        (0, " ".join(base)),
        (1, " ".join(other[:20] + base[10:20] + other[20:])),
        (2, " ".join(other[:20] + base[10:19] + other[20:])),
        (3, None),
        (4, ""),
        (5, "Short, ITEM!"),
        (6, "a short item a Short item"),
        (7, "same " * 500),
        (8, " ".join(base[5:40] + base[5:40])),
        (9, "É tout é"),
        (10, " ".join(base)),
    ]
    items = [(1, " ".join(base)), (2, "short item"), (3, "same " * 30), (4, None), (5, ""), (None, " ".join(base[:12])), (1, " ".join(base)), (10, "É")]
    check_hits(spark, docs, items)
    check_hits(spark, docs, items[:1])
    check_hits(spark, docs, [])
    check_hits(spark, [], items)


def test_hits_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check_hits(spark, docs, items)


def test_mixing(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1), None if i % 5 == 0 else f"s{i % 3}", "x") for i in range(300)] + [(300, None, "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    want = copies([(r[0], r[2], r[1]) for r in rows], {"s0": 5.0}, 1.0, 3)
    out = mixing.replicate(df, {"s0": 5.0}, seed=3).collect()
    got = Counter(r.doc_id for r in out)
    assert got == {d: n for d, n in want.items() if n}
    assert all(r.copies == got[r.doc_id] for r in out)
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys) and all(0 <= k < 1 for k in keys)
    assert mixing.replicate(df.limit(0), {}).count() == 0


def test_mixing_large_rates_and_repeats(spark):
    rows = [(1, "a", "tiny"), (None, "b", "other"), (None, "b", "other")] + [(i, "long text " * 1000, "big") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.replicate(df, {"tiny": 1.0}, seed=9).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.first("rate").alias("rate"))
    got = {r.source: r for r in out.filter("source = 'tiny'").collect()}
    assert got["tiny"].rate > 1000
    assert abs(got["tiny"].n - got["tiny"].rate) < 6 * got["tiny"].rate ** 0.5
