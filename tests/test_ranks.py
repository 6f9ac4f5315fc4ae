"""Distributed numbering and totals against plain windows, with one key holding most rows."""

import math
import random

import pytest
from pyspark.sql import Window as W, functions as F

from lendlens.operators import fairness, quantiles, ranks, sampling, selection
from lendlens.shared import settle, shared_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """20 000 rows: two thirds in group 'hot', a third of all amounts equal, some group keys null."""
    i = F.col("id")
    group = F.when(i % 3 < 2, "hot").when(i % 7 == 0, None).otherwise((i % 50).cast("string"))
    return spark.range(20000).select(
        i,
        group.alias("g"),
        F.when(i % 3 == 0, 5.0).otherwise((i * 7919 % 10007).cast("double")).alias("amount"),
        (i % 5 == 0).cast("int").alias("label"),
    )


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_settle_keeps_rows_and_types(skewed):
    stored = settle(skewed)
    assert stored.schema == skewed.schema or [f.dataType for f in stored.schema] == [f.dataType for f in skewed.schema]
    assert same(stored, skewed)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_row_numbers(skewed, groups):
    window = W.partitionBy(*(groups or [F.lit(0)])).orderBy("amount", "id")
    want = skewed.withColumn("rn", F.row_number().over(window).cast("bigint"))
    assert same(ranks.row_numbers(skewed, ["amount", "id"], groups), want)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_rank_by_key(skewed, groups):
    key = F.col("id") * 7919 % 1000003
    window = W.partitionBy(*(groups or [F.lit(0)])).orderBy(key, "id")
    want = skewed.withColumn("rn", F.row_number().over(window).cast("bigint"))
    assert same(ranks.rank_by_key(skewed, key, "id", 1000003, groups, buckets=64), want)


def test_hex_key_follows_the_id_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    want = df.withColumn("rn", F.row_number().over(W.orderBy("k")).cast("bigint"))
    assert same(ranks.rank_by_key(df, ranks.hex_key("k"), "k", 1 << 32, buckets=16), want)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_totals(skewed, groups):
    counted = skewed.groupBy(*groups, "amount").agg(F.count("*").alias("n"))
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    want = counted.select(
        "*",
        F.sum("n").over(whole.orderBy("amount").rowsBetween(W.unboundedPreceding, 0)).alias("cum"),
        F.sum("n").over(whole).alias("cum_total"),
    )
    assert same(ranks.running_totals(counted, ["amount"], {"cum": "n"}, groups), want)


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_ntile(skewed, buckets):
    want = skewed.withColumn("t", F.ntile(buckets).over(W.orderBy("amount", "id")))
    assert same(ranks.ntile(skewed, [F.col("amount"), F.col("id")], buckets, "t"), want)


def test_best_row_orders_and_breaks_ties(skewed):
    got = ranks.best_row(skewed, ["g"], [ranks.descending("amount")])
    want = skewed.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(F.desc("amount"), "id"))).filter("r = 1").drop("r")
    assert same(got.select(want.columns), want)


def test_quantiles_match_percentile(skewed):
    got = quantiles.column_quantiles(skewed, ["amount"], [0.0, 0.25, 0.5, 1.0], ["g"])
    want = skewed.groupBy("g").agg(F.expr("percentile(amount, array(0D, 0.25D, 0.5D, 1D))").alias("p"))
    pairs = got.join(want, got.g.eqNullSafe(want.g)).select("q0", "q1", "q2", "q3", "p").collect()
    assert len(pairs) == want.count()
    for r in pairs:
        assert [r.q0, r.q1, r.q2, r.q3] == pytest.approx(list(r.p))


def test_grouped_medians_leave_out_null_keys(skewed):
    out = quantiles.grouped_medians(skewed, {"by": (["g"], ["amount"]), "all": ([], ["amount"])})
    assert out["by"].filter("g is null").isEmpty()
    want = {r.g: r.m for r in skewed.filter("g is not null").groupBy("g").agg(F.median("amount").alias("m")).collect()}
    assert {r.g: r.median_amount for r in out["by"].collect()} == pytest.approx(want)
    assert out["all"].collect()[0].median_amount == skewed.agg(F.median("amount")).collect()[0][0]


def test_samples_have_the_exact_size_and_repeat(skewed):
    one = sampling.sample_n(skewed, 333, "id", seed=7)
    assert one.count() == 333
    assert same(one, sampling.sample_n(skewed.repartition(13), 333, "id", seed=7))
    assert not same(one, sampling.sample_n(skewed, 333, "id", seed=8))
    assert sampling.sample_n(skewed, 10**9, "id").count() == 20000
    assert sampling.sample_n(skewed, 0, "id").count() == 0


def test_sample_per_group_keeps_small_groups_whole(skewed):
    sizes = {r.g: r["count"] for r in skewed.groupBy("g").count().collect()}
    got = {r.g: r["count"] for r in sampling.sample_n_per_group(skewed, ["g"], 100, "id").groupBy("g").count().collect()}
    assert got == {g: min(100, n) for g, n in sizes.items()}


def test_stratified_sample_meets_its_allocation(skewed):
    shares = sampling.allocate(skewed, ["g"], "label", 2000).collect()
    got = {
        (r.g, r.label): r["count"]
        for r in sampling.stratified_sample(skewed, ["g"], "label", 2000, "id").groupBy("g", "label").count().collect()
    }
    for s in shares:
        assert got.get((s.g, 1), 0) == int(s.sample_size_group * s.approval_rate)
        assert got.get((s.g, 0), 0) == int(s.sample_size_group * (1 - s.approval_rate))


def test_split_covers_every_row_once(skewed):
    split = sampling.split_stratified(skewed, ["label"], 0.1, "id")
    assert split.count() == 20000
    for r in split.groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == int(r.n * 0.1)


def test_interleave_alternates_then_appends_the_rest(skewed):
    got = sampling.interleave(skewed, "label", 100, "id")
    rows = got.orderBy("global_row_number").select("global_row_number", "label", "chunk_number").collect()
    assert [r[0] for r in rows] == list(range(1, 20001))
    assert [r.label for r in rows[:8000]] == [0, 1] * 4000
    assert {r.label for r in rows[8000:]} == {0}
    assert rows[99].chunk_number == 0 and rows[100].chunk_number == 1


def test_chunks_are_dense(skewed):
    got = sampling.assign_chunks(skewed, 300, "id")
    r = got.agg(F.count_distinct("global_row_number").alias("d"), F.max("global_row_number").alias("m"), F.max("chunk_number").alias("c")).collect()[0]
    assert (r.d, r.m, r.c) == (20000, 20000, 66)


@pytest.mark.parametrize("buckets,few", [(4096, 10_000), (16, 5)])
def test_cells_refine_to_exact_order_statistics(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    rng = random.Random(8)
    groups = {
        "tail": [math.exp(rng.gauss(0, 8)) * rng.choice([1, -1]) for _ in range(700)] + [1e308, -1e308, 5e-324, 0.0],
        "ties": [float(rng.randint(0, 3)) for _ in range(500)] + [1e9],
        "odd": [math.inf, -math.inf, math.nan, math.nan, 2.0, 3.0, -1.0],
        "one": [7.25],
        "same": [-3.5] * 40,
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found = selection.cells(spark.createDataFrame(rows, "g string, value double"), ["g"], probs).collect()
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (math.isnan(v), v))
        mine = [r for r in found if r.g == g]
        assert {r.upto_total for r in mine} == {len(vs)}
        for p in probs:
            for at in (math.floor(p * (len(vs) - 1)), math.ceil(p * (len(vs) - 1))):
                (hit,) = [r for r in mine if r.upto - r.n <= at < r.upto]
                assert hit.value == vs[at] or (math.isnan(hit.value) and math.isnan(vs[at]))


def test_large_and_small_groups_agree_with_percentile(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 60)
    rows = [(None if i % 7 == 0 else i % 3, float(i * i % 101) if i % 5 else None, float(i)) for i in range(300)]
    df = spark.createDataFrame([*rows, (9, None, 1.0)], "g int, a double, b double")
    got = quantiles.column_quantiles(df, ["a", "b"], [0.1, 0.5], ["g"])
    want = df.groupBy("g").agg(*[F.expr(f"percentile({c}, array(0.1, 0.5))").alias(c) for c in "ab"]).collect()
    want = {(r.g, c): tuple(r[c]) for r in want for c in "ab" if r[c]}
    assert {(r.g, r.column_name): (r.q0, r.q1) for r in got.collect()} == want
    grains = quantiles.grouped_quantiles(df, {"by": (["g"], ["b"]), "all": ([], ["a"])}, {"median": 0.5})
    by = {r.g: r.median_b for r in grains["by"].collect()}
    assert by == {g: q[1] for (g, c), q in want.items() if c == "b" and g is not None}
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_bucket_totals_match_plain_window(spark, groups, descending):
    rng = random.Random(9)
    values = [rng.random() for _ in range(300)] + [-4.0, 0.0, 1.0, 7.5, math.inf, -math.inf, math.nan, None]
    rows = [(g, v, rng.randint(0, 5)) for g in ("a", None) for v in dict.fromkeys(values)]
    df = spark.createDataFrame(rows, "g string, value double, n long")
    if not groups:
        df = df.groupBy("value").agg(F.sum("n").alias("n"))
    got = ranks.bucket_totals(df, "value", {"t": "n"}, groups, descending, buckets=16)
    order = F.col("value").desc() if descending else F.col("value")
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    want = df.select("*", F.sum("n").over(whole.orderBy(order)).alias("t"), F.sum("n").over(whole).alias("t_total"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()


def test_auc_on_distinct_and_tied_scores(spark):
    rng = random.Random(10)
    for scores in ([rng.random() for _ in range(400)], [rng.randint(0, 3) / 3 for _ in range(200)], [0.5 + rng.random() / 1e6 for _ in range(200)]):
        rows = [(s, int(rng.random() < s)) for s in scores]
        pos, neg = [s for s, a in rows if a], [s for s, a in rows if not a]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        got = fairness.auc(spark.createDataFrame(rows, "score double, actual_value int")).first()["auc_roc"]
        assert abs(got - want) < 1e-12


def test_shared_folder_is_not_a_machine_s_own():
    from types import SimpleNamespace

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *default: conf.get(k, *default)))

    own, key = "spark.sql.warehouse.dir", "spark.checkpoint.dir"
    assert shared_folder(session(**{"spark.master": "local[8]", own: "file:/w/"})) == "file:/w-settled"
    assert shared_folder(session(**{"spark.master": "yarn", own: "hdfs://n/w"})) == "hdfs://n/w-settled"
    assert shared_folder(session(**{"spark.master": "yarn", own: "file:/w", key: "hdfs://n/c"})) == "hdfs://n/c"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(**{"spark.master": master, own: "file:/w"}))


def test_slot_widths_divide_each_other():
    for span, buckets in ((1 << 31, 4096), (1000003, 4096), (1000003, 4), (7, 2), (1, 4)):
        widths = ranks._slot_widths(span, buckets)
        assert widths[-1] == 1 and widths[0] * buckets >= span
        assert all(a % b == 0 and a > b for a, b in zip(widths, widths[1:]))


@pytest.mark.parametrize("buckets,slice_rows", [(4, 1), (4, 50), (4096, 5), (4096, 100_000)])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_cutoffs_split_their_edges(skewed, monkeypatch, buckets, slice_rows, groups):
    key = (F.col("id") * 7919) % 1000003
    ranked = []
    plain = ranks.match_on
    monkeypatch.setattr(ranks, "match_on", lambda *a, **k: ranked.append(plain(*a, **k)) or ranked[-1])
    cuts = ranks.key_cutoffs(skewed, key, "id", 1000003, F.lit(333), groups, buckets=buckets, slice_rows=slice_rows)
    # only the last edges are ranked: keys of the fixture are distinct, so an edge can be split down to a row
    edge = ranked[-1].groupBy(*groups, "__bucket").count().agg(F.max("count")).first()[0]
    assert edge <= slice_rows
    position = F.row_number().over(W.partitionBy(*(groups or [F.lit(0)])).orderBy(key, "id"))
    want = skewed.withColumn("rn", position).filter("rn <= 333").select("id")
    joined = ranks.match_on(skewed, cuts, groups) if groups else skewed.crossJoin(cuts)
    assert same(joined.filter(ranks.within_cutoff(key, "id")).select("id"), want)


def test_cutoffs_with_equal_keys_fall_back_on_the_id(skewed):
    cuts = ranks.key_cutoffs(skewed, F.lit(3), "id", 1000, F.lit(10), [], buckets=4, slice_rows=5)
    assert [tuple(r) for r in cuts.select("keep_all", "cut_key", "cut_id").collect()] == [(False, 3, 9)]


def test_cutoffs_of_nothing(skewed):
    key = F.col("id") % 1000
    assert ranks.key_cutoffs(skewed.limit(0), key, "id", 1000, F.lit(5), ["g"]).isEmpty()
    assert ranks.key_cutoffs(skewed, key, "id", 1000, F.lit(0), []).isEmpty()


def test_interleave_refuses_labels_that_are_no_classes(skewed):
    with pytest.raises(ValueError, match="not a class"):
        sampling.interleave(skewed, "id", 100, "id")


def test_numbers_with_group_totals(skewed):
    got = ranks.row_numbers(skewed, ["amount", "id"], ["g"], total="n")
    within = W.partitionBy("g")
    want = skewed.withColumn("rn", F.row_number().over(within.orderBy("amount", "id"))).withColumn("n", F.count(F.lit(1)).over(within))
    assert same(got, want)


@pytest.fixture
def settled_frames(monkeypatch):
    """What the numbering writes to the shared folder."""
    written = []
    monkeypatch.setattr(ranks, "settle", lambda df, *a: written.append(settle(df, *a)) or written[-1])
    return written


def test_numbering_writes_splitters_only(skewed, settled_frames):
    wide = skewed.withColumn("text", F.repeat(F.lit("x"), 100))
    got = ranks.row_numbers(wide, ["amount", "id"], ["g"])
    window = W.partitionBy("g").orderBy("amount", "id")
    assert same(got, wide.withColumn("rn", F.row_number().over(window).cast("bigint")))
    assert [df.columns for df in settled_frames] == [["cuts"]]
    cuts = settled_frames[0].first()["cuts"]
    assert 1 < len(cuts) < 8 and cuts == sorted(cuts, key=lambda c: (c["k0"] is not None, c))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_slices_are_even_and_split_ties(skewed):
    keys = [F.col("amount"), F.col("id")]
    cuts = settle(ranks.key_splitters(skewed, keys, 16, thin=4)).scalar()
    key = F.struct(F.col("amount").alias("k0"), F.col("id").alias("k1"))
    placed = skewed.withColumns({"key": key, "cuts": cuts}).withColumn("s", ranks.slice_of(F.col("key"), F.col("cuts"), 16))
    sizes = {r["s"]: r["n"] for r in placed.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 2 * 20000 / 16
    # a third of all amounts are 5.0, and they lie in several slices
    assert placed.filter("amount = 5.0").select("s").distinct().count() >= 4
    spans = placed.groupBy("s").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("s").collect()
    assert all(tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("slices", [1, 2, 3, 8, 37])
def test_slice_of_is_a_bisection(spark, slices):
    cuts = F.array(*[F.lit(10 * i) for i in range(1, slices)]).cast("array<bigint>")
    df = spark.range(0, 400, 5).withColumn("s", ranks.slice_of(F.col("id"), cuts, slices))
    assert all(r["s"] == min(r["id"] // 10, slices - 1) for r in df.collect())


def test_numbering_of_odd_orders(spark):
    nan = float("nan")
    rows = [(i, [None, nan, -0.0, 0.0, 1.5, -1.5][i % 6], f"t{i % 11}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, x double, t string")
    for order in (["x", "t", "id"], [ranks.descending("id")], [F.isnull("x"), "t", "x", "id"]):
        want = df.withColumn("rn", F.row_number().over(W.orderBy(*order)).cast("bigint"))
        assert same(ranks.row_numbers(df, order), want)
    assert ranks.row_numbers(df.limit(0), ["id"]).count() == 0
    assert ranks.row_numbers(df.limit(1), ["id"], ["t"]).first()["rn"] == 1
