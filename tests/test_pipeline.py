"""Plans and feature operators on register-shaped literal rows."""

import pytest
from pyspark.sql import functions as F

from lendlens.operators import cleaning, counterfactual, enrich, fairness, features, modeling, profiling, quality, quantiles, rates
from lendlens.plans import lending, staging
from lendlens.queries import QUERIES
from lendlens.schemas import LAR_TEXT_COLUMNS, canonical_lar

RACE = rates.RACE


def lar(spark, *rows):
    data = [tuple(r.get(c) for c in LAR_TEXT_COLUMNS) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in LAR_TEXT_COLUMNS))


def test_stage_lar_sentinels(spark):
    base = dict(activity_year="2018", action_taken="1", lei="L", loan_amount="105000.0", income="85", census_tract="37057061600.0")
    row = staging.stage_lar(
        lar(
            spark,
            {**base, "applicant_age": "8888", "co_applicant_age": "9999", "interest_rate": "Exempt", "aus_1": "1111", "aus_2": "2",
             "prepayment_penalty_term": "exempt", "total_loan_costs": "12.34", "debt_to_income_ratio": "EXEMPT", "balloon_payment": "1111"},
        )
    ).collect()[0]
    assert (row.loan_amount, row.income, row.census_tract) == (105000, 85000, "37057061600")
    assert (row.applicant_age, row.co_applicant_age, row.interest_rate, row.aus_1, row.aus_2) == (None, None, None, None, 2)
    assert (row.prepayment_penalty_term, row.debt_to_income_ratio, row.balloon_payment) == (None, None, None)
    assert str(row.total_loan_costs) == "12.34"


def test_stage_lar_income_and_duplicates(spark):
    rows = [dict(activity_year="2018", lei="A", income=i, applicant_age=a) for i, a in [("0", "25-34"), ("-5", None), ("85", ">74"), ("85", "<25")]]
    raw = lar(spark, *rows)
    got = staging.stage_lar(raw)
    assert sorted((r.income or 0) for r in got.collect()) == [-5000, 0, 85000]
    assert [r.applicant_age for r in got.filter("income = 85000").collect()] == ["<25"]
    assert tuple(staging.collapsed_count(raw).collect()[0]) == (1, 1)


def ticking(spark, column):
    """``column`` through a function that counts its calls, and the count."""
    seen = spark.sparkContext.accumulator(0)

    def tick(v):
        seen.add(1)
        return v

    return F.udf(tick, "string").asNondeterministic()(column), seen


def test_stage_lar_reads_the_register_once(spark):
    """Every further pass would join and shuffle the register again."""
    lei, seen = ticking(spark, F.concat(F.lit("L"), (F.col("id") % 20).cast("string")))
    given = {"activity_year": F.lit("2018"), "loan_amount": F.lit("5.0"), "applicant_age": (F.col("id") + 10).cast("string"), "lei": lei}
    raw = spark.range(40).select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in LAR_TEXT_COLUMNS])
    got = staging.stage_lar(raw).collect()
    assert sorted(int(r.applicant_age) for r in got) == list(range(10, 30))
    assert seen.value == 40


def test_preprocess_reads_its_features_once(spark):
    from lendlens.queries import pipeline

    given = lending.model_features(pipeline.raw_tables(spark, "/root/testdata/sf0.001"), pipeline.AS_OF)
    given = features.settle(given.select(*features.INPUT_COLUMNS))
    purpose, seen = ticking(spark, F.col("loan_purpose").cast("string"))
    counted = given.withColumn("loan_purpose", purpose.cast("int"))
    got = features.preprocess(counted, rare_minimum=30)
    assert got.count() == given.filter("loan_purpose <> 5").count()
    assert seen.value == given.count()


def test_interleaved_training_works_its_table_out_once(spark, monkeypatch):
    from lendlens.queries import pipeline

    lender, seen = ticking(spark, F.concat(F.lit("L"), (F.col("id") % 3).cast("string")))
    table = spark.range(40).select(
        F.md5(F.col("id").cast("string")).alias("loan_application_id"), (F.col("id") % 2).cast("int").alias("loan_approved"),
        lender.alias("lender_entity_name"),
    )
    monkeypatch.setattr(pipeline, "preprocessed", lambda spark, sf: table)
    assert tuple(QUERIES["interleaved_training"](spark, "").collect()[0]) == (40, True, True, True)
    assert seen.value == 40


def test_constants_stay_out_of_the_joins(spark):
    """A struct of all constants on every row made the joined rows too wide to be compiled, and was copied in each join."""
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 5.0, 6.0)], "g string, x double, y double")
    grains = {"by": (["g"], ["x", "y"]), "all": ([], ["x"])}
    joined, median = features.attach_medians(df, quantiles.grouped_medians(df, grains), grains, "__all")
    assert len(joined.columns) == len(df.columns) + 1
    got = {tuple(r) for r in joined.select("x", median["by"]("x"), median["by"]("y")).collect()}
    assert got == {(1.0, 2.0, 2.0), (3.0, 2.0, 2.0), (5.0, 5.0, 6.0)}


def test_best_zip_prefers_residents_then_lowest(spark):
    walk = spark.createDataFrame(
        [("T", "3", "c", "WI", 0.5), ("T", "2", "c", "WI", 0.5), ("T", "1", "c", "WI", 0.9), ("U", "9", "c", "WI", 0.0), ("U", "8", "c", "WI", None)],
        "census_tract string, zip_code string, city_name string, state_name string, residential_ratio double",
    )
    market = spark.createDataFrame([("2",), ("3",), ("8",), ("9",), ("9",)], "zip_code string")
    got = {r.census_tract: r.zip_code for r in enrich.best_zip(walk, market).collect()}
    assert got == {"T": "2", "U": "9"}


def test_income_buckets_put_missing_last(spark):
    acs = spark.createDataFrame([("a", 10), ("b", None), ("c", 30), ("d", 20)], "census_tract string, median_household_income int")
    assert {r.census_tract: r.income_bucketed for r in enrich.income_buckets(acs).collect()} == {"a": 1, "d": 2, "c": 3, "b": 4}


def test_prior_history_skips_a_gap_year(spark):
    df = spark.createDataFrame([("T", 2018, 1), ("T", 2018, 0), ("T", 2020, 1), ("T", 2021, 0)], "census_tract string, activity_year int, loan_approved int")
    got = {r.activity_year: r.prior_approval_rate for r in features.prior_rate_history(df).collect()}
    assert got == {2018: None, 2020: 0.5, 2021: pytest.approx(2 / 3)}


def test_prior_rates_need_the_year_before(spark):
    df = spark.createDataFrame(
        [("L", 2018, "White", 1), ("L", 2018, "Black", 0), ("L", 2018, "AAPI", 1), ("L", 2020, "White", 1)],
        f"lender_entity_name string, activity_year int, {RACE} string, loan_approved int",
    )
    prior = rates.prior_rates(df, "lender_entity_name", "p", overall="all_rate", gap="gap")
    got = {r.activity_year: r for r in rates.attach_prior(df, prior, "lender_entity_name").collect()}
    assert got[2020].p_white is None
    nxt = {r.activity_year: r for r in prior.collect()}[2019]
    assert (nxt.p_white, nxt.p_black, nxt.p_latinx, nxt.all_rate, nxt.gap) == (1.0, 0.0, None, pytest.approx(2 / 3), 0.0)


def test_impute_uses_each_level(spark):
    rows = [(1, "a", "x", 10.0), (2, "a", "x", None), (3, "a", "y", None), (4, "b", "y", None), (5, None, None, None), (6, "c", "z", 30.0), (7, "q", "x", None)]
    df = spark.createDataFrame(rows, "id int, zip string, purpose string, v double")
    got = {r.id: r.v for r in features.impute_hierarchical(df, {"v": [["zip", "purpose"], ["zip"], ["purpose"], []]}).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 10.0, 4: 20.0, 5: 20.0, 6: 30.0, 7: 10.0}


def test_collapse_rare_at_the_threshold(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2, "c string")
    got = rates.collapse_rare(df, "c", 3, "g").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 3, "Other": 2}


def scored(spark, rows):
    return spark.createDataFrame(rows, "race string, actual_value int, predicted_label int, score double")


def test_fairness_without_positives_or_reference(spark):
    df = scored(spark, [("White", 1, 1, 0.9), ("White", 0, 0, 0.1), ("Black", 0, 1, 0.5), ("Unknown", 1, 1, 1.0)]).withColumn("activity_year", F.lit(2018))
    counts = fairness.group_counts(df, ["activity_year", "race"])
    got = {r.race: r for r in fairness.gap_vs_reference(fairness.fairness_metrics(counts), group="race").collect()}
    assert set(got) == {"White", "Black"}
    assert got["Black"].true_positive_rate is None and got["Black"].is_tpr_gap_significant is False
    assert got["White"].tpr_gap == 0.0
    none = fairness.fairness_metrics(counts.filter("race <> 'White'"))
    assert fairness.gap_vs_reference(none, group="race").isEmpty()


def test_f1_and_its_reference_variant(spark):
    df = scored(spark, [("g", 1, 1, 0.9)] * 2 + [("g", 1, 0, 0.2)] + [("g", 0, 1, 0.8)])
    r = fairness.fairness_metrics(fairness.group_counts(df, ["race"])).collect()[0]
    assert r.f1_score == pytest.approx(4 / 6) and r.f1_reference == pytest.approx(4 / 5)


def test_auc_with_ties_and_its_mirror(spark):
    rows = [("g", i % 2, 0, s) for i, s in enumerate([0.1, 0.5, 0.5, 0.5, 0.9, 0.7, 0.0, 1.0])]
    df = scored(spark, rows)
    pos, neg = [s for _, a, _, s in rows if a], [s for _, a, _, s in rows if not a]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    auc = fairness.auc(df).collect()[0].auc_roc
    mirrored = fairness.auc(df.withColumn("score", 1 - F.col("score"))).collect()[0].auc_roc
    assert auc == pytest.approx(want) and auc + mirrored == pytest.approx(1)
    assert fairness.auc(df.filter("actual_value = 1")).collect()[0].auc_roc is None


def test_cdf_ends_at_one(spark):
    df = scored(spark, [("a", 1, 1, 0.2), ("a", 1, 1, 0.2), ("a", 1, 1, 0.7), ("b", 0, 0, 0.5)])
    got = {(r.race, r.score): r.percentile for r in fairness.score_cdf(df, "race").collect()}
    assert got == {("a", 0.2): pytest.approx(2 / 3), ("a", 0.7): 1.0, ("b", 0.5): 1.0}


def test_redlining_flags(spark):
    rows = [("T", "White", 0.8, 0.9), ("T", "Black", 0.6, 0.7), ("T", "AAPI", 0.6, 0.8), ("U", "Black", 0.1, 0.1)]
    agg = spark.createDataFrame(rows, "census_tract string, race string, avg_score double, avg_score_given_positive double").withColumns(
        {"total_apps": F.lit(10), "actual_positives": F.lit(5), "predicted_positives": F.lit(6)}
    )
    got = {(r.census_tract, r.race): (r.is_possible_redlining, r.is_redlining) for r in fairness.redlining(agg).collect()}
    assert got == {("T", "White"): (0, 0), ("T", "Black"): (1, 1), ("T", "AAPI"): (1, 0), ("U", "Black"): (0, 0)}


def test_group_flip_rewrites_three_columns(spark):
    df = spark.createDataFrame([("1", "Black", "Black_WI", "Not_Black", 0.45)], f"loan_application_id string, {RACE} string, race_state_interaction string, distressed_or_underserved_race string, score double")
    got = {r.new_race: r for r in counterfactual.flip_groups(df).collect()}
    assert set(got) == {"White", "Latinx", "AAPI"}
    r = got["White"]
    assert (r[RACE], r.race_state_interaction, r.distressed_or_underserved_race, r.original_race) == ("White", "White_WI", "Not_White", "Black")


def test_clean_lar_meets_the_canonical_schema(spark):
    raw = spark.createDataFrame(
        [("C", "1", "1111", "8888", "6", "5.0", "6", "9"), ("NC", "2", "2", "25-34", "24", "2", "7", "10")],
        "conforming_loan_limit string, reverse_mortgage string, submission_of_application string, applicant_age string, "
        "applicant_sex string, applicant_race_1 string, aus_1 string, denial_reason_1 string",
    )
    got = cleaning.clean_lar(raw)
    from lendlens.operators.schema import validate_schema

    validate_schema(got, canonical_lar())
    a, b = got.orderBy(F.desc("conforming_loan_limit")).collect()
    assert (a.conforming_loan_limit, a.reverse_mortgage, a.submission_of_application_category, a.submission_of_application) == (1, 1, "Exempt", None)
    assert (a.applicant_age, a.applicant_sex, a.applicant_sex_category) == (None, 3, "Male and Female")
    assert (a.applicant_race_1_category, a.applicant_race_1_category_grouped, b.applicant_race_1_category_grouped) == ("White", "White", "AAPI")
    assert (a.aus_1, b.aus_1_category, a.denial_reason_1_category, b.denial_reason_1) == (None, "Internal Proprietary System", "Other", None)


def test_decode_leaves_unknown_codes_null(spark):
    dim = spark.createDataFrame([("sex", 1, "Male"), ("race", 5, "White")], "column_name string, category_value int, category_title string")
    df = spark.createDataFrame([(1, 5), (9, None)], "s int, r int")
    got = cleaning.decode(df, dim, {"sex_label": ("s", "sex"), "race_label": ("r", "race")}).collect()
    assert [(x.sex_label, x.race_label) for x in got] == [("Male", "White"), (None, None)]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert quality.check_unique(df, ["k"]).collect()[0].n == 2
    assert quality.check_not_null(df, "v").count() == 1 and quality.rows_with_nulls(df).count() == 1
    quality.assert_same_count(df, df)
    with pytest.raises(AssertionError):
        quality.assert_same_count(df, df.limit(1))
    quality.assert_covered(df, df, "k")
    with pytest.raises(AssertionError):
        quality.assert_covered(df, df.filter("k = 1"), "k")


def test_histogram_of_a_constant_column(spark):
    got = profiling.histogram(spark.range(5).select(F.lit(3.0).alias("x")), "x", 10).collect()
    assert [(r.bin, r.n) for r in got] == [(1, 5)]


def test_model_recovers_a_plain_rule(spark):
    df = spark.range(400).select(
        F.col("id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("c"),
        ((F.col("id") % 20) > 10).cast("int").alias("y"),
    )
    model = modeling.train(df, "decision_tree", "y", ["x"], ["c"])
    out = modeling.score(model, df, ["x"], ["c"]).withColumnRenamed("y", "actual_value")
    r = modeling.evaluate(out).collect()[0]
    assert (r.auc, r.auc_of_labels, r.accuracy, r.f1_score) == (1.0, 1.0, 1.0, 1.0)
    top = modeling.importances(model, df, ["x"], ["c"]).orderBy(F.desc("importance")).collect()[0]
    assert (top.feature, top.importance) == ("x", pytest.approx(1.0))


def test_external_model_scores_in_batches(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 1.0)
    got = modeling.score_external(df, lambda: (lambda pdf: pdf["x"] * 2), ["x"])
    assert [r.score for r in got.orderBy("id").collect()] == [2.0 * i for i in range(10)]


def test_whole_pipeline_invariants(spark):
    from lendlens.queries import pipeline

    sf = "/root/testdata/sf0.001"
    stored = features.settle(lending.model_features(pipeline.raw_tables(spark, sf), pipeline.AS_OF))
    t = features.settle(features.preprocess(stored, rare_minimum=10))
    n = t.count()
    assert n == stored.filter("loan_purpose in (1, 2, 31, 32, 4)").count()
    assert t.agg(F.count_distinct("rn").alias("d"), F.max("rn").alias("m")).collect()[0] == (n, n)
    must = [c for c in t.columns if c not in ("dti_bin", "income_to_loan_ratio_stratified", "loan_to_income_ratio")]
    assert quality.rows_with_nulls(t, must).isEmpty()
    modelled = features.settle(lending.model_set(t))
    quality.assert_same_count(t, modelled)
    train, validation = lending.training_and_validation(modelled, 20, 200, 60)
    quality.assert_same_count(lending.validation_sample(modelled, 20), validation)
    other = lending.training_sample(modelled, validation, 200, 60)
    assert train.select("loan_application_id").exceptAll(other.select("loan_application_id")).isEmpty()
    assert train.join(validation, "loan_application_id", "left_semi").isEmpty()
    numeric = ["loan_amount", "income", "prior_approval_rate"]
    model = modeling.train(train, "logistic", "loan_approved", numeric, [RACE], {"maxIter": 5})
    keep = ["loan_application_id", RACE, "applicant_age", F.col("loan_approved").alias("actual_value")]
    result = modeling.score(model, modelled, numeric, [RACE], keep)
    quality.assert_same_count(result, modelled)
