"""Column expressions on the spellings and codes that occur in landed files."""

import pytest
from pyspark.sql import functions as F

from lendlens.operators import quality
from lendlens.functions import lending as L, numbers as N, text as X


def apply(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_to_whole_rounds_like_the_warehouse(spark):
    got = apply(spark, ["1.5", "105000.0", "Na", None, "-5", " 7 "], X.to_whole)
    assert got == [2, 105000, None, None, -5, 7]


def test_to_whole_keeps_64_bits(spark):
    assert apply(spark, ["99999999999", "12"], X.to_whole) == [99999999999, 12]


def test_whole_code_of_not_a_number(spark):
    assert apply(spark, ["nan", "inf", "7.0", "x", None], lambda c: X.whole_code(c, 3)) == [None, None, "007", None, None]


def test_pad_code_cuts_the_fraction(spark):
    got = apply(spark, ["37057061600.0", "7057061600", "Na", None], lambda c: X.pad_code(c, 11))
    assert got == ["37057061600", "07057061600", "000000000Na", None]


def test_tract_text(spark):
    assert apply(spark, ["37057061600.0", "55079000101", "x"], X.tract_text) == ["37057061600", "55079000101", None]


def test_null_tokens_match_whole_values_only(spark):
    got = apply(spark, [" N/A ", "Nashville", "", "a.b", "UNKNOWN", "-"], X.clean_text)
    assert got == [None, "nashville", None, "a.b", None, None]


def test_clean_number(spark):
    got = apply(spark, [" 4.5 ", "Exempt", "x", "-3", None], lambda c: X.clean_number(c, allow_negative=False))
    assert got == [4.5, None, None, None, None]


def test_split_part(spark):
    assert apply(spark, ["zipcode:United States:53151", "none"], lambda c: X.part(c, ":", 3)) == ["53151", ""]
    assert apply(spark, ["Wisconsin, Milwaukee"], lambda c: X.part(c, ",", 2)) == [" Milwaukee"]


def test_dti(spark):
    texts = ["<20%", "30%-<36%", "41", "50%-60%", ">60%", "Exempt", None]
    assert apply(spark, texts, L.dti_number) == [20, 30, 41, 50, 60, None, None]
    got = apply(spark, ["19", "20", "36", "49", "60", "61", "50%-60%", "Exempt", "nan"], L.dti_band)
    assert got == ["<20%", "20%-<30%", "36%-<40%", "46%-<50%", "50%-60%", ">60%", "50%-60%", None, None]
    bins = apply(spark, [-1.0, 0.0, 30.0, 49.9, 50.0, 99.9, 100.0, None], L.dti_bin, "double")
    assert bins == [None, "Low", "Medium", "High", "Very High", "Very High", None, None]


def test_units(spark):
    assert apply(spark, ["1", "4", "5", "5-24", None], L.units_bucket) == ["1", "4", "5+", "5+", "Unknown"]


# one row per branch: ethnicity label, race label, group
GROUPS = [
    (None, "Black", "Black"),
    ("not applicable", "not provided", None),
    ("not applicable", "White", "White"),
    ("information not provided", "AAPI", "AAPI"),
    ("Not hispanic or latinx", "White", "White"),
    ("no co applicant", "Black", "Black"),
    ("information not provided", "not applicable", None),
    (None, None, None),
    ("Not hispanic or latinx", None, None),
    ("Latinx", "White", "Latinx"),
    ("Latinx", None, "Latinx"),
    ("something else", "White", "not a match"),
    ("no co applicant", "not provided", "not a match"),
]


@pytest.mark.parametrize("ethnicity,race,want", GROUPS)
def test_derived_race(spark, ethnicity, race, want):
    df = spark.createDataFrame([(ethnicity, race)], "e string, r string")
    assert df.select(L.derived_race(F.col("e"), F.col("r"))).collect()[0][0] == want


def test_winsorise_and_log(spark):
    got = apply(spark, [None, -5.0, 3.0, 99.0], lambda c: N.winsorise(c, F.lit(0.0), F.lit(10.0)), "double")
    assert got == [0.0, 0.0, 3.0, 10.0]
    assert apply(spark, [None, -2.0, -1.0, 0.0], N.safe_log1p, "double") == [0.0, 0.0, 0.0, 0.0]


def test_ratio_and_share_guard_zero(spark):
    assert apply(spark, [0, 4], lambda c: N.ratio(F.lit(1), c), "int") == [None, 0.25]
    assert apply(spark, [0, 3], lambda c: N.share_pct(F.lit(1), c), "int") == [None, 33.33]


def test_equal_bin_edges(spark):
    assert apply(spark, [-0.1, 0.0, 0.5, 0.99, 1.0], lambda c: N.equal_bin(c, 0, 1, 5), "double") == [0, 1, 3, 5, 6]


def test_calendar_years_are_not_elapsed_years(spark):
    day = lambda s: F.lit(s).cast("date")
    assert spark.range(1).select(N.calendar_years(day("2020-12-31"), day("2021-01-01"))).collect()[0][0] == 1


def test_distress_layouts(spark):
    old = spark.createDataFrame([("X", None, None, None), (None, None, None, "X")], "poverty string, unemployment string, population_loss string, remote_rural string")
    a, b = L.distress_flags(old.columns)
    assert [tuple(r) for r in old.select(a, b).collect()] == [(1, 0), (0, 1)]
    new = spark.createDataFrame([("x", None), (None, "X")], "distressed string, under_served string")
    a, b = L.distress_flags(new.columns)
    assert [tuple(r) for r in new.select(a, b).collect()] == [(1, 0), (0, 1)]


def test_white_non_hispanic_uses_code_two(spark):
    df = spark.createDataFrame([(5, 2), (5, 1), (3, 2), (None, 2)], "r int, e int")
    assert [r[0] for r in df.select(L.white_non_hispanic(F.col("r"), F.col("e"))).collect()] == [True, False, False, False]


def test_surrogate_key_treats_missing_as_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    keys = {r[0] for r in df.select(X.surrogate_key(["x", "y"])).collect()}
    assert len(keys) == 1


def test_equal_tables_join_nothing_and_a_change_joins_one_bucket(spark):
    a = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS x", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'v' END AS y")
    assert quality.differing_buckets(a, a.repartition(7), "id", ["x", "y"]).collect() == []
    assert quality.diff_tables(a, a.orderBy("x"), "id").collect() == []
    b = a.selectExpr("id", "CASE WHEN id = 42 THEN 1 ELSE x END AS x", "y")
    assert len(quality.differing_buckets(a, b, "id", ["x", "y"]).collect()) == 1
    assert [(r.id, r.status, r.changed_columns) for r in quality.diff_tables(a, b, "id").collect()] == [(42, "changed", "x")]
    # a null that moves to another column is a difference, and so is a repeated row
    one, other = (spark.createDataFrame([r], "id long, x string, y string") for r in ((1, None, "v"), (1, "v", None)))
    assert len(quality.differing_buckets(one, other, "id", ["x", "y"]).collect()) == 1
    assert len(quality.differing_buckets(one, one.union(one).union(one), "id", ["x", "y"]).collect()) == 1


def test_mode_imputer_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from lendlens.operators.imputing import ModeImputer

    df = spark.createDataFrame([(1, "b", None, 1.5), (2, "a", None, None), (None, None, None, 1.5), (2, "a", None, 2.0), (1, "b", None, None)], "n int, s string, e string, d double")
    model = Pipeline(stages=[ModeImputer(inputCols=["n", "s", "e", "d"])]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[0].modes() == {"n": "1", "s": "a", "e": None, "d": "1.5"}
    out = again.transform(df)
    assert out.dtypes == df.dtypes
    assert [tuple(r) for r in out.collect()][2] == (1, "a", None, 1.5)
    assert ModeImputer(inputCols=["n"]).fit(df.limit(0)).transform(df).collect() == df.collect()


def test_mode_imputer_in_a_model(spark):
    from lendlens.operators.modeling import build_pipeline

    df = spark.range(60).selectExpr("CAST(id AS double) AS x", "CASE WHEN id % 4 > 0 THEN 'a' WHEN id % 8 = 0 THEN 'b' END AS c", "CAST(id > 30 AS int) AS y")
    model = build_pipeline("logistic", "y", ["x"], ["c"], {"maxIter": 5}, fill_modes=True).fit(df)
    assert model.stages[0].modes() == {"c": "a"}
    assert model.transform(df).filter("c IS NULL").isEmpty()
