"""Model queries. Fitted numbers have no SQL twin; what SQL can state of them is compared instead."""

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lendlens.operators import counterfactual, fairness, imputing, minibatch, modeling, sampling
from lendlens.queries.registry import query
from lendlens.queries.standin import GROUPS, LOANS, RACE, SPAN, loans, order_key, table
from lendlens.shared import settle

ID = "loan_application_id"
NUMERIC = ["loan_amount", "income", "property_value", "median_household_income"]
CATEGORICAL = [RACE, "debt_to_income_ratio", "applicant_sex_category"]


def _fit(df, kind, **params):
    return modeling.train(df, kind, "loan_approved", NUMERIC, CATEGORICAL, params)


_SCORED_SQL = LOANS + f"""SELECT {RACE}, count(*) AS n, CAST(sum(actual_value) AS BIGINT) AS approvals, true AS in_range,
    true AS labelled, true AS informed FROM loans GROUP BY 1"""


def _facts(scored):
    """Per group: rows and approvals carried through, scores in [0, 1], labels at a half; scores that tell approvals apart."""
    s = F.col("score")
    informed = fairness.auc(settle(scored)).select(F.col("auc_roc") > 0.5).scalar()
    facts = scored.groupBy(RACE).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("actual_value").cast("bigint").alias("approvals"),
        F.bool_and((s >= 0) & (s <= 1)).alias("in_range"),
        F.bool_and(F.col("predicted_label") == (s > 0.5).cast("int")).alias("labelled"),
    )
    return facts.withColumn("informed", informed)


@query("logit_score", _SCORED_SQL)
def _(spark, sf):
    df = loans(spark, sf)
    model = modeling.train(df, "logistic", "loan_approved", NUMERIC, CATEGORICAL, {"maxIter": 20}, balanced=True)
    return _facts(modeling.score(model, df, NUMERIC, CATEGORICAL, [ID, RACE, "actual_value"]))


@query("gbt_score", _SCORED_SQL)
def _(spark, sf):
    df = loans(spark, sf)
    return _facts(modeling.score(_fit(df, "boosted_trees", maxIter=5, maxDepth=3), df, NUMERIC, CATEGORICAL, [ID, RACE, "actual_value"]))


@query("forest_evaluation", LOANS + "SELECT count(*) AS n, true AS same_auc, true AS same_accuracy FROM loans")
def _(spark, sf):
    df = loans(spark, sf)
    scored = settle(modeling.score(_fit(df, "random_forest", numTrees=10, maxDepth=4), df, NUMERIC, CATEGORICAL, [ID, "actual_value"]))
    found = settle(modeling.evaluate(scored))
    # Spark ML's own curve over every distinct score
    ranked = scored.select("score", F.col("actual_value").cast("double").alias("label"))
    other = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(ranked)
    hits = scored.agg(F.avg((F.col("actual_value") == F.col("predicted_label")).cast("double"))).scalar()
    return found.select(
        F.lit(scored.count()).cast("bigint").alias("n"),
        (F.abs(F.col("auc") - other) < 1e-9).alias("same_auc"),
        (F.abs(F.col("accuracy") - hits) < 1e-9).alias("same_accuracy"),
    )


@query("tree_importances", f"SELECT {len(NUMERIC) + len(CATEGORICAL)}::BIGINT AS n_features, true AS positive, true AS whole")
def _(spark, sf):
    df = loans(spark, sf)
    found = modeling.importances(_fit(df, "decision_tree", maxDepth=4), df, NUMERIC, CATEGORICAL)
    return found.agg(
        F.count_distinct("feature").alias("n_features"),
        F.bool_and(F.col("importance") >= 0).alias("positive"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("whole"),
    )


@query(
    "tree_importances_by_gain",
    LOANS
    + f"""-- impurity falls of a tree of depth two over two flags; leaves that say the same are one
    , cells AS (SELECT {RACE} = 'FURNITURE' AS f, predicted_label = 1 AS s, count(*) AS n, sum(actual_value) AS p FROM loans GROUP BY 1, 2),
    trees AS (SELECT 'furniture' AS root, 'high_score' AS other, f AS side, n, p FROM cells
      UNION ALL SELECT 'high_score', 'furniture', s, n, p FROM cells),
    sides AS (SELECT root, other, side, sum(n) AS n, sum(p) AS p, sum(2 * p * (n - p) / n::DOUBLE) AS below,
      count(DISTINCT 2 * p > n) > 1 AS apart FROM trees GROUP BY 1, 2, 3),
    falls AS (SELECT root, other, 2 * sum(p) * (sum(n) - sum(p)) / sum(n)::DOUBLE - sum(2 * p * (n - p) / n::DOUBLE) AS first_fall,
      sum(CASE WHEN apart THEN 2 * p * (n - p) / n::DOUBLE - below ELSE 0 END) AS next_fall FROM sides GROUP BY 1, 2),
    best AS (SELECT *, first_fall + next_fall AS whole FROM falls ORDER BY first_fall DESC LIMIT 1)
    SELECT unnest([root, other]) AS feature, round(unnest([first_fall / whole, next_fall / whole]), 9) AS importance FROM best""",
)
def _(spark, sf):
    flags = ["furniture", "high_score"]
    df = loans(spark, sf).withColumns(
        {"furniture": (F.col(RACE) == "FURNITURE").cast("int"), "high_score": (F.col("predicted_label") == 1).cast("int")}
    )
    model = modeling.train(df, "decision_tree", "loan_approved", flags, (), {"maxDepth": 2})
    return modeling.importances(model, df, flags).withColumn("importance", F.round("importance", 9))


_SETTINGS = [0.0, 0.1]
_HOLD_OUT = 0.8
_KEY_SQL = f"((loan_application_id * 7919) % {SPAN})"
#: rows and approvals of every held-out part, once per setting, and the rows left for training
_TUNED_SQL = (
    LOANS
    + """, parts AS (SELECT {part} AS fold, count(*) AS n, CAST(sum(actual_value) AS BIGINT) AS approvals FROM loans GROUP BY 1)
    SELECT setting, fold, n, (SELECT count(*) FROM loans) - n AS n_train, approvals, true AS same_auc, true AS informed, true AS mean_adds_up
    FROM parts, (SELECT unnest([0.0, 0.1])::DOUBLE AS setting) WHERE fold >= 0"""
)


def _tuned(spark, sf, **how):
    """Every area is computed again by the library's evaluator from the kept scores."""
    df = loans(spark, sf)
    found = modeling.tune(df, "logistic", "loan_approved", NUMERIC, CATEGORICAL, {"regParam": _SETTINGS}, ID, key=order_key(), span=SPAN, **how)
    scored = settle(found.scored.withColumn("label", F.col("actual_value").cast("double")))
    other = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    pairs = found.folds.select("fold", "setting").collect()  # a row per fold and setting
    again = [(r.fold, r.setting, other.evaluate(scored.filter((F.col("fold") == r.fold) & (F.col("setting") == r.setting)))) for r in pairs]
    facts = scored.groupBy("fold", "setting").agg(F.count_distinct(ID).alias("n"), F.sum("actual_value").cast("bigint").alias("approvals"))
    facts = facts.join(found.folds, ["fold", "setting"]).join(spark.createDataFrame(again, "fold int, setting int, other double"), ["fold", "setting"])
    means = facts.groupBy("setting").agg(F.avg("other").alias("mean")).join(found.settings.withColumnRenamed("auc", "reported"), "setting")
    return facts.join(means, "setting").select(
        F.regexp_extract("params", r"regParam=([0-9.]+)", 1).cast("double").alias("setting"),
        "fold",
        "n",
        (F.lit(df.count()) - F.col("n")).alias("n_train"),
        "approvals",
        (F.abs(F.col("auc") - F.col("other")) < 1e-9).alias("same_auc"),
        (F.col("auc") > 0.5).alias("informed"),
        (F.abs(F.col("mean") - F.col("reported")) < 1e-9).alias("mean_adds_up"),
    )


@query("tuned_logit", _TUNED_SQL.format(part=f"CASE WHEN {_KEY_SQL} >= {int(_HOLD_OUT * SPAN)} THEN 0 ELSE -1 END"))
def _(spark, sf):
    return _tuned(spark, sf, train_ratio=_HOLD_OUT)


@query("tuned_logit_folds", _TUNED_SQL.format(part=f"CAST({_KEY_SQL} * 3 // {SPAN} AS INTEGER)"))
def _(spark, sf):
    return _tuned(spark, sf, folds=3)


_BATCH = 4000
_RATE, _DECAY, _PENALTY = 0.5, 0.05, 0.01


@query(
    "minibatch_logit",
    f"""{LOANS.replace("WITH base", "WITH RECURSIVE base", 1)}, ranked AS (SELECT *,
      row_number() OVER (PARTITION BY loan_approved ORDER BY {_KEY_SQL}, loan_application_id) AS within FROM loans),
    rows AS (SELECT (row_number() OVER (ORDER BY within, loan_approved) - 1) // {_BATCH} AS chunk, loan_approved::DOUBLE AS y,
      loan_amount::DOUBLE / 262144 AS a, income::DOUBLE / 8192 AS b, score - 0.5::DOUBLE AS c,
      count(*) OVER ()::DOUBLE / ((SELECT count(DISTINCT loan_approved) FROM loans) * count(*) OVER (PARTITION BY loan_approved)) AS w FROM ranked),
    walk AS (
      SELECT 0::BIGINT AS step, 0::BIGINT AS n, 0::DOUBLE AS loss, 0::DOUBLE AS bias, 0::DOUBLE AS wa, 0::DOUBLE AS wb, 0::DOUBLE AS wc
      UNION ALL
      SELECT step + 1, n, loss, bias - size * pull, wa - size * (ga + {_PENALTY}::DOUBLE * wa), wb - size * (gb + {_PENALTY}::DOUBLE * wb),
        wc - size * (gc + {_PENALTY}::DOUBLE * wc) FROM (
        SELECT any_value(step) AS step, count(*) AS n, any_value(bias) AS bias, any_value(wa) AS wa, any_value(wb) AS wb, any_value(wc) AS wc,
          any_value({_RATE}::DOUBLE / (1 + {_DECAY}::DOUBLE * step)) AS size, sum(w * (p - y)) / sum(w) AS pull, sum(w * (p - y) * a) / sum(w) AS ga,
          sum(w * (p - y) * b) / sum(w) AS gb, sum(w * (p - y) * c) / sum(w) AS gc,
          sum(-w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w) AS loss
        FROM (SELECT s.*, r.a, r.b, r.c, r.y, r.w, 1 / (1 + exp(-(bias + wa * a + wb * b + wc * c))) AS p
          FROM walk s JOIN rows r ON r.chunk = s.step) GROUP BY step))
    SELECT step, n, round(loss, 6) AS loss, round(bias, 6) AS bias, round(wa, 6) AS w_amount, round(wb, 6) AS w_income,
      round(wc, 6) AS w_score FROM walk WHERE step > 0""",
)
def _(spark, sf):
    """All loans once, in chunks of alternating classes; the weights after every chunk."""
    x = F.array(F.col("loan_amount") / 262144, F.col("income") / 8192, F.col("score") - 0.5)
    rows = loans(spark, sf).select(ID, "loan_approved", x.alias("x"))
    dealt = sampling.interleave(rows, "loan_approved", _BATCH, ID, key=order_key(), span=SPAN)
    step = minibatch.Step(_RATE, _DECAY, _PENALTY)
    taken = minibatch.train(dealt, "chunk_number", "x", "loan_approved", 3, step)[1]
    at = lambda c, name: F.round(c, 6).alias(name)
    w = F.col("weights")
    return taken.select("step", "n", at(F.col("loss"), "loss"), at(F.col("bias"), "bias"), at(w[0], "w_amount"), at(w[1], "w_income"), at(w[2], "w_score"))


@query(
    "model_counterfactuals",
    f"""SELECT unnest({GROUPS}) AS original_race, true AS any_near, true AS all_tried, true AS group_changed, true AS change_adds_up""",
)
def _(spark, sf):
    df = loans(spark, sf)
    features = [RACE, "debt_to_income_ratio"]
    model = modeling.train(df, "logistic", "loan_approved", NUMERIC, features, {"maxIter": 20})
    # the stand-in's unknown group counts as a group here, every other group is tried for each row
    keep = [ID, *NUMERIC, *features]
    scored = modeling.score(model, df, NUMERIC, features, keep)
    near = settle(counterfactual.near_threshold(scored))
    rescore = lambda d: modeling.score(
        model, d, NUMERIC, features, [ID, "original_race", "new_race", "previous_score"]
    )
    pairs = settle(counterfactual.counterfactual(near, rescore, GROUPS))
    # a group without rows near the threshold has no pairs; any other has a pair per row and other group
    groups = spark.createDataFrame([(g,) for g in GROUPS], "original_race string")
    expected = near.groupBy(F.col(RACE).alias("original_race")).agg((F.count(F.lit(1)) * (len(GROUPS) - 1)).alias("wanted"))
    change = F.col("counterfactual_score") - F.col("previous_score")
    facts = pairs.groupBy("original_race").agg(
        F.count_distinct(ID, "new_race").alias("found"),
        F.count_if(F.col("original_race") != F.col("new_race")).alias("changed"),
        F.count_if(F.abs(F.col("score_change") - change) < 1e-12).alias("adding"),
    )
    counts = groups.join(expected, "original_race", "left").join(facts, "original_race", "left").fillna(0)
    return counts.select(
        "original_race",
        F.lit(near.count() > 0).alias("any_near"),
        (F.col("found") == F.col("wanted")).alias("all_tried"),
        (F.col("changed") == F.col("wanted")).alias("group_changed"),
        (F.col("adding") == F.col("wanted")).alias("change_adds_up"),
    )


@query(
    "linear_contributions",
    LOANS
    + """, m AS (SELECT avg(income) AS a, avg(loan_amount) AS b FROM loans)
    SELECT loan_application_id, 0.5::DOUBLE * (income - a) AS contribution_income,
      -0.25::DOUBLE * (loan_amount - b) AS contribution_loan_amount FROM loans, m""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "income", "loan_amount")
    return modeling.linear_contributions(df, {"income": 0.5, "loan_amount": -0.25}).drop("income", "loan_amount")


@query(
    "contribution_ranking",
    LOANS
    + """, m AS (SELECT avg(income) AS a, avg(loan_amount) AS b FROM loans),
    s AS (SELECT avg(abs(0.5::DOUBLE * (income - a))) AS x, avg(abs(-0.25::DOUBLE * (loan_amount - b))) AS y FROM loans, m)
    SELECT 'contribution_income' AS feature, round(x, 6) AS mean_abs FROM s
    UNION ALL SELECT 'contribution_loan_amount', round(y, 6) FROM s""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "income", "loan_amount")
    names = ["contribution_income", "contribution_loan_amount"]
    ranked = fairness.mean_abs(modeling.linear_contributions(df, {"income": 0.5, "loan_amount": -0.25}), names)
    return ranked.select("feature", F.round("mean_abs", 6).alias("mean_abs"))


@query(
    "mode_imputation",
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 > 0 THEN l_returnflag END AS flag,
        CASE WHEN l_orderkey % 4 > 0 THEN CAST(l_quantity AS BIGINT) % 3 END AS pieces FROM lineitem),
      s AS (SELECT flag AS v FROM r WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
      p AS (SELECT pieces AS v FROM r WHERE pieces IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, CAST(pieces AS VARCHAR) LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(flag, (SELECT v FROM s)) AS flag, coalesce(pieces, (SELECT v FROM p)) AS pieces,
      CAST(NULL AS VARCHAR) AS nothing, 'b' AS tied FROM r""",
)
def _(spark, sf):
    """The tied column has two values equally often, the empty one none at all."""
    key = F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 3 > 0, F.col("l_returnflag")).alias("flag"),
        F.when(key % 4 > 0, F.col("l_quantity").cast("bigint") % 3).alias("pieces"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit(None).cast("string").alias("tied"),
    )
    columns = ["flag", "pieces", "nothing", "tied"]
    # both values of the tied column are seen once per row
    seen = rows.withColumn("tied", F.explode(F.array(F.lit("c"), F.lit("b"))))
    return imputing.ModeImputer(inputCols=columns).fit(seen).transform(rows)
