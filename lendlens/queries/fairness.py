from pyspark.sql import functions as F

from lendlens.operators import counterfactual, fairness
from lendlens.operators.ranks import top_k
from lendlens.plans import lending
from lendlens.queries.registry import query
from lendlens.queries.standin import GROUPS, LOANS, MINORITY, RACE, REFERENCE, UNKNOWN, loans, race_as
from lendlens.shared import settle

_CONFUSION = """count(*) FILTER (WHERE actual_value = 1 AND predicted_label = 1) AS tp,
  count(*) FILTER (WHERE actual_value = 0 AND predicted_label = 1) AS fp,
  count(*) FILTER (WHERE actual_value = 1 AND predicted_label = 0) AS fn,
  count(*) AS total, count(*) FILTER (WHERE actual_value = predicted_label) AS correct"""
_SCORES = "correct::DOUBLE / total AS accuracy, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1_score"


@query("confusion_overall", LOANS + f"SELECT *, {_SCORES} FROM (SELECT {_CONFUSION} FROM loans)")
def _(spark, sf):
    return fairness.confusion(loans(spark, sf))


@query(
    "confusion_by_year",
    LOANS + f"SELECT *, {_SCORES} FROM (SELECT activity_year, {_CONFUSION} FROM loans GROUP BY 1)",
)
def _(spark, sf):
    return fairness.confusion(loans(spark, sf), ["activity_year"])


_COUNTS = f"""counts AS (SELECT activity_year, {RACE}, count(*) AS n,
  count(*) FILTER (WHERE actual_value = 1) AS n_actual_pos,
  count(*) FILTER (WHERE predicted_label = 1) AS n_pred_pos,
  count(*) FILTER (WHERE actual_value = 1 AND predicted_label = 1) AS n_tp,
  count(*) FILTER (WHERE actual_value = 0 AND predicted_label = 1) AS n_fp,
  count(*) FILTER (WHERE actual_value = 0) AS n_actual_neg FROM loans GROUP BY ALL)"""
_RATES = """rates AS (SELECT *, n_actual_pos::DOUBLE / nullif(n, 0) AS actual_approval_rates,
  n_pred_pos::DOUBLE / nullif(n, 0) AS predicted_approval_rate,
  n_tp::DOUBLE / nullif(n_actual_pos, 0) AS true_positive_rate,
  n_fp::DOUBLE / nullif(n_actual_neg, 0) AS false_positive_rate,
  n_tp::DOUBLE / nullif(n_pred_pos, 0) AS precision_rate,
  (2 * n_tp)::DOUBLE / nullif(n_tp + n_fp + n_actual_pos, 0) AS f1_score,
  (2 * n_tp)::DOUBLE / nullif(2 * n_tp + n_fp, 0) AS f1_reference FROM counts)"""


def _wald(name, p, n):
    half = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / nullif({n}, 0)::DOUBLE)"
    return f"{p} - {half} AS {name}_ci_lower, {p} + {half} AS {name}_ci_upper"


_METRICS = f"""metrics AS (SELECT *, {_wald('dpd', 'predicted_approval_rate', 'n')},
  {_wald('eod', 'true_positive_rate', 'n_actual_pos')},
  {_wald('fpr', 'false_positive_rate', 'n_actual_neg')} FROM rates)"""
_FAIR = LOANS + f", {_COUNTS}, {_RATES}, {_METRICS} "


@query("fairness_counts", LOANS + f", {_COUNTS} SELECT * FROM counts")
def _(spark, sf):
    return fairness.group_counts(loans(spark, sf), ["activity_year", RACE])


def _metrics(spark, sf, **options):
    return fairness.fairness_metrics(fairness.group_counts(loans(spark, sf), ["activity_year", RACE]), **options)


@query("fairness_metrics", _FAIR + "SELECT * FROM metrics")
def _(spark, sf):
    return _metrics(spark, sf)


def _wilson(name, p, n):
    z = "1.96::DOUBLE"
    centre = f"({p} + 3.8416::DOUBLE / (2 * {n}::DOUBLE)) / (1 + 3.8416::DOUBLE / {n}::DOUBLE)"
    half = (
        f"{z} / (1 + 3.8416::DOUBLE / {n}::DOUBLE) * sqrt({p} * (1 - {p}) / {n}::DOUBLE"
        f" + 3.8416::DOUBLE / (4 * {n}::DOUBLE * {n}::DOUBLE))"
    )
    return f"round({centre} - {half}, 6) AS {name}_ci_lower, round({centre} + {half}, 6) AS {name}_ci_upper"


@query(
    "fairness_wilson",
    LOANS
    + f""", {_COUNTS}, {_RATES} SELECT activity_year, {RACE},
    {_wilson('dpd', 'predicted_approval_rate', 'nullif(n, 0)')},
    {_wilson('eod', 'true_positive_rate', 'nullif(n_actual_pos, 0)')} FROM rates""",
)
def _(spark, sf):
    m = _metrics(spark, sf, interval="wilson")
    cols = ["dpd_ci_lower", "dpd_ci_upper", "eod_ci_lower", "eod_ci_upper"]
    return m.select("activity_year", RACE, *[F.round(c, 6).alias(c) for c in cols])


@query(
    "fairness_gaps",
    _FAIR
    + f""", w AS (SELECT activity_year, actual_approval_rates AS wa, true_positive_rate AS white_tpr,
      false_positive_rate AS white_fpr, eod_ci_lower AS white_tpr_ci_lower, eod_ci_upper AS white_tpr_ci_upper,
      fpr_ci_lower AS white_fpr_ci_lower, fpr_ci_upper AS white_fpr_ci_upper
      FROM metrics WHERE {RACE} ILIKE 'building')
    SELECT m.*, white_tpr, white_fpr, white_tpr_ci_lower, white_tpr_ci_upper, white_fpr_ci_lower,
      white_fpr_ci_upper, actual_approval_rates - wa AS actual_gap, true_positive_rate - white_tpr AS tpr_gap,
      false_positive_rate - white_fpr AS fpr_gap,
      CASE WHEN eod_ci_upper < white_tpr_ci_lower OR eod_ci_lower > white_tpr_ci_upper THEN true ELSE false END
        AS is_tpr_gap_significant,
      CASE WHEN fpr_ci_upper < white_fpr_ci_lower OR fpr_ci_lower > white_fpr_ci_upper THEN true ELSE false END
        AS is_fpr_gap_significant
    FROM metrics m JOIN w USING (activity_year) WHERE {RACE} NOT LIKE 'HOUSEHOLD'""",
)
def fairness_gaps(spark, sf):
    return fairness.gap_vs_reference(_metrics(spark, sf), "activity_year", RACE, REFERENCE, UNKNOWN)


_SPREAD = "max({0}) - min({0})"


@query(
    "dpd_eod",
    _FAIR
    + f"""SELECT activity_year, {_SPREAD.format('predicted_approval_rate')} AS demographic_parity_difference,
    greatest({_SPREAD.format('true_positive_rate')}, {_SPREAD.format('false_positive_rate')})
      AS equalized_odds_difference,
    {_SPREAD.format('true_positive_rate')} AS equal_opportunity_difference FROM metrics GROUP BY 1""",
)
def _(spark, sf):
    return fairness.parity_differences(loans(spark, sf), RACE, ["activity_year"])


@query(
    "metric_frame",
    LOANS
    + f"""SELECT {RACE}, count(*) AS n,
    count(*) FILTER (WHERE actual_value = predicted_label)::DOUBLE / count(*) AS accuracy,
    count(*) FILTER (WHERE predicted_label = 1)::DOUBLE / count(*) AS selection_rate FROM loans GROUP BY 1""",
)
def _(spark, sf):
    return fairness.metric_frame(loans(spark, sf), RACE)


_BIN = "CAST(CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN {0} + 1 ELSE floor(score * {0}) + 1 END AS INTEGER)"


@query(
    "calibration",
    LOANS
    + f"""SELECT {RACE}, {_BIN.format(5)} AS score_bin, count(*) AS n, avg(score) AS avg_predicted_score,
    avg(actual_value) AS actual_approval_rate FROM loans GROUP BY 1, 2""",
)
def _(spark, sf):
    return fairness.calibration(loans(spark, sf))


@query(
    "score_histogram",
    LOANS
    + f"""SELECT {RACE}, activity_year, actual_value, {_BIN.format(10)} AS score_bin, count(*) AS n_in_bin,
    avg(score) AS avg_score FROM loans WHERE {RACE} NOT LIKE 'HOUSEHOLD' GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    known = loans(spark, sf).filter(F.col(RACE) != UNKNOWN)
    return fairness.score_histogram(known, [RACE, "activity_year", "actual_value"])


_TRACT = """, known AS (SELECT *, applicant_derived_racial_category AS race FROM loans
    WHERE applicant_derived_racial_category <> 'HOUSEHOLD'),
  agg AS (SELECT census_tract, race, max(county_code) AS county_code, count(*) AS total_apps,
    avg(score) AS avg_score, count(*) FILTER (WHERE actual_value = 1) AS actual_positives,
    count(*) FILTER (WHERE actual_value = 0) AS actual_denials,
    avg(CASE WHEN actual_value = 1 THEN score END) AS avg_score_given_positive,
    count(*) FILTER (WHERE score >= 0.5) AS predicted_positives FROM known GROUP BY 1, 2),
  w AS (SELECT census_tract, avg_score AS avg_score_white, avg_score_given_positive AS avg_score_pos_white
    FROM agg WHERE race = 'BUILDING'),
  m AS (SELECT a.*, avg_score_white, avg_score_pos_white,
    actual_positives::DOUBLE / nullif(total_apps, 0) AS actual_approval_rate,
    predicted_positives::DOUBLE / nullif(total_apps, 0) AS predicted_approval_rate,
    avg_score / nullif(avg_score_white, 0) AS score_dpd,
    avg_score_given_positive / nullif(avg_score_pos_white, 0) AS score_eod
    FROM agg a LEFT JOIN w USING (census_tract)),
  red AS (SELECT *, predicted_approval_rate - actual_approval_rate AS model_vs_actual_gap,
    CASE WHEN race <> 'BUILDING' AND (score_dpd < 0.8 OR score_eod < 0.8) THEN 1 ELSE 0 END AS is_possible_redlining,
    CASE WHEN race <> 'BUILDING' AND (score_dpd < 0.8 AND score_eod < 0.8) THEN 1 ELSE 0 END AS is_redlining
    FROM m)
"""


def _redlining(spark, sf):
    known = race_as(loans(spark, sf)).filter(F.col("race") != UNKNOWN)
    return fairness.redlining(fairness.tract_group_scores(known), reference=REFERENCE, minority=MINORITY)


@query("tract_group_scores", LOANS + _TRACT + "SELECT * FROM agg")
def _(spark, sf):
    return fairness.tract_group_scores(race_as(loans(spark, sf)).filter(F.col("race") != UNKNOWN))


@query("redlining", LOANS + _TRACT + "SELECT * FROM red")
def _(spark, sf):
    return _redlining(spark, sf)


@query(
    "redlining_top40",
    LOANS
    + _TRACT
    + """SELECT census_tract, race, total_apps, model_vs_actual_gap, score_dpd, score_eod FROM red
    WHERE total_apps >= 3 AND race <> 'BUILDING'
    ORDER BY model_vs_actual_gap DESC NULLS LAST, census_tract, race LIMIT 40""",
)
def _(spark, sf):
    cols = ["census_tract", "race", "total_apps", "model_vs_actual_gap", "score_dpd", "score_eod"]
    order = [F.desc_nulls_last("model_vs_actual_gap"), F.col("census_tract"), F.col("race")]
    wanted = (F.col("total_apps") >= 3) & F.col("race").isin(MINORITY)
    return top_k(_redlining(spark, sf).select(*cols), order, 40, wanted)


@query(
    "redlining_places",
    LOANS
    + _TRACT
    + """, zips AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS st, min(s_suppkey) AS k FROM supplier GROUP BY 1)
    SELECT red.census_tract, race, CAST(k AS VARCHAR) AS zip_code,
      n_name AS state_name, CAST(n_nationkey * 2 AS DOUBLE) AS latitude, CAST(n_regionkey AS DOUBLE) AS longitude
    FROM red LEFT JOIN zips ON substr(red.census_tract, 1, 2) = st
    LEFT JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = substr(red.census_tract, 1, 2)""",
)
def _(spark, sf):
    from lendlens.queries.standin import digits, table

    df = _redlining(spark, sf)
    nation = table(spark, sf, "nation").withColumn("fips", digits(F.col("n_nationkey"), 2))
    tracts = settle(df.select("census_tract").distinct())
    state = F.substring("census_tract", 1, 2)
    lowest = table(spark, sf, "supplier").groupBy(digits(F.col("s_nationkey"), 2).alias("__st")).agg(F.min("s_suppkey").alias("k"))
    zips = tracts.join(lowest, state == F.col("__st")).select(
        "census_tract", F.col("k").cast("string").alias("zip_code"), F.lit(None).cast("string").alias("state_name")
    )
    centroids = tracts.join(nation, state == F.col("fips")).select(
        F.col("census_tract").alias("tract_fips"),
        (F.col("n_nationkey") * 2).cast("double").alias("centroid_lat"),
        F.col("n_regionkey").cast("double").alias("centroid_lon"),
    )
    states = nation.select("fips", F.col("n_name").alias("usps"))
    return fairness.attach_places(df, zips, states, centroids).select(
        "census_tract", "race", "zip_code", "state_name", "latitude", "longitude"
    )


_AUC = """(SELECT {keys} sum(pos * (2 * (cum - neg) + neg))::DOUBLE / ((2 * sum(pos))::DOUBLE * sum(neg)::DOUBLE) AS auc_roc
  FROM (SELECT *, sum(neg) OVER ({part} ORDER BY score) AS cum FROM
    (SELECT {keys} score, sum(actual_value) AS pos, sum(1 - actual_value) AS neg FROM loans GROUP BY {keys} score)) {group})"""
_AUC_ALL = _AUC.format(keys="", part="", group="")
_AUC_YEAR = _AUC.format(keys="activity_year,", part="PARTITION BY activity_year", group="GROUP BY activity_year")


@query("auc_overall", LOANS + f"SELECT * FROM {_AUC_ALL}")
def _(spark, sf):
    return fairness.auc(loans(spark, sf))


@query(
    "auc_by_year",
    LOANS + f"SELECT * FROM {_AUC_YEAR} UNION ALL SELECT CAST(NULL AS INTEGER), auc_roc FROM {_AUC_ALL}",
)
def _(spark, sf):
    return fairness.auc_report(loans(spark, sf))


@query(
    "model_scores_by_year",
    LOANS
    + f"""SELECT activity_year, accuracy, f1_score, auc_roc FROM (SELECT *, {_SCORES} FROM
      (SELECT activity_year, {_CONFUSION} FROM loans GROUP BY 1)) JOIN {_AUC_YEAR} USING (activity_year)""",
)
def _(spark, sf):
    df = loans(spark, sf)
    return fairness.model_scores(df, fairness.auc_report(df), "activity_year")


@query(
    "model_scores_overall",
    LOANS + f"SELECT *, (SELECT auc_roc FROM {_AUC_ALL}) AS auc_roc FROM (SELECT {_SCORES} FROM (SELECT {_CONFUSION} FROM loans))",
)
def _(spark, sf):
    df = loans(spark, sf)
    return fairness.model_scores(df, settle(fairness.auc_report(df)))


_PR = """, s AS (SELECT score, sum(actual_value) AS pos, sum(1 - actual_value) AS neg FROM loans GROUP BY 1),
  c AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p FROM s)"""


@query(
    "pr_curve",
    LOANS + _PR + """ SELECT score AS threshold, tp::DOUBLE / (tp + fp)::DOUBLE AS precision,
      tp::DOUBLE / p::DOUBLE AS recall FROM c""",
)
def _(spark, sf):
    return fairness.pr_curve(loans(spark, sf)).drop("recall_step")


@query(
    "average_precision",
    LOANS + _PR + """ SELECT round(sum((pos::DOUBLE / p::DOUBLE) * (tp::DOUBLE / (tp + fp)::DOUBLE)), 9)
      AS average_precision FROM c""",
)
def _(spark, sf):
    return fairness.average_precision(loans(spark, sf)).select(F.round("average_precision", 9).alias("average_precision"))


@query(
    "classification_report",
    LOANS
    + """SELECT label, hit::DOUBLE / nullif(pred, 0) AS precision, hit::DOUBLE / nullif(support, 0) AS recall,
      (2 * hit)::DOUBLE / nullif(pred + support, 0) AS f1_score, support
    FROM (SELECT v AS label, count(*) FILTER (WHERE actual_value = v AND predicted_label = v) AS hit,
      count(*) FILTER (WHERE predicted_label = v) AS pred, count(*) FILTER (WHERE actual_value = v) AS support
      FROM loans, (VALUES (0), (1)) t(v) GROUP BY v)""",
)
def _(spark, sf):
    return fairness.classification_report(loans(spark, sf))


@query(
    "score_cdf",
    LOANS
    + f"""SELECT {RACE}, score, n, CAST(sum(n) OVER w AS BIGINT) AS total,
      CAST(sum(n) OVER w AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {RACE}) AS DOUBLE) AS percentile
    FROM (SELECT {RACE}, score, count(*) AS n FROM loans GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY {RACE} ORDER BY score)""",
)
def _(spark, sf):
    return fairness.score_cdf(loans(spark, sf), RACE)


# a stand-in for rescoring: the new group's index nudges the score by a multiple of 1/64
_CF = f""", near AS (SELECT *, lender_entity_name || '_' || {RACE} AS race_state_interaction FROM loans
    WHERE score BETWEEN 0.4 AND 0.6 AND predicted_label = 0 AND {RACE} <> 'HOUSEHOLD'),
  cf AS (SELECT loan_application_id, census_tract, county_code, {RACE} AS original_race, g AS new_race,
    replace(race_state_interaction, {RACE}, g) AS race_state_interaction, score AS previous_score,
    score + CAST(strpos('ABFHM', substr(g, 1, 1)) AS DOUBLE) / 64 AS counterfactual_score
    FROM near, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS g)
    WHERE g <> {RACE}),
  res AS (SELECT *, counterfactual_score - previous_score AS score_change FROM cf)
"""


def _near(spark, sf):
    df = loans(spark, sf).filter(F.col(RACE) != UNKNOWN)
    near = counterfactual.near_threshold(df)
    return near.withColumn("race_state_interaction", F.concat_ws("_", "lender_entity_name", RACE))


def _nudge(df):
    step = F.instr(F.lit("ABFHM"), F.substring(RACE, 1, 1)).cast("double") / 64
    return df.withColumn("score", F.col("previous_score") + step)


def _results(spark, sf):
    return counterfactual.counterfactual(_near(spark, sf), _nudge, GROUPS)


@query(
    "counterfactual_pairs",
    LOANS + _CF + """SELECT loan_application_id, original_race, new_race, previous_score, counterfactual_score,
      score_change FROM res""",
)
def _(spark, sf):
    return _results(spark, sf)


@query("counterfactual_labels", LOANS + _CF + "SELECT loan_application_id, new_race, race_state_interaction FROM res")
def _(spark, sf):
    flipped = counterfactual.flip_groups(_near(spark, sf), GROUPS)
    return flipped.select("loan_application_id", "new_race", "race_state_interaction")


@query(
    "flip_rate",
    LOANS + _CF + """SELECT original_race, new_race,
      count(*) FILTER (WHERE (previous_score >= 0.5) <> (counterfactual_score >= 0.5)) AS flips, count(*) AS n,
      count(*) FILTER (WHERE (previous_score >= 0.5) <> (counterfactual_score >= 0.5))::DOUBLE / count(*) AS flip_rate
    FROM res GROUP BY 1, 2""",
)
def _(spark, sf):
    return fairness.flip_rate(_results(spark, sf))


_MATRIX = ", ".join(f"avg(score_change) FILTER (WHERE new_race = '{g}') AS \"{g}\"" for g in GROUPS)


@query("flip_matrix", LOANS + _CF + f"SELECT original_race, {_MATRIX} FROM res GROUP BY 1")
def _(spark, sf):
    return fairness.pivot_mean(_results(spark, sf), GROUPS)


@query("mean_change_by_group", LOANS + _CF + "SELECT new_race, avg(score_change) AS avg_score_change FROM res GROUP BY 1")
def _(spark, sf):
    return fairness.mean_change(_results(spark, sf))


@query(
    "counterfactual_by_tract",
    LOANS + _CF + """SELECT census_tract, original_race, new_race, max(county_code) AS county_code,
      count(*) AS total_apps, avg(previous_score) AS avg_prev_score,
      avg(counterfactual_score) AS avg_counterfactual_score, avg(score_change) AS avg_score_change
    FROM res GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    places = loans(spark, sf).select("loan_application_id", "census_tract", "county_code")
    return fairness.counterfactual_by_tract(_results(spark, sf).join(places, "loan_application_id"))


@query(
    "counterfactual_audit",
    LOANS + _CF + """, centroids AS (SELECT DISTINCT census_tract AS tract, CAST(state_code AS DOUBLE) * 2.5 AS latitude,
      100 - CAST(substr(census_tract, 6) AS DOUBLE) AS longitude FROM loans WHERE county_code <> '002'),
    means AS (SELECT census_tract, original_race, new_race, max(county_code) AS county_code, count(*) AS total_apps,
      avg(previous_score) AS avg_prev_score, avg(counterfactual_score) AS avg_counterfactual_score, avg(score_change) AS avg_score_change
      FROM res GROUP BY 1, 2, 3)
    SELECT means.*, latitude, longitude FROM means LEFT JOIN centroids ON tract = census_tract""",
)
def _(spark, sf):
    """Tracts of one county in three have no centroid and keep their rows."""
    df = loans(spark, sf)
    centroids = df.filter("county_code <> '002'").select(
        F.col("census_tract").alias("tract_fips"),
        (F.col("state_code").cast("double") * 2.5).alias("centroid_lat"),
        (100 - F.substring("census_tract", 6, 6).cast("double")).alias("centroid_lon"),
    )
    return lending.counterfactual_audit(_results(spark, sf), df, settle(centroids.distinct()))


@query(
    "class_weights",
    LOANS + f"""SELECT {RACE}, n, (sum(n) OVER ())::DOUBLE / (n * count(*) OVER ())::DOUBLE AS weight
      FROM (SELECT {RACE}, count(*) AS n FROM loans GROUP BY 1)""",
)
def _(spark, sf):
    return fairness.class_weights(loans(spark, sf), RACE)


@query(
    "mean_abs",
    LOANS + """SELECT unnest(['income', 'loan_amount']) AS feature,
      unnest([(SELECT avg(abs(income)) FROM loans), (SELECT avg(abs(loan_amount)) FROM loans)]) AS mean_abs""",
)
def _(spark, sf):
    return fairness.mean_abs(loans(spark, sf), ["income", "loan_amount"])
