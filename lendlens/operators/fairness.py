"""Model quality and fairness metrics from scored applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lendlens.functions.lending import BAD_TRACTS, MINORITY_GROUPS, REFERENCE_GROUP, UNKNOWN_GROUP
from lendlens.functions.numbers import equal_bin, ratio, wald_interval, wilson_interval
from lendlens.operators.ranks import bucket_totals, match_on, value_bucket
from lendlens.operators.rates import RACE
from lendlens.shared import settle



def confusion(
    df: DataFrame, keys: Sequence[str] = (), actual: str = "actual_value", predicted: str = "predicted_label"
) -> DataFrame:
    """Confusion counts, accuracy and F1, overall or per key."""
    a, p = F.col(actual), F.col(predicted)
    counts = df.groupBy(*keys).agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(a == p).alias("correct"),
    )
    two_tp = F.col("tp") * 2
    return counts.select(
        "*",
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        ratio(two_tp, two_tp + F.col("fp") + F.col("fn")).alias("f1_score"),
    )


def model_scores(
    df: DataFrame, auc_table: DataFrame, period: str | None = None, actual="actual_value", predicted="predicted_label"
) -> DataFrame:
    """Accuracy, F1 and the stored AUC: per period, or overall from the row with a null period."""
    if period:
        scores = confusion(df, [period], actual, predicted).select(period, "accuracy", "f1_score")
        return scores.join(auc_table.select(F.col("activity_year").alias(period), "auc_roc"), period)
    overall = auc_table.filter("activity_year is null").select(F.max("auc_roc")).scalar()
    return confusion(df, [], actual, predicted).select("accuracy", "f1_score", overall.alias("auc_roc"))


def group_counts(
    df: DataFrame, keys: Sequence[str], actual: str = "actual_value", predicted: str = "predicted_label"
) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a == 1).alias("n_actual_pos"),
        F.count_if(p == 1).alias("n_pred_pos"),
        F.count_if((a == 1) & (p == 1)).alias("n_tp"),
        F.count_if((a == 0) & (p == 1)).alias("n_fp"),
        F.count_if(a == 0).alias("n_actual_neg"),
    )


def fairness_metrics(counts: DataFrame, interval: str = "wald") -> DataFrame:
    """Rates and 95 % intervals from :func:`group_counts`.

    ``f1_score`` counts false negatives; ``f1_reference`` is the variant that leaves them out.
    """
    c = F.col
    rates = counts.select(
        "*",
        ratio(c("n_actual_pos"), c("n")).alias("actual_approval_rates"),
        ratio(c("n_pred_pos"), c("n")).alias("predicted_approval_rate"),
        ratio(c("n_tp"), c("n_actual_pos")).alias("true_positive_rate"),
        ratio(c("n_fp"), c("n_actual_neg")).alias("false_positive_rate"),
        ratio(c("n_tp"), c("n_pred_pos")).alias("precision_rate"),
        ratio(c("n_tp") * 2, c("n_tp") + c("n_fp") + c("n_actual_pos")).alias("f1_score"),
        ratio(c("n_tp") * 2, c("n_tp") * 2 + c("n_fp")).alias("f1_reference"),
    )
    bounds = wald_interval if interval == "wald" else wilson_interval
    out = ["*"]
    for name, rate, n in [
        ("dpd", "predicted_approval_rate", "n"),
        ("eod", "true_positive_rate", "n_actual_pos"),
        ("fpr", "false_positive_rate", "n_actual_neg"),
    ]:
        low, high = bounds(c(rate), c(n))
        out += [low.alias(f"{name}_ci_lower"), high.alias(f"{name}_ci_upper")]
    return rates.select(*out)


def gap_vs_reference(
    metrics: DataFrame,
    period: str = "activity_year",
    group: str = RACE,
    reference: str = REFERENCE_GROUP,
    exclude: str | None = UNKNOWN_GROUP,
) -> DataFrame:
    """Gaps from the reference group of the same period; significant when intervals do not overlap.

    ``metrics`` has one row per (period, group), a handful per period.
    """
    c = F.col
    peers = W.partitionBy(period)
    is_ref = F.lower(c(group)) == reference.lower()
    of_ref = lambda source: F.max(F.when(is_ref, c(source))).over(peers)
    sources = {
        "white_tpr": "true_positive_rate",
        "white_fpr": "false_positive_rate",
        "white_tpr_ci_lower": "eod_ci_lower",
        "white_tpr_ci_upper": "eod_ci_upper",
        "white_fpr_ci_lower": "fpr_ci_lower",
        "white_fpr_ci_upper": "fpr_ci_upper",
    }
    # a window over these few rows reads the applications once; a self-join would read them twice
    joined = metrics.select(
        "*",
        *[of_ref(x).alias(n) for n, x in sources.items()],
        of_ref("actual_approval_rates").alias("__ref_actual"),
        F.max(is_ref).over(peers).alias("__has_ref"),
    ).filter("__has_ref")
    kept = joined if exclude is None else joined.filter(c(group) != exclude)

    def apart(mine: str, theirs: str) -> Column:
        below = c(f"{mine}_ci_upper") < c(f"{theirs}_ci_lower")
        above = c(f"{mine}_ci_lower") > c(f"{theirs}_ci_upper")
        return F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))

    return kept.select(
        *metrics.columns,
        *sources,
        (c("actual_approval_rates") - c("__ref_actual")).alias("actual_gap"),
        (c("true_positive_rate") - c("white_tpr")).alias("tpr_gap"),
        (c("false_positive_rate") - c("white_fpr")).alias("fpr_gap"),
        apart("eod", "white_tpr").alias("is_tpr_gap_significant"),
        apart("fpr", "white_fpr").alias("is_fpr_gap_significant"),
    )


def parity_differences(df: DataFrame, group: str, keys: Sequence[str] = (), **columns) -> DataFrame:
    """Demographic parity and equalized odds differences between the best and worst group."""
    m = fairness_metrics(group_counts(df, [*keys, group], **columns))
    spread = lambda c: F.max(c) - F.min(c)
    return m.groupBy(*keys).agg(
        spread("predicted_approval_rate").alias("demographic_parity_difference"),
        F.greatest(spread("true_positive_rate"), spread("false_positive_rate")).alias("equalized_odds_difference"),
        spread("true_positive_rate").alias("equal_opportunity_difference"),
    )


def metric_frame(
    df: DataFrame, group: str, actual: str = "actual_value", predicted: str = "predicted_label"
) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(group).agg(
        n.alias("n"),
        ratio(F.count_if(F.col(actual) == F.col(predicted)), n).alias("accuracy"),
        ratio(F.count_if(F.col(predicted) == 1), n).alias("selection_rate"),
    )


def calibration(
    df: DataFrame, group: str = RACE, bins: int = 5, score: str = "score", actual: str = "actual_value"
) -> DataFrame:
    return df.groupBy(group, equal_bin(F.col(score), 0, 1, bins).alias("score_bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("avg_predicted_score"),
        F.avg(actual).alias("actual_approval_rate"),
    )


def score_histogram(
    df: DataFrame, keys: Sequence[str], bins: int = 10, score: str = "score"
) -> DataFrame:
    return df.groupBy(*keys, equal_bin(F.col(score), 0, 1, bins).alias("score_bin")).agg(
        F.count(F.lit(1)).alias("n_in_bin"), F.avg(score).alias("avg_score")
    )


def score_cdf(df: DataFrame, group: str, score: str = "score", weight: str | None = None) -> DataFrame:
    """Cumulative share of applications at or below each distinct score, per group."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(group, score).agg(n.cast("bigint").alias("n"))
    totals = bucket_totals(counted, score, {"total": "n"}, [group])
    return totals.select(group, score, "n", "total", ratio(F.col("total"), F.col("total_total")).alias("percentile"))


def _by_score(df: DataFrame, keys: Sequence[str], score: str, actual: str) -> DataFrame:
    """Positives and negatives per distinct score: equal scores collapse before any ordering."""
    return df.groupBy(*keys, score).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")
    )


#: Equal-width buckets of scores that rank statistics are settled in.
SCORE_BUCKETS = 4096


def _auc(counts: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Pairs inside a score bucket are compared there; across buckets their totals are enough."""
    wide = lambda c: c.cast("decimal(19,0)")
    binned = counts.withColumn("__bucket", value_bucket(F.col(score), (0.0, 1.0), SCORE_BUCKETS))
    within = W.partitionBy(*keys, "__bucket").orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    local = binned.withColumn("__cum", F.sum("neg").over(within))
    twice_wins = wide(F.col("pos")) * wide(F.col("__cum") * 2 - F.col("neg"))
    # the window left the rows dealt by (keys, bucket), so this moves nothing
    buckets = local.groupBy(*keys, "__bucket").agg(F.sum(twice_wins).alias("__w"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)  # a row per bucket
    below = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    crossed = buckets.withColumn("__w", F.col("__w") + wide(F.col("__p")) * wide(below * 2))
    sums = crossed.groupBy(*keys).agg(F.sum("__w").alias("__w"), F.sum("__p").alias("__p"), F.sum("__n").alias("__n"))
    return sums.select(
        *keys, ratio(F.col("__w"), (F.col("__p") * 2).cast("double") * F.col("__n").cast("double")).alias("auc_roc")
    )


def auc(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", actual: str = "actual_value"
) -> DataFrame:
    """Exact ROC AUC by rank sums over distinct scores; ties count half. Null with one class only."""
    return _auc(_by_score(df, keys, score, actual), keys, score)


def auc_report(
    df: DataFrame, period: str = "activity_year", score: str = "score", actual: str = "actual_value"
) -> DataFrame:
    """AUC per period plus the overall AUC on a row with a null period, from one pass over ``df``."""
    counts = settle(_by_score(df, [period], score, actual))
    pooled = counts.groupBy(score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    overall = _auc(pooled, [], score).select(F.lit(None).cast(df.schema[period].dataType).alias(period), "auc_roc")
    return _auc(counts, [period], score).unionByName(overall)


def pr_curve(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", actual: str = "actual_value"
) -> DataFrame:
    """Precision and recall at each distinct score used as threshold."""
    t = bucket_totals(_by_score(df, keys, score, actual), score, {"tp": "pos", "fp": "neg"}, keys, descending=True)
    return t.select(
        *keys,
        F.col(score).alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp_total")).alias("recall"),
        ratio(F.col("pos"), F.col("tp_total")).alias("recall_step"),
    )


def average_precision(df: DataFrame, keys: Sequence[str] = (), **columns) -> DataFrame:
    steps = F.col("recall_step") * F.col("precision")
    return pr_curve(df, keys, **columns).groupBy(*keys).agg(F.sum(steps).alias("average_precision"))


def classification_report(
    df: DataFrame, actual: str = "actual_value", predicted: str = "predicted_label"
) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    sides = df.select(
        F.explode(
            F.array(
                F.struct(F.col(actual).alias("cls"), F.lit(1).alias("is_actual")),
                F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("is_actual")),
            )
        ).alias("s"),
        (F.col(actual) == F.col(predicted)).alias("right"),
    ).select("s.cls", "s.is_actual", "right")
    c = sides.groupBy(F.col("cls").alias("label")).agg(
        F.count_if(F.col("right") & (F.col("is_actual") == 1)).alias("__hit"),
        F.count_if(F.col("is_actual") == 0).alias("__pred"),
        F.count_if(F.col("is_actual") == 1).alias("support"),
    )
    hit, pred, sup = F.col("__hit"), F.col("__pred"), F.col("support")
    return c.select(
        "label",
        ratio(hit, pred).alias("precision"),
        ratio(hit, sup).alias("recall"),
        ratio(hit * 2, pred + sup).alias("f1_score"),
        "support",
    )


def tract_group_scores(
    df: DataFrame,
    tract: str = "census_tract",
    group: str = "race",
    county: str = "county_code",
    score: str = "score",
    actual: str = "actual_value",
    threshold: float = 0.5,
) -> DataFrame:
    """Score and outcome aggregates per (tract, group), without unknown groups and bad tract ids."""
    c = F.col
    kept = df.filter((c(group) != UNKNOWN_GROUP) & ~c(tract).isin(BAD_TRACTS))
    yes = c(actual) == 1
    # the county joins the keys first: a max over text would sort all rows instead of hashing them
    parts = kept.groupBy(tract, group, county).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(score).alias("s"),
        F.count(score).alias("m"),
        F.count_if(yes).alias("yes"),
        F.count_if(c(actual) == 0).alias("no"),
        F.sum(F.when(yes, c(score))).alias("s_yes"),
        F.count(F.when(yes, c(score))).alias("m_yes"),
        F.count_if(c(score) >= threshold).alias("pred"),
    )
    return parts.groupBy(tract, group).agg(
        F.max(county).alias(county),
        F.sum("n").alias("total_apps"),
        ratio(F.sum("s"), F.sum("m")).alias("avg_score"),
        F.sum("yes").alias("actual_positives"),
        F.sum("no").alias("actual_denials"),
        ratio(F.sum("s_yes"), F.sum("m_yes")).alias("avg_score_given_positive"),
        F.sum("pred").alias("predicted_positives"),
    )


def redlining(
    aggregates: DataFrame,
    tract: str = "census_tract",
    group: str = "race",
    reference: str = REFERENCE_GROUP,
    minority: Sequence[str] = tuple(MINORITY_GROUPS),
    fraction: float = 0.8,
) -> DataFrame:
    """Disparate-impact ratios against the tract's reference group and four-fifths flags."""
    c = F.col
    # one row per (tract, group): a tract's window holds only its few groups
    peers = W.partitionBy(tract)
    is_ref = F.lower(c(group)) == reference.lower()
    with_ref = aggregates.select(
        "*",
        F.max(F.when(is_ref, c("avg_score"))).over(peers).alias("avg_score_white"),
        F.max(F.when(is_ref, c("avg_score_given_positive"))).over(peers).alias("avg_score_pos_white"),
    )
    rates = with_ref.select(
        "*",
        ratio(c("actual_positives"), c("total_apps")).alias("actual_approval_rate"),
        ratio(c("predicted_positives"), c("total_apps")).alias("predicted_approval_rate"),
        ratio(c("avg_score"), c("avg_score_white")).alias("score_dpd"),
        ratio(c("avg_score_given_positive"), c("avg_score_pos_white")).alias("score_eod"),
    )
    low = [F.coalesce(c(x) < fraction, F.lit(False)) for x in ("score_dpd", "score_eod")]
    watched = c(group).isin(list(minority))
    return rates.select(
        "*",
        (c("predicted_approval_rate") - c("actual_approval_rate")).alias("model_vs_actual_gap"),
        (watched & (low[0] | low[1])).cast("int").alias("is_possible_redlining"),
        (watched & low[0] & low[1]).cast("int").alias("is_redlining"),
    )


def attach_places(
    df: DataFrame, zips: DataFrame, states: DataFrame, centroids: DataFrame, tract: str = "census_tract"
) -> DataFrame:
    """Zip, city, state name and centroid of each tract.

    ``zips`` must hold one row per tract (the best zip), so the join cannot multiply rows.
    """
    named = df.join(zips.withColumnRenamed("census_tract", tract), tract, "left")
    fips = states.select(F.col("fips").alias("__fips"), F.col("usps").alias("__usps"))
    named = named.join(fips, F.substring(tract, 1, 2) == F.col("__fips"), "left")
    named = named.withColumn("state_name", F.coalesce("state_name", "__usps")).drop("__fips", "__usps")
    return attach_centroid(named, centroids, tract)


def attach_centroid(df: DataFrame, centroids: DataFrame, tract: str = "census_tract") -> DataFrame:
    where = centroids.select(
        F.col("tract_fips").alias(tract), F.col("centroid_lat").alias("latitude"), F.col("centroid_lon").alias("longitude")
    )
    return df.join(where, tract, "left")


def counterfactual_by_tract(
    results: DataFrame, tract: str = "census_tract", county: str = "county_code"
) -> DataFrame:
    """Mean scores before and after a group change per (tract, from, to)."""
    kept = results.filter(F.col("score_change").isNotNull() & ~F.col(tract).isin(BAD_TRACTS))
    measures = {
        "previous_score": "avg_prev_score",
        "counterfactual_score": "avg_counterfactual_score",
        "score_change": "avg_score_change",
    }
    keys = [tract, "original_race", "new_race"]
    parts = kept.groupBy(*keys, county).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(m).alias(f"{p}_{m}") for m in measures for p, f in (("s", F.sum), ("m", F.count))],
    )
    return parts.groupBy(*keys).agg(
        F.max(county).alias(county),
        F.sum("n").alias("total_apps"),
        *[ratio(F.sum(f"s_{m}"), F.sum(f"m_{m}")).alias(name) for m, name in measures.items()],
    )


def pivot_mean(
    df: DataFrame, values: Sequence[str], row: str = "original_race", column: str = "new_race", measure: str = "score_change"
) -> DataFrame:
    """Mean of ``measure`` as a matrix; the column values are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(measure))


def mean_change(df: DataFrame, by: str = "new_race", measure: str = "score_change") -> DataFrame:
    return df.groupBy(by).agg(F.avg(measure).alias(f"avg_{measure}"))


def flip_rate(
    df: DataFrame,
    keys: Sequence[str] = ("original_race", "new_race"),
    threshold: float = 0.5,
    before: str = "previous_score",
    after: str = "counterfactual_score",
) -> DataFrame:
    """Share of applications whose decision changes with the group."""
    flipped = (F.col(before) >= threshold) != (F.col(after) >= threshold)
    counts = df.groupBy(*keys).agg(F.count_if(flipped).alias("flips"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("flip_rate", ratio(F.col("flips"), F.col("n")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k · n_c) per class."""
    counts = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    kinds = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", ratio(total, F.col("n") * kinds))


def with_class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return match_on(df, weights, [label], "left")


def mean_abs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean absolute value per column, one row per feature."""
    one = df.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in columns])
    return one.select(F.explode(pairs).alias("p")).select("p.*")
