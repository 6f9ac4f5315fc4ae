"""Approval rates by any keys, gaps between groups, prior-period rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.lending import MINORITY_GROUPS, REFERENCE_GROUP
from lendlens.functions.numbers import ratio
from lendlens.operators.ranks import match_on
from lendlens.shared import settle

RACE = "applicant_derived_racial_category"


def approval_rate(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "loan_approved",
    drop_null_keys: bool = False,
    rate: str = "approval_rate",
) -> DataFrame:
    """Applications, approvals and their ratio per key combination."""
    kept = df.filter(F.col(label).isNotNull())
    if drop_null_keys:
        kept = kept.dropna(subset=list(keys))
    counts = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_apps"), F.count_if(F.col(label) == 1).alias("total_approved")
    )
    return counts.withColumn(rate, ratio(F.col("total_approved"), F.col("total_apps")))


def group_gap(
    df: DataFrame,
    entity: Sequence[str],
    group: str = RACE,
    reference: str = REFERENCE_GROUP,
    minority: Sequence[str] = tuple(MINORITY_GROUPS),
    label: str = "loan_approved",
    pooled: bool = False,
    names: tuple[str, str, str] = ("white_approval_rate", "minority_approval_rate", "minority_gap"),
) -> DataFrame:
    """Reference rate, minority rate and their difference per entity.

    The minority rate is the best rate among the minority groups, or with ``pooled`` the rate of
    all their applications together.
    """
    rates = approval_rate(df, [*entity, group], label)
    is_ref, is_min = F.col(group) == reference, F.col(group).isin(list(minority))
    if pooled:
        low = ratio(F.sum(F.when(is_min, F.col("total_approved"))), F.sum(F.when(is_min, F.col("total_apps"))))
    else:
        low = F.max(F.when(is_min, F.col("approval_rate")))
    ref, mn, gap = names
    sides = rates.groupBy(*entity).agg(F.max(F.when(is_ref, F.col("approval_rate"))).alias(ref), low.alias(mn))
    return sides.withColumn(gap, F.col(ref) - F.col(mn))


def annual_rates(
    df: DataFrame, keys: Sequence[str], predicted: str = "predicted_label", actual: str = "actual_value"
) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        ratio(F.count_if(F.col(predicted) == 1), n).alias("predicted_approval_rate"),
        ratio(F.count_if(F.col(actual) == 1), n).alias("actual_approval_rate"),
    )


def group_share_report(
    df: DataFrame, period: str, group: str, groups: Sequence[str], label: str = "loan_approved"
) -> DataFrame:
    """Per period: approval %, and each group's share % and approval %."""
    yes, no = F.col(label) == 1, F.col(label) == 0
    counted = [F.count_if(yes).alias("__yes"), F.count_if(yes | no).alias("__all")]
    for i, g in enumerate(groups):
        mine = F.col(group) == g
        counted += [F.count_if(mine).alias(f"__g{i}"), F.count_if(mine & yes).alias(f"__y{i}")]
    pct = lambda a, b, d: F.round(ratio(F.col(a), F.col(b)) * 100, d)
    shares = []
    for i, g in enumerate(groups):
        shares += [
            pct(f"__g{i}", "__all", 4).alias(f"{g.lower()}_pct"),
            pct(f"__y{i}", f"__g{i}", 4).alias(f"{g.lower()}_approval_rate"),
        ]
    return df.groupBy(period).agg(*counted).select(period, pct("__yes", "__all", 2).alias("approval_rate"), *shares)


def prior_rates(
    df: DataFrame,
    entity: str,
    prefix: str,
    period: str = "activity_year",
    group: str = RACE,
    groups: Sequence[str] = ("Latinx", "AAPI", "Black", "White"),
    label: str = "loan_approved",
    overall: str | None = None,
    gap: str | None = None,
) -> DataFrame:
    """One row per (entity, following period) with last period's rates as columns.

    Groups are columns of a single aggregate, so attaching them takes one join per entity instead of
    one per group. ``overall`` adds the rate of all applications; ``gap`` the reference-minus-minority
    difference.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(entity, period).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col(label) == 1).alias("__y"),
        *[
            ratio(F.count_if((F.col(group) == g) & (F.col(label) == 1)), F.count_if(F.col(group) == g)).alias(f"__r{i}")
            for i, g in enumerate(groups)
        ],
    )
    r = {g: F.col(f"__r{i}") for i, g in enumerate(groups)}
    out: list[Column] = [F.col(entity), (F.col(period) + 1).alias(period)]
    out += [r[g].alias(f"{prefix}_{g.lower()}") for g in groups]
    if overall:
        out.append(ratio(F.col("__y"), F.col("__n")).alias(overall))
    if gap:
        minority = [r[g] for g in groups if g != REFERENCE_GROUP]
        out.append((r[REFERENCE_GROUP] - F.greatest(*minority)).alias(gap))
    return counts.select(*out)


def attach_prior(df: DataFrame, rates: DataFrame, entity: str, period: str = "activity_year") -> DataFrame:
    """Left join of :func:`prior_rates`, stored first so its size decides the join strategy."""
    return df.join(settle(rates.filter(F.col(entity).isNotNull())), [entity, period], "left")


def tract_summary(
    df: DataFrame,
    key: str = "census_tract",
    action: str = "action_taken",
    race: str = "applicant_race_1",
    ethnicity: str = "applicant_ethnicity_1",
    not_hispanic: int = 2,
) -> DataFrame:
    """Originations by group, applications, denials, fallout and their rates per tract."""
    from lendlens.codes import AAPI_RACES, LATINX_ETHNICITIES
    from lendlens.functions.lending import FALLOUT_ACTIONS, white_non_hispanic

    made = F.col(action) == 1
    counts = df.groupBy(key).agg(
        F.count_if(made).alias("TotalOriginations"),
        F.count_if(made & white_non_hispanic(F.col(race), F.col(ethnicity), not_hispanic)).alias(
            "WhiteNonHispanicOriginations"
        ),
        F.count_if(made & (F.col(race) == 3)).alias("BlackOriginations"),
        F.count_if(made & F.col(ethnicity).isin(LATINX_ETHNICITIES)).alias("LatinxOriginations"),
        F.count_if(made & F.col(race).isin(AAPI_RACES)).alias("AAPIOriginations"),
        F.count(F.lit(1)).alias("Applications"),
        F.count_if(F.col(action) == 3).alias("Denials"),
        F.count_if(F.col(action).isin(FALLOUT_ACTIONS)).alias("Fallout"),
    )
    rate = lambda c, n: F.round(ratio(F.col(c), F.col("Applications")), 6).alias(n)
    return counts.select(
        "*",
        rate("TotalOriginations", "OriginationRate"),
        rate("Denials", "DenialRate"),
        rate("Fallout", "FalloutRate"),
    )


def target_encode(df: DataFrame, key: str, label: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """Mean label per key, the overall mean for a key without one."""
    source = df if source is None else source
    sums = settle(source.groupBy(key).agg(F.sum(label).alias("__s"), F.count(label).alias("__c")))
    overall = sums.agg(ratio(F.sum("__s"), F.sum("__c"))).scalar()
    means = sums.select(F.col(key), ratio(F.col("__s"), F.col("__c")).alias("__m"))
    joined = match_on(df, means, [key], "left")
    return joined.select(*df.columns, F.coalesce(F.col("__m"), overall).alias(name))


def collapse_rare(df: DataFrame, column: str, minimum: int | Column, name: str, other: str = "Other") -> DataFrame:
    """Categories with fewer than ``minimum`` rows become ``other``."""
    counts = settle(df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")))
    joined = match_on(df, counts, [column], "left")
    return joined.select(*df.columns, F.when(F.col("__n") < minimum, other).otherwise(F.col(column)).alias(name))
