"""Imputation, capping and the preprocessed feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions import lending as L
from lendlens.functions.numbers import missing_flag, present_flag, quartile_label, ratio, safe_log1p, winsorise
from lendlens.functions.text import joined_label
from lendlens.operators.quantiles import column_quantiles, grouped_medians, grouped_quantiles, one_row
from lendlens.operators.ranks import hex_key, prior_history, rank_by_key
from lendlens.operators.rates import collapse_rare
from lendlens.shared import settle

# Column families of the feature table.
ACS_COLUMNS = (
    "median_household_income minority_population_pct pct_bachelors_or_higher "
    "total_population_below_poverty_level_pct gini_index_of_income_inequality income_bucketed"
).split()
MARKET_COLUMNS = (
    "avg_median_sale_price avg_median_sale_price_year_over_year avg_median_list_price "
    "avg_median_list_price_year_over_year avg_median_price_per_square_foot "
    "avg_median_price_per_square_foot_year_over_year avg_inventory avg_new_listings "
    "avg_median_days_on_market"
).split()
LOG_COLUMNS = (
    "income loan_amount property_value median_household_income avg_median_sale_price "
    "avg_median_list_price avg_median_price_per_square_foot avg_inventory avg_new_listings "
    "avg_median_days_on_market avg_median_sale_price_year_over_year "
    "avg_median_list_price_year_over_year avg_median_price_per_square_foot_year_over_year "
    "total_population_below_poverty_level_pct"
).split()
#: What :func:`preprocess` reads of the feature table.
INPUT_COLUMNS = (
    "loan_application_id activity_year loan_approved loan_purpose loan_type occupancy_type state_code county_code "
    "census_tract zip_code lender_entity_name lender_entity_age lender_registration_status applicant_sex_category "
    "applicant_age applicant_derived_racial_category debt_to_income_ratio property_value loan_amount income "
    "is_distressed is_underserved"
).split() + ACS_COLUMNS + MARKET_COLUMNS
QUARTILE_COLUMNS = ["total_population_below_poverty_level_pct", "avg_median_days_on_market"]
RATIO_COLUMNS = ["loan_to_income_ratio", "income_to_loan_ratio_stratified"]


def constants(row: DataFrame) -> Column:
    """A one-row frame as a struct constant; planned as one scalar subquery, not a join."""
    return settle(row).select(F.struct("*")).scalar()


def percentile_caps(
    df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, exact: bool = True
) -> DataFrame:
    """One row of ``<column>_lower_cap`` and ``<column>_upper_cap``."""
    q = column_quantiles(df, columns, [low, high], exact=exact)
    return one_row(q, columns, {0: "{}_lower_cap", 1: "{}_upper_cap"})


def quartile_cuts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
    return one_row(q, columns, {0: "{}_q1", 1: "{}_q2", 2: "{}_q3"})


def impute_hierarchical(
    df: DataFrame, chains: Mapping[str, Sequence[Sequence[str]]]
) -> DataFrame:
    """Fill each column from medians at ever coarser grains.

    ``chains`` maps a column to its fallbacks, each a list of key columns and ``[]`` the whole frame.
    All medians come from one pass; each grain is attached with one join.
    """
    grains: dict[str, tuple[list[str], list[str]]] = {}
    for column, chain in chains.items():
        for keys in chain:
            name = "|".join(keys)
            grains.setdefault(name, (list(keys), []))[1].append(column)
    medians = grouped_medians(df, grains)
    joined, filled = attach_medians(df, medians, grains)
    out = []
    for c in df.columns:
        if c not in chains:
            out.append(F.col(c))
            continue
        fallbacks = [filled["|".join(keys)](c) for keys in chains[c]]
        out.append(F.coalesce(F.col(c).cast("double"), *fallbacks).alias(c))
    return joined.select(*out)


def attach_medians(
    df: DataFrame, medians: Mapping[str, DataFrame], grains, whole: str | None = None
) -> tuple[DataFrame, dict]:
    """Join every keyed grain once; returns the frame and, per grain, a column → median accessor.

    A grain's medians are attached as one struct column, so that a row holds few columns through the joins. Those of
    the whole frame are taken from the column ``whole`` if it is given; the caller attaches it then.
    """
    joined, accessors = df, {}
    for i, (name, (keys, cols)) in enumerate(grains.items()):
        m = medians[name]
        if not keys:
            at = whole or f"__m{i}"
            if whole is None:
                joined = joined.withColumn(at, constants(m.select(*[f"median_{c}" for c in cols])))
            accessors[name] = lambda c, at=at: F.col(at)[f"median_{c}"]
        else:
            renamed = m.select(*keys, F.struct(*[f"median_{c}" for c in cols]).alias(f"__m{i}"))
            joined = joined.join(renamed, list(keys), "left")
            accessors[name] = lambda c, i=i: F.col(f"__m{i}")[f"median_{c}"]
    return joined, accessors


def prior_rate_history(
    df: DataFrame, entity: str = "census_tract", period: str = "activity_year", label: str = "loan_approved"
) -> DataFrame:
    """Approval rate over all earlier periods of the entity, one row per (entity, period)."""
    per_period = df.groupBy(entity, period).agg(F.sum(label).alias("approvals"), F.count(label).alias("total_apps"))
    history = prior_history(per_period, [entity], period, {"__a": "approvals", "__n": "total_apps"})
    return history.select(entity, period, ratio(F.col("__a"), F.col("__n")).alias("prior_approval_rate"))


def interactions(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Products of column pairs."""
    return df.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in pairs.items()})


POLYNOMIALS = {
    "income_log_x_property_value": ("income_log", "property_value"),
    "gini_x_income_log": ("gini_index_of_income_inequality", "income_log"),
}


def select_features(df: DataFrame, columns: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """The listed columns, all by default, without those of ``drop``; a listed column that is missing raises an error."""
    return df.select(*(columns or df.columns)).drop(*drop)


def stratified_income_ratio(purpose_median: Column) -> Column:
    """Income over the loan amount relative to the purpose's median loan; plain ratio without one."""
    loan, income = F.col("loan_amount").cast("double"), F.col("income").cast("double")
    relative = loan / F.nullif(purpose_median, F.lit(0.0))
    return F.coalesce(
        F.when(purpose_median != 0, income / F.nullif(relative, F.lit(0.0))),
        F.when(F.coalesce(purpose_median, F.lit(0.0)) == 0, income / F.nullif(loan, F.lit(0.0))),
    )


def clean_features(features: DataFrame) -> DataFrame:
    """Grouped categories, parsed ratios, flags and interaction labels, before any statistics."""
    c = F.col
    race = c("applicant_derived_racial_category")
    poor = (F.coalesce(c("is_distressed"), F.lit(0)) == 1) | (F.coalesce(c("is_underserved"), F.lit(0)) == 1)
    gini = c("gini_index_of_income_inequality")
    acs = [
        F.when(gini >= 0, gini).alias(x) if x == "gini_index_of_income_inequality"
        else F.round(x).alias(x) if x == "income_bucketed"
        else c(x)
        for x in ACS_COLUMNS
    ]
    return features.select(
        "loan_application_id",
        c("activity_year").cast("int").alias("activity_year"),
        c("loan_approved").cast("int").alias("loan_approved"),
        "loan_purpose",
        L.purpose_group(c("loan_purpose")).alias("loan_purpose_grouped"),
        c("loan_type").cast("string").alias("loan_type"),
        c("occupancy_type").cast("string").alias("occupancy_type"),
        *[c(x).cast("string").alias(x) for x in ("state_code", "county_code", "census_tract", "zip_code")],
        "lender_entity_name",
        "lender_entity_age",
        L.registration_group(c("lender_registration_status")).alias("lender_registration_status"),
        L.sex_group(c("applicant_sex_category")).alias("applicant_sex_category"),
        L.or_unknown(c("applicant_age")).alias("applicant_age"),
        L.or_unknown(race).alias("applicant_derived_racial_category"),
        L.dti_number(c("debt_to_income_ratio")).alias("cleaned_dti"),
        "property_value",
        "loan_amount",
        "income",
        *acs,
        F.coalesce(c("is_distressed").cast("int"), F.lit(0)).alias("is_distressed"),
        F.coalesce(c("is_underserved").cast("int"), F.lit(0)).alias("is_underserved"),
        *MARKET_COLUMNS,
        joined_label(race, c("applicant_sex_category")).alias("race_sex_interaction"),
        joined_label(race, c("state_code")).alias("race_state_interaction"),
        present_flag(c("property_value")).alias("has_property_value"),
        present_flag(c("median_household_income")).alias("has_acs_data"),
        F.coalesce((gini >= 0).cast("int"), F.lit(0)).alias("has_gini_data"),
        poor.cast("int").alias("is_distressed_or_underserved"),
        F.concat_ws(
            "_", F.when(poor, "DistressedOrUnderserved").otherwise("NotDistressedOrUnderserved"), L.or_unknown(race)
        ).alias("distressed_or_underserved_race"),
    ).filter(c("loan_purpose_grouped") != "Not Applicable")


# Grain name → (keys, columns whose median is wanted).
GRAINS = {
    "all": ([], ["cleaned_dti", "property_value", "loan_amount", "income", *ACS_COLUMNS, *MARKET_COLUMNS]),
    "zip_purpose": (["zip_code", "loan_purpose"], ["property_value"]),
    "zip": (["zip_code"], ["property_value", *MARKET_COLUMNS]),
    "purpose": (["loan_purpose"], ["property_value"]),
    "county": (["state_code", "county_code"], ACS_COLUMNS),
    "state": (["state_code"], [*ACS_COLUMNS, *MARKET_COLUMNS]),
    "state_purpose": (["state_code", "loan_purpose_grouped"], ["loan_amount"]),
    "purpose_group": (["loan_purpose_grouped"], ["loan_amount"]),
}


def preprocess(
    features: DataFrame,
    first_year: int | None = None,
    rare_minimum: int = 5000,
    use_imputed_for_logs: bool = False,
    number_rows: bool = True,
) -> DataFrame:
    """The model-ready table: imputed, logged, capped and binned features, one row per application.

    ``features`` is read once: its cleaned rows are settled (pass a stored table, of :data:`INPUT_COLUMNS` at least, so
    that this step stays small enough for the JVM to compile). Statistics come first, each from a column-pruned
    pass over them: medians and percentile caps at eight grains, tract history, category counts. Their results are small
    settled tables, so the final pass reads the wide rows once and, while those tables stay under
    Spark's broadcast limit, does not shuffle them until the closing row numbering. Ids must be the
    md5 keys of the staging step when ``number_rows`` is set.
    """
    c = F.col
    base = settle(clean_features(features))
    medians = grouped_quantiles(base, GRAINS, {"median": 0.5, "low": 0.01, "high": 0.99})
    # all constants ride on one struct column, planned once however often they are used; it is attached after the joins
    whole = constants(medians["all"])
    caps = c("__all")

    history = settle(prior_rate_history(base))
    start = history.agg(F.min("activity_year")).scalar() if first_year is None else F.lit(first_year)
    later = history.filter(c("activity_year") != start)
    typical = column_quantiles(later, ["prior_approval_rate"], [0.5], ["activity_year"])
    history = settle(
        history.join(typical.select("activity_year", c("q0").alias("__typical")), "activity_year", "left")
    )

    joined, median = attach_medians(base, medians, GRAINS, "__all")
    joined = joined.join(history.withColumnRenamed("prior_approval_rate", "__prior"), ["census_tract", "activity_year"], "left")
    joined = collapse_rare(joined, "race_sex_interaction", rare_minimum, "__race_sex").withColumn("__all", whole)

    g = median["all"]
    filled = {
        "debt_to_income_ratio": F.coalesce(c("cleaned_dti"), g("cleaned_dti")),
        "property_value": F.coalesce(
            c("property_value").cast("double"),
            *[median[x]("property_value") for x in ("zip_purpose", "zip", "purpose", "all")],
        ),
    }
    for x in ACS_COLUMNS:
        filled[x] = F.coalesce(c(x).cast("double"), median["county"](x), median["state"](x), g(x))
    for x in MARKET_COLUMNS:
        filled[x] = F.coalesce(c(x).cast("double"), median["zip"](x), median["state"](x), g(x))

    logged = []
    for x in LOG_COLUMNS:
        source = filled.get(x, c(x)) if use_imputed_for_logs else c(x)
        logged += [
            safe_log1p(source).alias(f"{x}_log"),
            missing_flag(c(x)).alias(f"{x}_log_missing_flag"),
            winsorise(source, caps[f"low_{x}"], caps[f"high_{x}"]).alias(f"{x}_capped"),
        ]

    income_to_loan = stratified_income_ratio(median["purpose_group"]("loan_amount"))
    local_income = F.coalesce(c("median_household_income").cast("double"), g("median_household_income"))
    loan_to_income = F.when(
        local_income > 0, F.coalesce(c("loan_amount").cast("double"), g("loan_amount")) / local_income
    )

    # second-level statistics need only these few columns, not the wide rows
    narrow_join = base.join(medians["purpose_group"], "loan_purpose_grouped", "left").withColumn("__all", whole)
    narrow = narrow_join.select(
        stratified_income_ratio(c("median_loan_amount")).alias("income_to_loan_ratio_stratified"),
        loan_to_income.alias("loan_to_income_ratio"),
        *[safe_log1p(c(x)).alias(f"{x}_log") for x in QUARTILE_COLUMNS],
    )
    second = column_quantiles(
        narrow, [*RATIO_COLUMNS, *[f"{x}_log" for x in QUARTILE_COLUMNS]], [0.01, 0.25, 0.5, 0.75, 0.99]
    )
    second_level = constants(
        one_row(second, narrow.columns, {0: "{}_lower_cap", 1: "{}_q1", 2: "{}_q2", 3: "{}_q3", 4: "{}_upper_cap"})
    )

    prior = F.coalesce(
        c("__prior"), F.when(c("activity_year") == start, 0.5).otherwise(c("__typical"))
    )
    kept = (
        "loan_application_id activity_year loan_approved state_code county_code census_tract zip_code "
        "lender_entity_name lender_entity_age lender_registration_status applicant_derived_racial_category "
        "applicant_sex_category applicant_age income loan_purpose loan_purpose_grouped loan_type "
        "occupancy_type loan_amount is_distressed is_underserved is_distressed_or_underserved "
        "has_property_value has_acs_data has_gini_data race_state_interaction distressed_or_underserved_race"
    ).split()
    imputed = joined.select(
        *kept,
        *[v.alias(k) for k, v in filled.items()],
        *logged,
        present_flag(c("__prior")).alias("has_prior_approval_rate_data"),
        prior.alias("prior_approval_rate"),
        c("__race_sex").alias("race_sex_interaction"),
        income_to_loan.alias("income_to_loan_ratio_stratified"),
        loan_to_income.alias("loan_to_income_ratio"),
        F.coalesce(median["state_purpose"]("loan_amount"), g("loan_amount")).alias("loan_amount_threshold"),
    )
    level2 = c("__level2")
    capped = imputed.withColumn("__level2", second_level).select(
        "*",
        *[
            winsorise(c(x), level2[f"{x}_lower_cap"], level2[f"{x}_upper_cap"]).alias(f"{x}_capped")
            for x in RATIO_COLUMNS
        ],
    )
    dti = c("debt_to_income_ratio")
    done = capped.select(
        "*",
        *[safe_log1p(c(f"{x}_capped")).alias(f"{x}_capped_and_log") for x in LOG_COLUMNS + RATIO_COLUMNS],
        *[
            missing_flag(c(f"{x}_capped")).alias(f"{x}_capped_and_log_missing_flag")
            for x in LOG_COLUMNS + RATIO_COLUMNS
        ],
        L.dti_bin(dti).alias("dti_bin"),
        L.minority_bin(c("minority_population_pct")).alias("minority_pct_bin"),
        L.gini_bin(c("gini_index_of_income_inequality")).alias("gini_bin"),
        F.coalesce((dti >= 40) & (c("loan_amount") > c("loan_amount_threshold")), F.lit(False))
        .cast("int")
        .alias("high_dti_large_loan"),
        *[
            quartile_label(c(f"{x}_log"), [level2[f"{x}_log_q{i}"] for i in (1, 2, 3)]).alias(f"{x}_log_bin")
            for x in QUARTILE_COLUMNS
        ],
    ).drop("__level2")
    if not number_rows:
        return done
    # ids are md5 hashes, so they are evenly spread; every join above keeps the rows of ``base``
    key, ids = hex_key("loan_application_id"), base.select("loan_application_id")
    return rank_by_key(done, key, "loan_application_id", 1 << 32, counted=ids)
