"""The assembled pipeline, in order: staging → features → model table → audit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, functions as F

from lendlens.functions import lending as L
from lendlens.operators import cleaning, enrich, fairness, features, rates, sampling
from lendlens.plans import staging
from lendlens.shared import settle

MODEL_FEATURES = (
    "activity_year dti_bin lender_prior_year_approval_rate loan_purpose_grouped property_value "
    "lender_prior_approval_rate_white loan_type loan_amount lender_prior_approval_rate_black "
    "lender_prior_approval_rate_latinx lender_prior_approval_rate_aapi lender_minority_gap "
    "income_log_x_property_value prior_approval_rate income_to_loan_ratio_stratified applicant_age "
    "income_log income applicant_derived_racial_category race_state_interaction "
    "distressed_or_underserved_race avg_median_price_per_square_foot pct_bachelors_or_higher "
    "loan_to_income_ratio lender_registration_status minority_population_pct "
    "gini_index_of_income_inequality tract_minority_gap gini_x_income_log"
).split()
CATEGORICAL_FEATURES = (
    "dti_bin loan_purpose_grouped loan_type applicant_age applicant_derived_racial_category "
    "race_state_interaction distressed_or_underserved_race lender_registration_status"
).split()
CARRIED = (
    "loan_application_id activity_year loan_approved loan_purpose_grouped dti_bin loan_type applicant_age "
    "property_value prior_approval_rate race_state_interaction income_to_loan_ratio_stratified income_log "
    "applicant_derived_racial_category lender_registration_status distressed_or_underserved_race "
    "minority_population_pct income loan_amount occupancy_type pct_bachelors_or_higher minority_pct_bin "
    "loan_to_income_ratio gini_index_of_income_inequality avg_median_price_per_square_foot "
    "applicant_sex_category lender_entity_name"
).split()


@dataclass
class RawTables:
    """Landed inputs."""

    lar: DataFrame
    acs: DataFrame
    crosswalk: DataFrame
    market: DataFrame
    distress: DataFrame
    lenders: DataFrame
    categories: DataFrame
    state_fips: DataFrame


def model_features(raw: RawTables, as_of: str | None = None, income_scale: int = 1000) -> DataFrame:
    """Decided applications with census, market, distress and lender data and decoded demographics."""
    apps = staging.filter_applications(staging.stage_lar(raw.lar, income_scale))
    apps = apps.filter(F.col("action_taken").isin(L.DECIDED_ACTIONS) & F.col("applicant_race").isNotNull())
    acs = settle(staging.stage_acs(raw.acs))
    yearly = settle(enrich.market_yearly(staging.stage_market(raw.market)))
    zips = enrich.best_zip(staging.stage_crosswalk(raw.crosswalk), yearly)
    lenders = staging.lender_dimension(raw.lenders, as_of).select(
        "lei",
        F.col("entity_name").alias("lender_entity_name"),
        F.col("registration_status").alias("lender_registration_status"),
        F.col("entity_age").alias("lender_entity_age"),
    )

    df = enrich.enrich_census(apps, acs, enrich.income_buckets(acs))
    df = enrich.enrich_market(df, zips, yearly)
    df = enrich.enrich_distress(df, settle(staging.stage_distress(raw.distress)))
    df = enrich.attach_upper(df, settle(lenders), "legal_entity_identifier", "lei")
    df = cleaning.decode(
        df,
        raw.categories,
        {
            "applicant_race_category": ("applicant_race", "applicant_race"),
            "applicant_ethnicity_category": ("applicant_ethnicity", "applicant_ethnicity"),
            "applicant_sex_category": ("applicant_sex", "applicant_sex"),
        },
    )
    df = df.withColumns(
        {
            "zip_code": L.or_unknown(F.col("zip_code")),
            "loan_approved": L.approved(F.col("action_taken")),
            "lender_entity_name": L.or_unknown(F.col("lender_entity_name"), "UNKNOWN"),
            "lender_registration_status": L.or_unknown(F.col("lender_registration_status"), "UNKNOWN"),
            "lender_entity_age": F.coalesce("lender_entity_age", F.lit(0)),
            "applicant_derived_racial_category": L.derived_race(
                F.col("applicant_ethnicity_category"), F.col("applicant_race_category")
            ),
        }
    )
    return enrich.fill_state(df, raw.state_fips)


def model_set(table: DataFrame) -> DataFrame:
    """The preprocessed table with last year's lender and tract rates, gaps and products.

    One join per entity: every group's rate, the overall rate and the gap ride on the same row.
    """
    lender = rates.prior_rates(
        table.filter(F.col("lender_entity_name").isNotNull()),
        "lender_entity_name",
        "lender_prior_approval_rate",
        overall="lender_prior_year_approval_rate",
        gap="lender_minority_gap",
    )
    tract = rates.prior_rates(table, "census_tract", "tract_prior_approval_rate", gap="tract_minority_gap")
    df = table.filter(F.col("loan_approved").isNotNull()).select(
        *CARRIED, "census_tract", "county_code", *[c for c in ("rn",) if c in table.columns]
    )
    df = rates.attach_prior(df, lender, "lender_entity_name")
    df = rates.attach_prior(df, tract, "census_tract")
    return features.interactions(df, features.POLYNOMIALS)


def validation_sample(table: DataFrame, n: int = 100_000, seed: int = 42) -> DataFrame:
    return sampling.sample_n_per_group(table, ["activity_year"], n, "loan_application_id", seed)


def training_sample(
    modelled: DataFrame, validation: DataFrame, target: int = 7_000_000, chunk: int = 600_000, seed: int = 42
) -> DataFrame:
    """Proportional sample by year and group without the validation rows, in numbered random chunks."""
    rest = enrich.exclude_ids(modelled, validation, "loan_application_id")
    return _chunked_sample(rest, target, chunk, seed)


def training_and_validation(
    modelled: DataFrame, n: int = 100_000, target: int = 7_000_000, chunk: int = 600_000, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """:func:`training_sample` and :func:`validation_sample` in one go, without joining wide rows by id."""
    validation, rest = sampling.hold_out_per_group(modelled, ["activity_year"], n, "loan_application_id", seed)
    return _chunked_sample(rest, target, chunk, seed), validation


def _chunked_sample(rest: DataFrame, target: int, chunk: int, seed: int) -> DataFrame:
    strata = ["activity_year", "applicant_derived_racial_category"]
    # another seed than the hold-out's, whose cut would otherwise skew what is left
    sample = sampling.stratified_sample(rest, strata, "loan_approved", target, "loan_application_id", seed + 1)
    return sampling.assign_chunks(sample, chunk, "loan_application_id", seed + 2)


def interleaved_training(table: DataFrame, chunk: int = 400_000, seed: int = 42, limit: int | None = None) -> DataFrame:
    """Target-encoded table with the classes alternating, in chunks."""
    kept = table.filter(F.col("loan_approved").isNotNull())
    encoded = rates.target_encode(kept, "lender_entity_name", "loan_approved", "lender_entity_name_te", table)
    return sampling.interleave(encoded, "loan_approved", chunk, "loan_application_id", seed, limit=limit)


AUDIT_TABLES = (
    "auc", "overall_scores", "yearly_scores", "fairness", "annual_rates", "calibration", "score_distribution", "redlining"
)


def audit(
    scored: DataFrame,
    table: DataFrame,
    zips: DataFrame,
    states: DataFrame,
    centroids: DataFrame,
    wanted: Sequence[str] = AUDIT_TABLES,
) -> Mapping[str, DataFrame]:
    """Fairness and redlining tables from scores and the preprocessed table.

    The score-to-application join is by a unique id and is settled once for all of them; only the
    ``wanted`` tables are prepared.
    """
    places = table.select("loan_application_id", "activity_year", "census_tract", "county_code")
    base = settle(scored.join(places, "loan_application_id"))
    race = rates.RACE
    known = base.filter(F.col(race) != L.UNKNOWN_GROUP)
    auc = cache(lambda: settle(fairness.auc_report(base)))
    counts = lambda: settle(fairness.group_counts(base, ["activity_year", race]))
    tracts = lambda: settle(fairness.tract_group_scores(base.withColumnRenamed(race, "race")))
    build = {
        "auc": auc,
        "overall_scores": lambda: fairness.model_scores(scored, auc()),
        "yearly_scores": lambda: fairness.model_scores(base, auc(), "activity_year"),
        "fairness": lambda: fairness.gap_vs_reference(fairness.fairness_metrics(counts())),
        "annual_rates": lambda: rates.annual_rates(known.withColumnRenamed(race, "race"), ["activity_year", "race"]),
        "calibration": lambda: fairness.calibration(scored),
        "score_distribution": lambda: fairness.score_histogram(known, [race, "activity_year", "actual_value"]),
        "redlining": lambda: fairness.attach_places(fairness.redlining(tracts()), zips, states, centroids),
    }
    return {name: build[name]() for name in wanted}


def counterfactual_audit(results: DataFrame, table: DataFrame, centroids: DataFrame) -> DataFrame:
    places = table.select("loan_application_id", "census_tract", "county_code")
    per_tract = fairness.counterfactual_by_tract(results.join(places, "loan_application_id"))
    return fairness.attach_centroid(per_tract, centroids)
