"""Landed tables to typed staging tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.lending import FILTERED_ACTIONS
from lendlens.functions.numbers import calendar_years, share_pct
from lendlens.functions.text import not_exempt, pad_code, part, surrogate_key, to_whole
from lendlens.operators.ranks import best_row
from lendlens.operators.schema import each_column

# The fields that identify an application.
KEY_FIELDS = (
    "activity_year action_taken lei state_code county_code census_tract loan_amount income "
    "applicant_ethnicity_1 applicant_race_1 applicant_sex"
).split()
# Property types kept from the market tracker, and its period.
MARKET_PROPERTY_TYPES = [6, 13]
MARKET_PERIOD = ("2018-01-01", "2024-01-31")


def stage_lar(raw: DataFrame, income_scale: int = 1000) -> DataFrame:
    """Raw all-text register rows to typed applications, one row per application key.

    Works for any number of years at once. Duplicates are resolved by a total order over the whole
    row, so a rerun keeps the same row. ``raw`` is read once and its rows are shuffled once, by key, however many repeat.
    """
    c = F.col
    whole = lambda name: to_whole(c(name), "int")
    unless_1111 = lambda name: F.when(c(name) != "1111", whole(name))
    age = lambda name: F.when(~c(name).isin("8888", "9999"), c(name))
    pricing = lambda name, kind: not_exempt(c(name)).try_cast(kind).alias(name)
    income = to_whole(c("income"))
    staged = raw.select(
        surrogate_key(KEY_FIELDS).alias("loan_application_id"),
        whole("activity_year").alias("activity_year"),
        c("lei").alias("legal_entity_identifier"),
        whole("action_taken").alias("action_taken"),
        whole("derived_msa_md").alias("derived_msa_md"),
        "state_code",
        "county_code",
        pad_code(c("census_tract"), 11).alias("census_tract"),
        # amounts outgrow 32 bits
        *each_column(["loan_amount", "property_value"], lambda x: to_whole(c(x)).alias(x)),
        *each_column(
            ["loan_type", "loan_purpose", "lien_status", "construction_method", "occupancy_type"], lambda x: whole(x).alias(x)
        ),
        whole("applicant_race_1").alias("applicant_race"),
        whole("applicant_ethnicity_1").alias("applicant_ethnicity"),
        whole("applicant_sex").alias("applicant_sex"),
        age("applicant_age").alias("applicant_age"),
        F.when(income != 0, income * income_scale).alias("income"),
        not_exempt(c("debt_to_income_ratio")).alias("debt_to_income_ratio"),
        pricing("interest_rate", "double"),
        pricing("rate_spread", "double"),
        *[
            pricing(x, "decimal(18,2)")
            for x in "origination_charges lender_credits discount_points total_loan_costs total_points_and_fees".split()
        ],
        *[
            unless_1111(x).alias(x)
            for x in (
                "negative_amortization interest_only_payment balloon_payment other_nonamortizing_features"
            ).split()
        ],
        to_whole(not_exempt(c("prepayment_penalty_term")), "int").alias("prepayment_penalty_term"),
        *[unless_1111(f"aus_{i}").alias(f"aus_{i}") for i in range(1, 5)],
        whole("co_applicant_race_1").alias("co_applicant_race"),
        whole("co_applicant_ethnicity_1").alias("co_applicant_ethnicity"),
        whole("co_applicant_sex").alias("co_applicant_sex"),
        age("co_applicant_age").alias("co_applicant_age"),
        unless_1111("submission_of_application").alias("submission_of_application"),
        unless_1111("initially_payable_to_institution").alias("initially_payable_to_institution"),
        whole("preapproval").alias("preapproval"),
    )
    return best_row(staged, ["loan_application_id"], [c("activity_year")]).select(*staged.columns)


def collapsed_count(raw: DataFrame) -> DataFrame:
    """How many rows share each application key with another row."""
    keyed = raw.groupBy(surrogate_key(KEY_FIELDS).alias("loan_application_id")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(
        F.count_if(F.col("n") > 1).alias("keys_with_duplicates"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_collapsed"),
    )


def stage_acs(raw: DataFrame) -> DataFrame:
    """Census rows with percentages, codes and the eleven-digit tract id."""
    total = F.col("total_population")
    counts = (
        "white_population black_population latinx_population bachelors_degree_population "
        "graduate_degree_population high_school_diploma_population total_population_below_poverty_level "
        "total_population_receiving_federal_assistance"
    ).split()
    minority = total - F.col("white_population")
    bachelors = F.col("bachelors_degree_population") + F.col("graduate_degree_population")
    codes: dict[str, Column] = {
        "state_fips": pad_code(F.col("state"), 2),
        "county_fips": pad_code(F.col("county"), 3),
        "tract_fips": pad_code(F.col("tract"), 6),
    }
    return raw.select(
        "name",
        "total_population",
        *counts,
        *[share_pct(F.col(x), total).alias(f"{x}_pct") for x in counts],
        minority.alias("minority_population"),
        share_pct(minority, total).alias("minority_population_pct"),
        F.when(F.col("median_household_income") >= 0, F.col("median_household_income")).alias("median_household_income"),
        "median_home_value",
        share_pct(bachelors, total).alias("pct_bachelors_or_higher"),
        "gini_index_of_income_inequality",
        *[x.alias(n) for n, x in codes.items()],
        F.concat(*codes.values()).alias("census_tract"),
    )


def stage_market(
    raw: DataFrame,
    property_types: Sequence[int] = tuple(MARKET_PROPERTY_TYPES),
    period: tuple[str, str] | None = MARKET_PERIOD,
) -> DataFrame:
    """Market tracker rows of the wanted property types and period, zip and metro city split out.

    ``period`` bounds period_begin from below and period_end from above, both exclusive; None keeps all.
    """
    day = lambda n: F.to_date(F.try_to_timestamp(F.col(n), F.lit("yyyy-MM-dd")))
    renames = {
        "median_sale_price_yoy": "median_sale_price_year_over_year",
        "median_list_price_yoy": "median_list_price_year_over_year",
        "median_ppsf": "median_price_per_square_foot",
        "median_ppsf_yoy": "median_price_per_square_foot_year_over_year",
        "median_dom": "median_days_on_market",
    }
    measures = (
        "median_sale_price median_sale_price_yoy median_list_price median_list_price_yoy median_ppsf "
        "median_ppsf_yoy inventory new_listings median_dom homes_sold pending_sales price_drops "
        "avg_sale_to_list off_market_in_two_weeks"
    ).split()
    staged = (
        raw.filter(F.col("property_type_id").cast("int").isin(list(property_types)))
        .select(
            day("period_begin").alias("period_begin"),
            day("period_end").alias("period_end"),
            part(F.trim("region"), ":", 3).alias("zip_code"),
            "state_code",
            part(F.col("parent_metro_region"), ",", 2).alias("parent_metro_region_city"),
            "property_type",
            F.col("property_type_id").cast("int").alias("property_type_id"),
            *[F.col(m).cast("double").alias(renames.get(m, m)) for m in measures],
        )
    )
    if period is None:
        return staged
    return staged.filter((F.col("period_begin") > period[0]) & (F.col("period_end") < period[1]))


def stage_distress(raw: DataFrame) -> DataFrame:
    return raw.select("report_year", F.col("tract_fips").alias("census_tract"), "is_distressed", "is_underserved")


def stage_crosswalk(raw: DataFrame) -> DataFrame:
    return raw.select("census_tract", "zip_code", "city_name", "state_name", "residential_ratio")


def lender_dimension(raw: DataFrame, as_of: str | None = None) -> DataFrame:
    """Lender names, status and age in calendar years at ``as_of`` (today by default)."""
    day = lambda n: F.to_date(F.try_to_timestamp(F.substring(F.col(n), 1, 10), F.lit("yyyy-MM-dd")))
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return raw.filter(F.col("lei").isNotNull()).select(
        "lei",
        F.upper("entity_name").alias("entity_name"),
        F.upper("registration_status").alias("registration_status"),
        day("registration_initial_date").alias("registration_initial_date"),
        calendar_years(day("registration_initial_date"), today).alias("entity_age"),
        day("registration_last_update").alias("registration_last_update"),
    )


def filter_applications(apps: DataFrame, actions: Sequence[int] = tuple(FILTERED_ACTIONS)) -> DataFrame:
    return apps.filter(
        F.col("action_taken").isin(list(actions)) & F.col("loan_amount").isNotNull() & F.col("income").isNotNull()
    )
