"""Schemas of landed and cleaned tables. Column names and types are fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


LAR_TEXT_COLUMNS = [
    "activity_year",
    "action_taken",
    "lei",
    "state_code",
    "county_code",
    "census_tract",
    "derived_msa_md",
    "loan_amount",
    "property_value",
    "income",
    "loan_type",
    "loan_purpose",
    "lien_status",
    "construction_method",
    "occupancy_type",
    "preapproval",
    "applicant_race_1",
    "applicant_ethnicity_1",
    "applicant_sex",
    "applicant_age",
    "co_applicant_race_1",
    "co_applicant_ethnicity_1",
    "co_applicant_sex",
    "co_applicant_age",
    "debt_to_income_ratio",
    "interest_rate",
    "rate_spread",
    "origination_charges",
    "lender_credits",
    "discount_points",
    "total_loan_costs",
    "total_points_and_fees",
    "negative_amortization",
    "interest_only_payment",
    "balloon_payment",
    "other_nonamortizing_features",
    "prepayment_penalty_term",
    "aus_1",
    "aus_2",
    "aus_3",
    "aus_4",
    "submission_of_application",
    "initially_payable_to_institution",
]

PIPE_LAR_COLUMNS = [
    "activity_year",
    "legal_entity_identifier",
    "loan_type",
    "loan_purpose",
    "preapproval",
    "construction_method",
    "occupancy_type",
    "loan_amount",
    "action_taken",
    "property_state",
    "property_county",
    "census_tract",
    "borrower_one_ethnicity",
    "borrower_two_ethnicity",
    "borrower_three_ethnicity",
    "borrower_four_ethnicity",
    "borrower_five_ethnicity",
    "co_borrower_one_ethnicity",
    "co_borrower_two_ethnicity",
    "co_borrower_three_ethnicity",
    "co_borrower_four_ethnicity",
    "co_borrower_five_ethnicity",
    "borrower_ethnicity_based_on_obs",
    "co_borrower_ethnicity_based_on_obs",
    "borrower_one_race",
    "borrower_two_race",
    "borrower_three_race",
    "borrower_four_race",
    "borrower_five_race",
    "co_borrower_one_race",
    "co_borrower_two_race",
    "co_borrower_three_race",
    "co_borrower_four_race",
    "co_borrower_five_race",
    "borrower_race_based_on_obs",
    "co_borrower_race_based_on_obs",
    "borrower_gender",
    "co_borrower_gender",
    "borrower_gender_based_on_obs",
    "co_borrower_gender_based_on_obs",
    "borrower_age",
    "is_borrower_62_or_older",
    "co_borrower_age",
    "is_co_borrower_62_or_older",
    "income",
    "type_of_purchaser",
    "rate_spread",
    "hoepa_status",
    "lien_status",
    "borrower_credit_score_model",
    "co_borrower_credit_score_model",
    "reason_for_denial_one",
    "reason_for_denial_two",
    "reason_for_denial_three",
    "reason_for_denial_four",
    "total_loan_costs",
    "total_points_and_fees",
    "origination_charges",
    "discount_points",
    "lender_credits",
    "interest_rate",
    "prepayment_penalty_term",
    "debt_to_income_ratio",
    "combined_loan_to_value_ratio",
    "loan_term_months",
    "intro_rate_period",
    "balloon_payment",
    "interest_only_payments",
    "negative_amortization",
    "other_non_amortizing_features",
    "property_value",
    "manufactured_home_property_type",
    "manufactured_home_land_property_interest",
    "total_units",
    "multifamily_affordable_units",
    "submission_of_application",
    "is_init_payable_to_institution",
    "auto_underwriting_system_one",
    "auto_underwriting_system_two",
    "auto_underwriting_system_three",
    "auto_underwriting_system_four",
    "auto_underwriting_system_five",
    "is_reverse_mortgage",
    "is_open_end_line_of_credit",
    "is_for_business_purpose",
]

CENSUS_CODES = {
    "B03002_001E": "total_population",
    "B03002_003E": "white_population",
    "B03002_004E": "black_population",
    "B03002_012E": "latinx_population",
    "B19013_001E": "median_household_income",
    "B25077_001E": "median_home_value",
    "B15003_022E": "bachelors_degree_population",
    "B15003_023E": "graduate_degree_population",
    "B15003_017E": "high_school_diploma_population",
    "B17001_002E": "total_population_below_poverty_level",
    "B22010_002E": "total_population_receiving_federal_assistance",
    "B19083_001E": "gini_index_of_income_inequality",
}
CROSSWALK_NAMES = {
    "tract": "census_tract",
    "geoid": "zip_code",
    "res_ratio": "residential_ratio",
    "bus_ratio": "business_ratio",
    "oth_ratio": "other_ratio",
    "tot_ratio": "total_ratio",
    "city": "city_name",
    "state": "state_name",
}
STATE_FIPS = "fips string, usps string, state_name string, gnisid string"
COUNTY_FIPS = (
    "state_abbr string, state_fips_cd string, county_fips_cd string, county_ns_cd string, "
    "county_name string, fips_class_cd string, functional_status string"
)
LEI_RESPONSE = (
    "data struct<attributes: struct<"
    "entity: struct<legalName: struct<name: string>, legalJurisdiction: string, "
    "entityCategory: string, headquartersAddress: struct<addressLines: array<string>>>, "
    "registration: struct<status: string, initialRegistrationDate: string, lastUpdateDate: string>, "
    "bic: string>>"
)
CROSSWALK_RESPONSE = (
    "data struct<results: array<struct<tract: string, geoid: string, res_ratio: double, "
    "bus_ratio: double, oth_ratio: double, tot_ratio: double, city: string, state: string>>>"
)
SCORED = (
    "loan_application_id string, applicant_derived_racial_category string, applicant_age string, "
    "actual_value int, score double, predicted_label int"
)
COUNTERFACTUAL = (
    "loan_application_id string, original_race string, new_race string, previous_score double, "
    "counterfactual_score double, score_change double"
)
MODEL_PERFORMANCE = "activity_year int, auc_roc double"
TRAINING_LOG = (
    "experiment_name string, sample_size bigint, number_of_training_trials bigint, model_name string, "
    "best_params string, auc double, accuracy double, f1 double, dpd double, eod double, used_strata int"
)
SHAP_LOG = (
    "feature string, mean_shap_value double, experiment_name string, model_name string, chunk_offset int"
)
IMPORTANCE_LOG = (
    "feature string, importance double, experiment_name string, model_name string, chunk_offset int"
)

_PEOPLE = ("applicant", "co_applicant")


def _numbered(stem: str, n: int) -> list[str]:
    return [f"{stem}_{i}" for i in range(1, n + 1)]


def _coded(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, _L) for n in names] + [(f"{n}_category", _S) for n in names]


def canonical_lar() -> T.StructType:
    """Schema every cleaned register file has to have, by family."""
    fields: list[tuple[str, T.DataType]] = [("activity_year", _L)]
    fields += [(n, _S) for n in "lei derived_msa_md state_code county_code".split()]
    fields += [("conforming_loan_limit", _L)]
    fields += [
        (n, _D)
        for n in (
            "loan_to_value_ratio combined_loan_to_value_ratio effective_ltv interest_rate rate_spread income"
        ).split()
    ]
    fields += [(n, _L) for n in "loan_term prepayment_penalty_term intro_rate_period".split()]
    fields += [
        (n, _D)
        for n in "total_loan_costs total_points_and_fees origination_charges discount_points lender_credits".split()
    ]
    fields += _coded(
        "negative_amortization", "interest_only_payment", "balloon_payment", "other_nonamortizing_features"
    )
    fields += [("property_value", _L)]
    fields += _coded(
        "construction_method",
        "occupancy_type",
        "manufactured_home_secured_property_type",
        "manufactured_home_land_property_interest",
    )
    fields += [("multifamily_affordable_units", _L)]
    fields += _coded("applicant_credit_score_type", "co_applicant_credit_score_type")
    for who in _PEOPLE:
        fields += _coded(*_numbered(f"{who}_ethnicity", 5))
    for who in _PEOPLE:
        races = _numbered(f"{who}_race", 5)
        fields += _coded(*races) + [(f"{r}_category_grouped", _S) for r in races]
    for trait in ("ethnicity", "race"):
        fields += _coded(*[f"{who}_{trait}_observed" for who in _PEOPLE])
    fields += _coded(*[f"{who}_sex" for who in _PEOPLE])
    fields += _coded(*[f"{who}_sex_observed" for who in _PEOPLE])
    fields += [(f"{who}_age", _S) for who in _PEOPLE]
    fields += [(f"{who}_age_above_62", _L) for who in _PEOPLE]
    fields += _coded("submission_of_application", "initially_payable_to_institution")
    fields += _coded(*_numbered("aus", 5)) + _coded(*_numbered("denial_reason", 4))
    return T.StructType([T.StructField(n, t) for n, t in fields])
