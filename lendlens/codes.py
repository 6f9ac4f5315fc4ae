"""Published code lists of the loan application register, as data.

Fixed values throughout: labels and codes have to equal the register's. ``None`` means the code
carries no information. A list under ``CODED`` is (labels by code, cleaned value by code); a code
absent from the second map keeps its number.
"""

EXEMPT = 1111

ACTION_TAKEN = {
    1: "Origination",
    2: "Fallout",
    3: "Denied",
    4: "Fallout",
    5: "Fallout",
    6: "Purchased - Secondary Market",
    7: "Preapproval - Denial",
    8: "Preapproval - Approved not accepted",
}
PURCHASER = {
    0: "Portfolio",
    1: "GSE",
    2: "Government",
    3: "GSE",
    5: "Private",
    6: "Depository",
    7: "Private",
    8: "Affiliate",
}
LOAN_TYPE = {1: "Conventional", 2: "FHA", 3: "VA", 4: "USDA"}
LOAN_PURPOSE = {1: "Home Purchase", 2: "Home Improvement", 31: "Refinancing", 32: "Refinancing"}
LIEN_STATUS = {1: "First Lien", 2: "Subordinate Lien"}
HOEPA_STATUS = {1: "High Cost Mortgage", 2: "Not a High Cost Mortgage"}
CONSTRUCTION_METHOD = {1: "Site-built", 2: "Manufactured Home"}
OCCUPANCY_TYPE = {1: "Principal Residence", 2: "Second Residence", 3: "Investment Property"}
HOME_SECURED_PROPERTY = {1: "Manufactured home and land", 2: "Manufactured Home - Not Land"}
HOME_LAND_INTEREST = {
    1: "Direct Ownership",
    2: "Indirect Ownership",
    3: "Paid Leasehold",
    4: "Unpaid Leasehold",
}
CREDIT_MODEL = {
    1: "Equifax Beacon 5.0",
    2: "Experian Fair Isaac",
    3: "FICO Risk Score Classic 04",
    4: "FICO Risk Score Classic 98",
    5: "VantageScore 2.0",
    6: "VantageScore 3.0",
    7: "More than one credit score model",
    8: "Other credit scoring model",
}
ETHNICITY = {
    1: "Hispanic or Latino",
    2: "Not Hispanic or Latino",
    11: "Mexican",
    12: "Puerto Rican",
    13: "Cuban",
    14: "Other Hispanic or Latino",
}
RACE = {
    1: "American Indian or Alaska Native",
    2: "Asian",
    21: "Asian Indian",
    22: "Chinese",
    23: "Filipino",
    24: "Japanese",
    25: "Korean",
    26: "Vietnamese",
    27: "Other Asian",
    3: "Black or African American",
    4: "Native Hawaiian or Other Pacific Islander",
    41: "Native Hawaiian",
    42: "Guamanian or Chamorro",
    43: "Samoan",
    44: "Other Pacific Islander",
    5: "White",
}
# Fixed values. American Indian or Alaska Native applicants are grouped with AAPI; pass another map to change it.
RACE_GROUP = {
    1: "AAPI",
    2: "AAPI",
    21: "AAPI",
    22: "AAPI",
    23: "AAPI",
    24: "AAPI",
    25: "AAPI",
    26: "AAPI",
    27: "AAPI",
    3: "Black",
    4: "AAPI",
    41: "AAPI",
    42: "AAPI",
    43: "AAPI",
    44: "AAPI",
    5: "White",
}
SEX = {1: "Male", 2: "Female", 6: "Male and Female"}
AUS = {
    1: "Desktop Underwriter",
    2: "Loan Prospector or Loan Product Advisor",
    3: "Technology Open to Approved Lenders",
    4: "Guaranteed Underwriting System",
    5: "Other",
    7: "Internal Proprietary System",
    EXEMPT: "Exempt",
}
DENIAL_REASON = {
    1: "Debt to Income Ratio",
    2: "Employment History",
    3: "Credit History",
    4: "Collateral",
    5: "Insufficient cash - downpayment or closing costs",
    6: "Unverifiable Information",
    7: "Credit application incomplete",
    8: "Mortgage insurance denied",
    9: "Other",
}
LATINX_ETHNICITIES = [1, 11, 12, 13, 14]
AAPI_RACES = [2, 4, 21, 22, 23, 24, 25, 26, 27]

_YES_NO = {1: 1, 2: 0, 3: None, 4: None, EXEMPT: None}


# Labels of yes/no codes.
_ETHNICITY_SEEN = ({1: "Ethnicity Collected on Basis of Observation", 2: "Ethnicity Not Based on Observation"}, _YES_NO)
_SEEN = ({1: "Collected on basis of visual observation", 2: "Not Collected on basis of visual observation"}, _YES_NO)
_SEX_CODES = {3: None, 4: None, 5: None, 6: 3}

#: column → (labels by code, cleaned value by code)
CODED: dict[str, tuple[dict, dict]] = {
    "reverse_mortgage": ({1: "Reverse Mortgage", 2: "Not Reverse Mortgage"}, _YES_NO),
    "open_end_line_of_credit": ({1: "Open Line Of Credit", 2: "Not Open Line Of Credit"}, _YES_NO),
    "business_or_commercial_purpose": ({1: "Business Purpose", 2: "Not Business Purpose"}, _YES_NO),
    "hoepa_status": (HOEPA_STATUS, _YES_NO),
    "negative_amortization": ({1: "Negative Amortization Features", 2: "No Negative Amortization Features"}, _YES_NO),
    "interest_only_payment": ({1: "Interest-Only Payments", 2: "No Interest-Only Payments"}, _YES_NO),
    "balloon_payment": ({1: "Balloon Payment", 2: "No Balloon Payment"}, _YES_NO),
    "other_nonamortizing_features": ({1: "Other non-fully amortizing features", 2: "No other non-fully amortizing features"}, _YES_NO),
    "construction_method": (CONSTRUCTION_METHOD, {}),
    "occupancy_type": (OCCUPANCY_TYPE, {}),
    "manufactured_home_secured_property_type": (HOME_SECURED_PROPERTY, {3: None, EXEMPT: None}),
    "manufactured_home_land_property_interest": (HOME_LAND_INTEREST, {5: None, EXEMPT: None}),
    "applicant_credit_score_type": (CREDIT_MODEL, {9: None, EXEMPT: None}),
    "co_applicant_credit_score_type": ({**CREDIT_MODEL, 9: "No Co-Applicant"}, {9: None, EXEMPT: None}),
    "applicant_ethnicity_observed": _ETHNICITY_SEEN,
    "co_applicant_ethnicity_observed": _ETHNICITY_SEEN,
    "applicant_race_observed": _SEEN,
    "co_applicant_race_observed": _SEEN,
    "applicant_sex": (SEX, _SEX_CODES),
    "co_applicant_sex": (SEX, _SEX_CODES),
    "applicant_sex_observed": _SEEN,
    "co_applicant_sex_observed": _SEEN,
    "submission_of_application": (
        {1: "Submitted directly to institution", 2: "Not Submitted to institution", EXEMPT: "Exempt"},
        _YES_NO,
    ),
    "initially_payable_to_institution": (
        {1: "Initially Payable to Institution", 2: "Not Initially Payable to Institution", EXEMPT: "Exempt"},
        _YES_NO,
    ),
    **{f"aus_{i}": (AUS, {6: None, EXEMPT: None}) for i in range(1, 6)},
    **{f"denial_reason_{i}": (DENIAL_REASON, {10: None}) for i in range(1, 5)},
    **{f"{who}_ethnicity_{i}": (ETHNICITY, {3: None, 4: None}) for who in ("applicant", "co_applicant") for i in range(1, 6)},
    **{f"{who}_race_{i}": (RACE, {6: None, 7: None, 8: None}) for who in ("applicant", "co_applicant") for i in range(1, 6)},
}

#: columns that only gain a label
LABELLED: dict[str, tuple[str, dict]] = {
    "action_taken": ("action_taken_category", ACTION_TAKEN),
    "purchaser_type": ("purchaser_category", PURCHASER),
    "loan_type": ("loan_type_category", LOAN_TYPE),
    "loan_purpose": ("loan_purpose_category", LOAN_PURPOSE),
    "lien_status": ("lien_status_category", LIEN_STATUS),
}
