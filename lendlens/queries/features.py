from pyspark.sql import functions as F

from lendlens.functions import lending as L, numbers as N
from lendlens.functions.text import joined_label, swap_group
from lendlens.operators import features, quantiles
from lendlens.operators.enrich import income_buckets
from lendlens.queries.registry import query
from lendlens.queries.standin import LOANS, RACE, loans, table

ID = "loan_application_id"
_DTI = """CASE debt_to_income_ratio WHEN '<20%' THEN 20.0 WHEN '30%-<36%' THEN 30.0 WHEN '41' THEN 41.0
  WHEN '>60%' THEN 60.0 END::DOUBLE"""


@query(
    "dti_parse",
    LOANS
    + """SELECT loan_application_id, CASE WHEN regexp_matches(debt_to_income_ratio, '[<%-]')
      THEN try_cast(nullif(regexp_extract(debt_to_income_ratio, '\\d+'), '') AS DOUBLE)
      ELSE try_cast(debt_to_income_ratio AS DOUBLE) END AS dti,
    CASE WHEN debt_to_income_ratio = 'Exempt' THEN NULL WHEN debt_to_income_ratio = '41' THEN '40%-<46%'
      ELSE debt_to_income_ratio END AS dti_band FROM loans""",
)
def _(spark, sf):
    raw = F.col("debt_to_income_ratio")
    return loans(spark, sf).select(ID, L.dti_number(raw).alias("dti"), L.dti_band(raw).alias("dti_band"))


@query(
    "value_bins",
    LOANS
    + f""", x AS (SELECT *, {_DTI} AS dti, (loan_application_id % 70)::DOUBLE / 100 AS gini,
      (loan_application_id % 65)::DOUBLE AS bachelors FROM loans)
    SELECT loan_application_id,
      CASE WHEN dti >= 0 AND dti < 30 THEN 'Low' WHEN dti >= 30 AND dti < 40 THEN 'Medium'
        WHEN dti >= 40 AND dti < 50 THEN 'High' WHEN dti >= 50 AND dti < 100 THEN 'Very High' END AS dti_bin,
      CASE WHEN minority_population_pct < 20 THEN 'Low Minority' WHEN minority_population_pct < 50
        THEN 'Moderate Minority' WHEN minority_population_pct < 80 THEN 'High Minority'
        ELSE 'Very High Minority' END AS minority_pct_bin,
      CASE WHEN gini < 0.3::DOUBLE THEN 'Low Inequality' WHEN gini < 0.5 THEN 'Moderate Inequality'
        ELSE 'High Inequality' END AS gini_bin,
      CASE WHEN bachelors < 15 THEN 'Low' WHEN bachelors < 30 THEN 'Moderate' WHEN bachelors < 50 THEN 'High'
        ELSE 'Very High' END AS bachelors_bin,
      CASE WHEN loan_application_id % 7 = 0 THEN 'Unknown' WHEN loan_application_id % 7 <= 4
        THEN CAST(loan_application_id % 7 AS VARCHAR) ELSE '5+' END AS units
    FROM x""",
)
def _(spark, sf):
    seven = F.col(ID) % 7
    return loans(spark, sf).select(
        ID,
        L.dti_bin(L.dti_number(F.col("debt_to_income_ratio"))).alias("dti_bin"),
        L.minority_bin(F.col("minority_population_pct")).alias("minority_pct_bin"),
        L.gini_bin((F.col(ID) % 70).cast("double") / 100).alias("gini_bin"),
        L.bachelors_bin((F.col(ID) % 65).cast("double")).alias("bachelors_bin"),
        L.units_bucket(F.when(seven != 0, seven.cast("string"))).alias("units"),
    )


_CHAIN = [["zip_code", "loan_purpose"], ["zip_code"], ["loan_purpose"], []]


@query(
    "impute_property_value",
    LOANS
    + """, zp AS (SELECT zip_code, loan_purpose, median(property_value) AS m1 FROM loans GROUP BY 1, 2),
    z AS (SELECT zip_code, median(property_value) AS m2 FROM loans GROUP BY 1),
    p AS (SELECT loan_purpose, median(property_value) AS m3 FROM loans GROUP BY 1)
    SELECT loan_application_id, coalesce(property_value, m1, m2, m3, (SELECT median(property_value) FROM loans))
      AS property_value FROM loans LEFT JOIN zp USING (zip_code, loan_purpose) LEFT JOIN z USING (zip_code)
      LEFT JOIN p USING (loan_purpose)""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "zip_code", "loan_purpose", "property_value")
    return features.impute_hierarchical(df, {"property_value": _CHAIN}).select(ID, "property_value")


_GRAINS = {
    "zip_purpose": (["zip_code", "loan_purpose"], ["property_value", "loan_amount"]),
    "county": (["state_code", "county_code"], ["property_value", "loan_amount"]),
    "state": (["state_code"], ["property_value", "loan_amount"]),
    "all": ([], ["property_value", "loan_amount"]),
}


@query(
    "grouped_medians",
    LOANS
    + """SELECT 'zip_purpose' AS grain, zip_code AS k0, CAST(loan_purpose AS VARCHAR) AS k1,
      median(property_value) AS median_property_value, median(loan_amount) AS median_loan_amount
      FROM loans GROUP BY 2, 3
    UNION ALL SELECT 'county', state_code, county_code, median(property_value), median(loan_amount) FROM loans GROUP BY 2, 3
    UNION ALL SELECT 'state', state_code, NULL, median(property_value), median(loan_amount) FROM loans GROUP BY 2
    UNION ALL SELECT 'all', NULL, NULL, median(property_value), median(loan_amount) FROM loans""",
)
def _(spark, sf):
    medians = quantiles.grouped_medians(loans(spark, sf), _GRAINS)
    out = None
    for name, (keys, _) in _GRAINS.items():
        slots = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (2 - len(keys))
        part = medians[name].select(
            F.lit(name).alias("grain"), slots[0].alias("k0"), slots[1].alias("k1"),
            "median_property_value", "median_loan_amount",
        )
        out = part if out is None else out.unionByName(part)
    return out


_CAPPED = ["loan_amount", "property_value", "income"]
_Q = ", ".join(
    f"round(quantile_cont({c}::DOUBLE, 0.01), 6) AS {c}_lower_cap, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS {c}_upper_cap"
    for c in _CAPPED
)


def _capped_sql(c):
    return (
        f"CASE WHEN {c} IS NULL THEN {c}_lower_cap WHEN {c} < {c}_lower_cap THEN {c}_lower_cap "
        f"WHEN {c} > {c}_upper_cap THEN {c}_upper_cap ELSE {c} END::DOUBLE AS {c}_capped"
    )


def _rounded_caps(df):
    """Interpolated percentiles may differ between engines in the last bit."""
    caps = features.percentile_caps(df, _CAPPED)
    return caps.select(*[F.round(c, 6).alias(c) for c in caps.columns])


@query("percentile_caps", LOANS + f"SELECT {_Q} FROM loans")
def _(spark, sf):
    return _rounded_caps(loans(spark, sf))


@query(
    "caps_winsorise",
    LOANS + f", q AS (SELECT {_Q} FROM loans) SELECT loan_application_id, {', '.join(map(_capped_sql, _CAPPED))} FROM loans, q",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, *_CAPPED)
    caps = features.constants(_rounded_caps(df))
    return df.select(
        ID, *[N.winsorise(F.col(c), caps[f"{c}_lower_cap"], caps[f"{c}_upper_cap"]).alias(f"{c}_capped") for c in _CAPPED]
    )


@query(
    "log_features",
    LOANS
    + "SELECT loan_application_id, "
    + ", ".join(
        f"round(CASE WHEN {c} > -1 THEN ln(1 + {c}::DOUBLE) ELSE 0 END, 6) AS {c}_log, "
        f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_log_missing_flag"
        for c in _CAPPED
    )
    + " FROM loans",
)
def _(spark, sf):
    out = []
    for c in _CAPPED:
        out += [F.round(N.safe_log1p(F.col(c)), 6).alias(f"{c}_log"), N.missing_flag(F.col(c)).alias(f"{c}_log_missing_flag")]
    return loans(spark, sf).select(ID, *out)


@query(
    "quartile_labels",
    LOANS
    + """, q AS (SELECT quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.5) AS q2,
      quantile_cont(income, 0.75) AS q3 FROM (SELECT income::DOUBLE AS income FROM loans))
    SELECT loan_application_id, CASE WHEN income < q1 THEN 'Low' WHEN income < q2 THEN 'Med-Low'
      WHEN income < q3 THEN 'Med-High' ELSE 'High' END AS income_bin FROM loans, q""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "income")
    cuts = features.constants(features.quartile_cuts(df, ["income"]))
    return df.select(ID, N.quartile_label(F.col("income"), [cuts[f"income_q{i}"] for i in (1, 2, 3)]).alias("income_bin"))


@query(
    "income_ntile",
    LOANS
    + """, t AS (SELECT census_tract, median(median_household_income) AS median_household_income FROM loans GROUP BY 1)
    SELECT *, CAST(ntile(4) OVER (ORDER BY median_household_income NULLS LAST, census_tract) AS INTEGER) AS income_bucketed
    FROM t""",
)
def _(spark, sf):
    df = loans(spark, sf)
    medians = quantiles.grouped_medians(df, {"t": (["census_tract"], ["median_household_income"])})["t"]
    tracts = df.select("census_tract").distinct().join(medians, "census_tract", "left")
    return income_buckets(tracts.withColumnRenamed("median_median_household_income", "median_household_income"))


@query(
    "prior_rate_history",
    LOANS
    + """, y AS (SELECT census_tract, activity_year, sum(loan_approved) AS a, count(*) AS n FROM loans GROUP BY 1, 2)
    SELECT census_tract, activity_year, CAST(sum(a) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE)
      AS prior_approval_rate FROM y
    WINDOW w AS (PARTITION BY census_tract ORDER BY activity_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(spark, sf):
    return features.prior_rate_history(loans(spark, sf))


@query(
    "interaction_labels",
    LOANS
    + f"""SELECT loan_application_id, coalesce({RACE}, 'Unknown') || '_' || coalesce(applicant_sex_category, 'Unknown')
      AS race_sex_interaction, {RACE} || '_' || state_code AS race_state_interaction,
      replace({RACE} || '_' || state_code, {RACE}, 'BUILDING') AS swapped,
      CASE WHEN is_distressed = 1 THEN 1 ELSE 0 END AS is_distressed FROM loans""",
)
def _(spark, sf):
    race = F.col(RACE)
    state = joined_label(race, F.col("state_code"))
    return loans(spark, sf).select(
        ID,
        joined_label(race, F.col("applicant_sex_category")).alias("race_sex_interaction"),
        state.alias("race_state_interaction"),
        swap_group(state, race, F.lit("BUILDING")).alias("swapped"),
        F.coalesce("is_distressed", F.lit(0)).alias("is_distressed"),
    )


@query(
    "category_groups",
    LOANS
    + f"""SELECT loan_application_id, CASE loan_purpose WHEN 1 THEN 'Home Purchase' WHEN 2 THEN 'Home Improvement'
      WHEN 4 THEN 'Other' ELSE 'Refinancing' END AS loan_purpose_grouped,
      CASE WHEN applicant_sex_category IN ('Male', 'Female') THEN applicant_sex_category
        WHEN applicant_sex_category = 'information not provided' THEN 'Unknown' ELSE 'Other' END AS sex_group,
      CASE WHEN lender_entity_name = 'L3' THEN 'OTHER' ELSE 'ISSUED' END AS registration,
      coalesce(applicant_sex_category, 'Unknown') AS sex_or_unknown,
      CASE WHEN {RACE} = 'HOUSEHOLD' THEN 'not a match' WHEN {RACE} = 'FURNITURE' THEN 'Latinx'
        WHEN loan_application_id % 3 = 0 THEN NULL ELSE {RACE} END AS derived_group
    FROM loans""",
)
def _(spark, sf):
    race = F.col(RACE)
    status = F.when(F.col("lender_entity_name") == "L3", "retired").otherwise("Issued")
    label = F.when(F.col(ID) % 3 == 0, "not provided").otherwise(race)
    ethnicity = F.when(race == "HOUSEHOLD", "other").when(race == "FURNITURE", "Latinx").otherwise("not applicable")
    return loans(spark, sf).select(
        ID,
        L.purpose_group(F.col("loan_purpose")).alias("loan_purpose_grouped"),
        L.sex_group(F.col("applicant_sex_category")).alias("sex_group"),
        L.registration_group(status).alias("registration"),
        L.or_unknown(F.col("applicant_sex_category")).alias("sex_or_unknown"),
        L.derived_race(ethnicity, label).alias("derived_group"),
    )


@query(
    "interaction_products",
    LOANS + "SELECT loan_application_id, income * property_value AS income_x_value, score * income AS score_x_income FROM loans",
)
def _(spark, sf):
    pairs = {"income_x_value": ("income", "property_value"), "score_x_income": ("score", "income")}
    return features.interactions(loans(spark, sf), pairs).select(ID, *pairs)


@query(
    "ratio_features",
    LOANS
    + """, m AS (SELECT loan_purpose, median(loan_amount::DOUBLE) AS mp FROM loans GROUP BY 1),
    g AS (SELECT median(median_household_income) AS mi FROM loans)
    SELECT loan_application_id, income::DOUBLE / nullif(loan_amount::DOUBLE / mp, 0) AS income_to_loan_ratio_stratified,
      loan_amount::DOUBLE / coalesce(median_household_income, mi) AS loan_to_income_ratio
    FROM loans JOIN m USING (loan_purpose), g""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "loan_purpose", "loan_amount", "income", "median_household_income")
    grains = {"p": (["loan_purpose"], ["loan_amount"]), "all": ([], ["median_household_income"])}
    joined, median = features.attach_medians(df, quantiles.grouped_medians(df, grains), grains)
    local = F.coalesce("median_household_income", median["all"]("median_household_income"))
    return joined.select(
        ID,
        features.stratified_income_ratio(median["p"]("loan_amount")).alias("income_to_loan_ratio_stratified"),
        N.ratio(F.col("loan_amount"), local).alias("loan_to_income_ratio"),
    )


@query(
    "high_dti_large_loan",
    LOANS
    + f""", m AS (SELECT state_code, loan_purpose, median(loan_amount::DOUBLE) AS t FROM loans GROUP BY 1, 2)
    SELECT loan_application_id, t AS loan_amount_threshold,
      CASE WHEN {_DTI} >= 40 AND loan_amount > t THEN 1 ELSE 0 END AS high_dti_large_loan
    FROM loans JOIN m USING (state_code, loan_purpose)""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "state_code", "loan_purpose", "loan_amount", "debt_to_income_ratio")
    grains = {"sp": (["state_code", "loan_purpose"], ["loan_amount"])}
    joined, median = features.attach_medians(df, quantiles.grouped_medians(df, grains), grains)
    threshold = median["sp"]("loan_amount")
    high = (L.dti_number(F.col("debt_to_income_ratio")) >= 40) & (F.col("loan_amount") > threshold)
    return joined.select(
        ID,
        threshold.alias("loan_amount_threshold"),
        F.coalesce(high, F.lit(False)).cast("int").alias("high_dti_large_loan"),
    )


@query(
    "missing_flags",
    LOANS
    + """SELECT loan_application_id, CASE WHEN property_value IS NULL THEN 0 ELSE 1 END AS has_property_value,
      CASE WHEN median_household_income IS NULL THEN 0 ELSE 1 END AS has_acs_data,
      CASE WHEN minority_population_pct IS NULL THEN 1 ELSE 0 END AS minority_missing FROM loans""",
)
def _(spark, sf):
    return loans(spark, sf).select(
        ID,
        N.present_flag(F.col("property_value")).alias("has_property_value"),
        N.present_flag(F.col("median_household_income")).alias("has_acs_data"),
        N.missing_flag(F.col("minority_population_pct")).alias("minority_missing"),
    )


_DROPPED = ["actual_value", "score", "predicted_label", "lender_entity_name", "county_code"]


@query("select_features", LOANS + f"SELECT * EXCLUDE ({', '.join(_DROPPED)}) FROM loans")
def _(spark, sf):
    df = loans(spark, sf)
    return features.select_features(df, drop=_DROPPED)


@query(
    "co_applicant_flag",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 = 5 THEN 0 ELSE 1 END::INTEGER AS co_applicant_present FROM orders""",
)
def _(spark, sf):
    code = F.col("o_orderkey") % 7
    return table(spark, sf, "orders").select("o_orderkey", L.co_applicant_present(F.when(code != 6, code)).alias("co_applicant_present"))
