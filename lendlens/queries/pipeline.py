"""The whole pipeline on landed tables that are derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendlens.functions.lending import or_unknown
from lendlens.operators import features, rates, sampling
from lendlens.plans import lending
from lendlens.queries import fairness as _  # noqa: F401  its SQL is used here
from lendlens.queries.registry import ORACLES, query
from lendlens.queries.standin import LOANS, digits, table
from lendlens.schemas import LAR_TEXT_COLUMNS
from lendlens.shared import settle

AS_OF = "2024-06-30"
ID = "loan_application_id"
#: Lenders named by applications; at the smaller scales some have no entry in the lender table.
LENDERS = 23
# Code labels as they appear in the lookup table.
CATEGORIES = [
    ("applicant_race", 2, "AAPI"),
    ("applicant_race", 3, "Black"),
    ("applicant_race", 5, "White"),
    ("applicant_race", 6, "not provided"),
    ("applicant_race", 7, "not applicable"),
    ("applicant_ethnicity", 1, "Latinx"),
    ("applicant_ethnicity", 2, "Not hispanic or latinx"),
    ("applicant_ethnicity", 3, "information not provided"),
    ("applicant_ethnicity", 4, "not applicable"),
    ("applicant_sex", 1, "Male"),
    ("applicant_sex", 2, "Female"),
    ("applicant_sex", 3, "information not provided"),
]


def _tract(nation, cust):
    return F.concat(digits(nation, 2), digits(cust % 3, 3), digits(cust % 10, 6))


def raw_tables(spark, sf) -> lending.RawTables:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    ck, ok, nk = F.col("o_custkey"), F.col("o_orderkey"), F.col("c_nationkey")
    joined = orders.join(customer, ck == F.col("c_custkey"))
    text = lambda c: c.cast("string")
    year = F.year("o_orderdate") + 22
    priority = F.substring("o_orderpriority", 1, 1)
    lar = {
        "activity_year": text(year),
        "action_taken": text(ok % 5 + 1),
        "lei": F.concat(F.lit("LEI"), text(ck % LENDERS)),
        "state_code": F.when(ok % 10 != 0, F.concat(F.lit("ST"), text(nk))),
        "county_code": F.when(ok % 6 != 0, digits(ck % 3, 3)),
        "census_tract": F.when(ok % 50 != 0, _tract(nk, ck)),
        "loan_amount": F.concat(text(F.round(F.col("o_totalprice") * 100).cast("bigint")), F.lit(".0")),
        "income": text(F.floor("c_acctbal")),
        "property_value": F.when(ok % 7 == 0, "Exempt").otherwise(text(F.floor("o_totalprice") + 5000)),
        "loan_type": text(ok % 4 + 1),
        "loan_purpose": F.when(ok % 23 == 0, "5")
        .when(priority == "1", "1")
        .when(priority == "2", "2")
        .when(priority == "3", "31")
        .when(priority == "4", "32")
        .otherwise("4"),
        "occupancy_type": text(ok % 3 + 1),
        "applicant_race_1": F.when(F.col("c_mktsegment") == "BUILDING", "5")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "2")
        .when(F.col("c_mktsegment") == "MACHINERY", "3")
        .when(F.col("c_mktsegment") == "FURNITURE", "6")
        .otherwise("7"),
        "applicant_ethnicity_1": text(ok % 6 + 1),
        "applicant_sex": text(ok % 4 + 1),
        "applicant_age": F.when(ok % 8 == 0, "8888").when(ok % 8 == 1, ">74").otherwise("25-34"),
        "debt_to_income_ratio": F.when(ok % 5 == 0, "<20%").when(ok % 5 == 1, "30%-<36%").when(ok % 5 == 2, "41").otherwise("Exempt"),
    }
    raw_lar = joined.select(*[lar.get(c, F.lit(None).cast("string")).alias(c) for c in LAR_TEXT_COLUMNS])

    c = F.col("c_custkey")
    tracts = customer.groupBy((c % 30).alias("r"), "c_nationkey").agg(F.min("c_custkey").alias("m"))
    m, r = F.col("m"), F.col("r")
    zero = "latinx_population high_school_diploma_population total_population_receiving_federal_assistance median_home_value".split()
    acs = tracts.filter(m % 6 != 0).select(
        F.lit("t").alias("name"),
        (m % 50 * 16).alias("total_population"),
        (m % 50 * (m % 16)).alias("white_population"),
        F.lit(0).alias("black_population"),
        (m % 7 * 2).alias("bachelors_degree_population"),
        (m % 5).alias("graduate_degree_population"),
        (m % 31).alias("total_population_below_poverty_level"),
        F.when(m % 9 == 0, -666666666).otherwise(30000 + m % 100 * 700).alias("median_household_income"),
        F.when(m % 8 == 0, -666666666.0).otherwise((m % 64).cast("double") / 64).alias("gini_index_of_income_inequality"),
        text(nk).alias("state"),
        text(r % 3).alias("county"),
        text(r % 10).alias("tract"),
        *[F.lit(0).alias(z) for z in zero],
    )
    zip_row = lambda z, share: F.struct(
        F.concat(F.lit("Z"), text(z)).alias("zip_code"), F.lit(share).alias("residential_ratio")
    )
    crosswalk = tracts.select(
        _tract(nk, r).alias("census_tract"), F.explode(F.array(zip_row(m % 40, 0.75), zip_row(m % 17 + 100, 0.0))).alias("z")
    ).select("census_tract", "z.*", F.lit("city").alias("city_name"), F.lit("ST").alias("state_name"))

    day = text(F.add_months(F.col("l_shipdate").cast("date"), 264))
    line = F.col("l_linenumber")
    price, qty = F.floor("l_extendedprice").cast("double"), F.col("l_quantity")
    blank = "homes_sold pending_sales price_drops avg_sale_to_list off_market_in_two_weeks".split()
    market = table(spark, sf, "lineitem").select(
        day.alias("period_begin"),
        day.alias("period_end"),
        F.concat(F.lit("zipcode:US:Z"), text(F.col("l_partkey") % 37)).alias("region"),
        F.lit("WI").alias("state_code"),
        F.lit("Wisconsin, Milwaukee").alias("parent_metro_region"),
        F.lit("All").alias("property_type"),
        F.when(line <= 3, 6).when(line == 4, 13).otherwise(4).alias("property_type_id"),
        price.alias("median_sale_price"),
        (qty / 64).alias("median_sale_price_yoy"),
        (price + 1000).alias("median_list_price"),
        (qty / 128).alias("median_list_price_yoy"),
        (qty * 2).alias("median_ppsf"),
        (qty / 32).alias("median_ppsf_yoy"),
        qty.alias("inventory"),
        (qty + 3).alias("new_listings"),
        (qty + 7).alias("median_dom"),
        *[F.lit(None).cast("double").alias(b) for b in blank],
    )
    distress = (
        joined.filter(ck % 9 == 0)
        .select(_tract(nk, ck).alias("tract_fips"), year.alias("report_year"))
        .distinct()
        .withColumns({"is_distressed": F.lit(1), "is_underserved": F.col("report_year") % 2})
    )
    s = F.col("s_suppkey")
    lenders = (
        table(spark, sf, "supplier").select(
            F.concat(F.lit("lei"), text(s)).alias("lei"),
            F.lower("s_name").alias("entity_name"),
            F.when(s % 3 == 0, "issued").when(s % 3 == 1, "retired").otherwise("Lapsed").alias("registration_status"),
            F.concat(text(s % 15 + 2000), F.lit("-05-01T00:00:00Z")).alias("registration_initial_date"),
            F.lit("2024-01-01").alias("registration_last_update"),
        )
    )
    categories = spark.createDataFrame(CATEGORIES, "column_name string, category_value int, category_title string")
    fips = table(spark, sf, "nation").select(digits(F.col("n_nationkey"), 2).alias("fips"), F.col("n_name").alias("usps"))
    return lending.RawTables(raw_lar, acs, crosswalk, market, distress, lenders, categories, fips)


_VALUES = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in CATEGORIES)
FEATURES = f"""WITH j AS (SELECT *, o_custkey AS ck, o_orderkey AS ok, c_nationkey AS nk FROM orders JOIN customer ON o_custkey = c_custkey),
apps AS (SELECT CAST(year(o_orderdate) + 22 AS INTEGER) AS activity_year, CAST(ok % 5 + 1 AS INTEGER) AS action_taken,
    'LEI' || CAST(ck % {LENDERS} AS VARCHAR) AS lei,
    CASE WHEN ok % 10 <> 0 THEN 'ST' || CAST(nk AS VARCHAR) END AS state_code,
    CASE WHEN ok % 6 <> 0 THEN lpad(CAST(ck % 3 AS VARCHAR), 3, '0') END AS county_code,
    CASE WHEN ok % 50 <> 0 THEN lpad(CAST(nk AS VARCHAR), 2, '0') || lpad(CAST(ck % 3 AS VARCHAR), 3, '0')
      || lpad(CAST(ck % 10 AS VARCHAR), 6, '0') END AS census_tract,
    CAST(round(o_totalprice * 100) AS BIGINT) AS loan_amount, CAST(floor(c_acctbal) AS BIGINT) AS inc,
    CASE WHEN ok % 7 <> 0 THEN CAST(floor(o_totalprice) + 5000 AS BIGINT) END AS property_value,
    CAST(ok % 4 + 1 AS INTEGER) AS loan_type,
    CAST(CASE WHEN ok % 23 = 0 THEN 5 ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 31
      WHEN '4' THEN 32 ELSE 4 END END AS INTEGER) AS loan_purpose,
    CAST(ok % 3 + 1 AS INTEGER) AS occupancy_type,
    CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 3 WHEN 'FURNITURE' THEN 6 ELSE 7 END AS race,
    ok % 6 + 1 AS eth, ok % 4 + 1 AS sex,
    CASE WHEN ok % 8 = 0 THEN NULL WHEN ok % 8 = 1 THEN '>74' ELSE '25-34' END AS applicant_age,
    CASE ok % 5 WHEN 0 THEN '<20%' WHEN 1 THEN '30%-<36%' WHEN 2 THEN '41' END AS debt_to_income_ratio FROM j),
keyed AS (SELECT *, md5(concat_ws('-', activity_year, action_taken, lei, coalesce(state_code, ''), coalesce(county_code, ''),
    coalesce(census_tract, ''), CAST(loan_amount AS VARCHAR) || '.0', inc, eth, race, sex)) AS loan_application_id FROM apps),
tr AS (SELECT c_custkey % 30 AS r, c_nationkey AS nk, min(c_custkey) AS m FROM customer GROUP BY 1, 2),
tracts AS (SELECT *, lpad(CAST(nk AS VARCHAR), 2, '0') || lpad(CAST(r % 3 AS VARCHAR), 3, '0') || lpad(CAST(r % 10 AS VARCHAR), 6, '0') AS census_tract FROM tr),
acs0 AS (SELECT census_tract, m % 50 * 16 AS total, m % 50 * (m % 16) AS white, m % 7 * 2 + m % 5 AS bach, m % 31 AS poor,
    CASE WHEN m % 9 <> 0 THEN 30000 + m % 100 * 700 END AS median_household_income,
    CASE WHEN m % 8 = 0 THEN -666666666 ELSE (m % 64)::DOUBLE / 64 END AS gini FROM tracts WHERE m % 6 <> 0),
acs AS (SELECT census_tract, median_household_income, gini,
    CASE WHEN total > 0 THEN round((total - white)::DOUBLE / total * 100, 2) END AS minority_population_pct,
    CASE WHEN total > 0 THEN round(bach::DOUBLE / total * 100, 2) END AS pct_bachelors_or_higher,
    CASE WHEN total > 0 THEN round(poor::DOUBLE / total * 100, 2) END AS total_population_below_poverty_level_pct,
    ntile(4) OVER (ORDER BY median_household_income NULLS LAST, census_tract) AS income_bucketed FROM acs0),
mk AS (SELECT CAST(l_shipdate + INTERVAL 22 YEAR AS DATE) AS d, 'Z' || CAST(l_partkey % 37 AS VARCHAR) AS zip_code,
    floor(l_extendedprice) AS price, l_quantity AS qty FROM lineitem WHERE l_linenumber <= 4),
yearly AS (SELECT zip_code, year(d) AS y, avg(price) AS avg_median_sale_price, avg(qty / 64) AS avg_median_sale_price_year_over_year,
    avg(price + 1000) AS avg_median_list_price, avg(qty / 128) AS avg_median_list_price_year_over_year,
    avg(qty * 2) AS avg_median_price_per_square_foot, avg(qty / 32) AS avg_median_price_per_square_foot_year_over_year,
    avg(qty) AS avg_inventory, avg(qty + 3) AS avg_new_listings, avg(qty + 7) AS avg_median_days_on_market
    FROM mk WHERE d > '2018-01-01' AND d < '2024-01-31' GROUP BY 1, 2),
best AS (SELECT census_tract, 'Z' || CAST(m % 40 AS VARCHAR) AS zip_code FROM tracts WHERE 'Z' || CAST(m % 40 AS VARCHAR) IN (SELECT zip_code FROM yearly)),
distress AS (SELECT DISTINCT lpad(CAST(nk AS VARCHAR), 2, '0') || lpad(CAST(ck % 3 AS VARCHAR), 3, '0') || lpad(CAST(ck % 10 AS VARCHAR), 6, '0') AS census_tract,
    year(o_orderdate) + 22 AS y, 1 AS is_distressed, (year(o_orderdate) + 22) % 2 AS is_underserved FROM j WHERE ck % 9 = 0),
lend AS (SELECT 'LEI' || CAST(s_suppkey AS VARCHAR) AS lei, upper(s_name) AS entity_name,
    CASE s_suppkey % 3 WHEN 0 THEN 'ISSUED' WHEN 1 THEN 'RETIRED' ELSE 'LAPSED' END AS status, 2024 - (s_suppkey % 15 + 2000) AS age
    FROM supplier),
cat(column_name, category_value, category_title) AS (VALUES {_VALUES}),
features AS (SELECT loan_application_id, activity_year, CASE WHEN y.zip_code IS NULL THEN 'Unknown' ELSE y.zip_code END AS zip_code,
    coalesce(state_code, n_name) AS state_code, coalesce(county_code, substr(k.census_tract, 3, 3)) AS county_code, k.census_tract,
    CASE WHEN action_taken IN (1, 2) THEN 1 ELSE 0 END AS loan_approved,
    coalesce(entity_name, 'UNKNOWN') AS lender_entity_name, coalesce(status, 'UNKNOWN') AS lender_registration_status,
    CAST(coalesce(age, 0) AS INTEGER) AS lender_entity_age,
    CASE WHEN e.category_title IS NULL AND r.category_title NOT IN ('not provided', 'not applicable') THEN r.category_title
      WHEN e.category_title = 'not applicable' AND r.category_title = 'not provided' THEN NULL
      WHEN e.category_title IN ('not applicable', 'information not provided', 'Not hispanic or latinx')
        AND r.category_title NOT IN ('not provided', 'not applicable') THEN r.category_title
      WHEN (e.category_title IN ('not applicable', 'information not provided', 'Not hispanic or latinx') OR e.category_title IS NULL)
        AND (r.category_title IN ('not applicable', 'not provided') OR r.category_title IS NULL) THEN NULL
      WHEN e.category_title = 'Latinx' THEN 'Latinx' ELSE 'not a match' END AS applicant_derived_racial_category,
    s.category_title AS applicant_sex_category, applicant_age, inc * 1000 AS income, debt_to_income_ratio,
    loan_amount, loan_type, loan_purpose, occupancy_type, property_value, median_household_income, minority_population_pct,
    pct_bachelors_or_higher, total_population_below_poverty_level_pct, gini AS gini_index_of_income_inequality,
    CAST(income_bucketed AS INTEGER) AS income_bucketed, is_distressed, CAST(is_underserved AS INTEGER) AS is_underserved,
    y.* EXCLUDE (zip_code, y)
  FROM keyed k LEFT JOIN acs a ON k.census_tract = a.census_tract
  LEFT JOIN best b ON k.census_tract = b.census_tract LEFT JOIN yearly y ON b.zip_code = y.zip_code AND k.activity_year = y.y
  LEFT JOIN distress d ON k.census_tract = d.census_tract AND k.activity_year = d.y LEFT JOIN lend l ON k.lei = l.lei
  LEFT JOIN cat e ON e.column_name = 'applicant_ethnicity' AND e.category_value = eth
  LEFT JOIN cat r ON r.column_name = 'applicant_race' AND r.category_value = race
  LEFT JOIN cat s ON s.column_name = 'applicant_sex' AND s.category_value = sex
  LEFT JOIN nation ON lpad(CAST(n_nationkey AS VARCHAR), 2, '0') = substr(k.census_tract, 1, 2)
  WHERE k.census_tract IS NOT NULL AND action_taken IN (1, 2, 3) AND inc <> 0)
"""
FEATURE_COLUMNS = (
    "loan_application_id activity_year zip_code state_code county_code census_tract loan_approved lender_entity_name "
    "lender_registration_status lender_entity_age applicant_derived_racial_category applicant_sex_category applicant_age "
    "income debt_to_income_ratio loan_amount loan_type loan_purpose occupancy_type property_value median_household_income "
    "minority_population_pct pct_bachelors_or_higher total_population_below_poverty_level_pct "
    "gini_index_of_income_inequality income_bucketed is_distressed is_underserved"
).split() + features.MARKET_COLUMNS


@query("model_features", FEATURES + "SELECT " + ", ".join(FEATURE_COLUMNS) + " FROM features")
def model_features(spark, sf):
    return lending.model_features(raw_tables(spark, sf), AS_OF).select(
        *[F.col(c).cast("bigint").alias(c) if c == "median_household_income" else F.col(c) for c in FEATURE_COLUMNS]
    )


def _med(c, keys):
    return f"median({c}::DOUBLE) OVER (PARTITION BY {keys})" if keys else f"median({c}::DOUBLE) OVER ()"


def _pre_sql() -> str:
    """The model table in plain SQL, written with window medians instead of joins."""
    acs, market = features.ACS_COLUMNS, features.MARKET_COLUMNS
    logs = features.LOG_COLUMNS
    cap = lambda c: (
        f"CASE WHEN {c} IS NULL OR {c} < q.{c}_lo THEN q.{c}_lo WHEN {c} > q.{c}_hi THEN q.{c}_hi ELSE {c} END::DOUBLE AS {c}_capped"
    )
    log = lambda c, src: f"CASE WHEN {src} > -1 THEN ln(1 + {src}::DOUBLE) ELSE 0 END::DOUBLE AS {c}"
    fill = [
        "coalesce(cleaned_dti, " + _med("cleaned_dti", "") + ") AS debt_to_income_ratio",
        "coalesce(property_value::DOUBLE, "
        + ", ".join(_med("property_value", k) for k in ("zip_code, loan_purpose", "zip_code", "loan_purpose", ""))
        + ") AS property_value_filled",
    ]
    fill += [
        f"coalesce({c}::DOUBLE, " + ", ".join(_med(c, k) for k in ("state_code, county_code", "state_code", "")) + f") AS {c}_filled"
        for c in acs
    ]
    fill += [
        f"coalesce({c}::DOUBLE, " + ", ".join(_med(c, k) for k in ("zip_code", "state_code", "")) + f") AS {c}_filled" for c in market
    ]
    quant = lambda c: f"quantile_cont({c}::DOUBLE, 0.01) AS {c}_lo, quantile_cont({c}::DOUBLE, 0.99) AS {c}_hi"
    second = [c for c in features.RATIO_COLUMNS]
    outs = [
        "loan_application_id", "activity_year", "loan_approved", "applicant_derived_racial_category", "applicant_sex_category",
        "applicant_age", "lender_registration_status", "loan_purpose_grouped", "race_sex_interaction", "race_state_interaction",
        "distressed_or_underserved_race", "is_distressed", "is_underserved", "has_property_value", "has_acs_data", "has_gini_data",
        "has_prior_approval_rate_data", "prior_approval_rate", "debt_to_income_ratio", "dti_bin", "minority_pct_bin", "gini_bin",
        "high_dti_large_loan", "loan_amount_threshold", "income_to_loan_ratio_stratified", "loan_to_income_ratio",
        *[f"{c}_log_bin" for c in features.QUARTILE_COLUMNS],
        *[f"round({c}_capped, 6) AS {c}_capped" for c in logs + second],
        *[f"round({c}_log, 6) AS {c}_log" for c in logs],
        "property_value_filled AS property_value",
        *[f"round({c}_filled, 6) AS {c}" for c in acs + market],
        "rn",
    ]
    return (
        FEATURES
        + f""", cleaned AS (SELECT loan_application_id, activity_year, loan_approved, loan_purpose, state_code, county_code,
      census_tract, zip_code, property_value, loan_amount, income, median_household_income, minority_population_pct,
      pct_bachelors_or_higher, total_population_below_poverty_level_pct, income_bucketed, {', '.join(market)},
      CASE loan_purpose WHEN 1 THEN 'Home Purchase' WHEN 2 THEN 'Home Improvement' WHEN 4 THEN 'Other' ELSE 'Refinancing' END AS loan_purpose_grouped,
      CASE WHEN lender_registration_status = 'RETIRED' THEN 'OTHER' ELSE lender_registration_status END AS lender_registration_status,
      CASE WHEN applicant_sex_category IN ('Male', 'Female') THEN applicant_sex_category WHEN applicant_sex_category = 'information not provided'
        THEN 'Unknown' ELSE 'Other' END AS applicant_sex_category,
      coalesce(applicant_age, 'Unknown') AS applicant_age,
      coalesce(applicant_derived_racial_category, 'Unknown') AS applicant_derived_racial_category,
      CASE debt_to_income_ratio WHEN '<20%' THEN 20 WHEN '30%-<36%' THEN 30 WHEN '41' THEN 41 END::DOUBLE AS cleaned_dti,
      CASE WHEN gini_index_of_income_inequality >= 0 THEN gini_index_of_income_inequality END AS gini_index_of_income_inequality,
      coalesce(is_distressed, 0) AS is_distressed, coalesce(is_underserved, 0) AS is_underserved,
      coalesce(applicant_derived_racial_category, 'Unknown') || '_' || coalesce(applicant_sex_category, 'Unknown') AS rsi,
      coalesce(applicant_derived_racial_category, 'Unknown') || '_' || coalesce(state_code, 'Unknown') AS race_state_interaction,
      CASE WHEN coalesce(is_distressed, 0) = 1 OR coalesce(is_underserved, 0) = 1 THEN '' ELSE 'Not' END || 'DistressedOrUnderserved_'
        || coalesce(applicant_derived_racial_category, 'Unknown') AS distressed_or_underserved_race
      FROM features WHERE loan_purpose <> 5),
    q AS (SELECT {', '.join(quant(c) for c in logs)} FROM cleaned),
    ty AS (SELECT census_tract, activity_year, sum(loan_approved) AS a, count(*) AS n FROM cleaned GROUP BY 1, 2),
    hist AS (SELECT census_tract, activity_year, CAST(sum(a) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) AS pr FROM ty
      WINDOW w AS (PARTITION BY census_tract ORDER BY activity_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    typical AS (SELECT activity_year, median(pr) AS tp FROM hist WHERE activity_year <> (SELECT min(activity_year) FROM hist) GROUP BY 1),
    rs AS (SELECT rsi, CASE WHEN count(*) < 30 THEN 'Other' ELSE rsi END AS race_sex_interaction FROM cleaned GROUP BY 1),
    med AS (SELECT *, {_med('loan_amount', 'loan_purpose_grouped')} AS lpgm, {_med('loan_amount', 'state_code, loan_purpose_grouped')}
      AS loan_amount_threshold, {_med('median_household_income', '')} AS gmi, {', '.join(fill)} FROM cleaned),
    imp AS (SELECT med.* EXCLUDE (gini_index_of_income_inequality), race_sex_interaction,
      CASE WHEN property_value IS NULL THEN 0 ELSE 1 END AS has_property_value,
      CASE WHEN median_household_income IS NULL THEN 0 ELSE 1 END AS has_acs_data,
      CASE WHEN gini_index_of_income_inequality IS NULL THEN 0 ELSE 1 END AS has_gini_data,
      CASE WHEN pr IS NULL THEN 0 ELSE 1 END AS has_prior_approval_rate_data,
      coalesce(pr, CASE WHEN activity_year = (SELECT min(activity_year) FROM hist) THEN 0.5 ELSE tp END)::DOUBLE AS prior_approval_rate,
      income::DOUBLE / nullif(loan_amount::DOUBLE / lpgm, 0) AS income_to_loan_ratio_stratified,
      loan_amount::DOUBLE / coalesce(median_household_income::DOUBLE, gmi) AS loan_to_income_ratio,
      {', '.join(cap(c) for c in logs)}, {', '.join(log(f'{c}_log', c) for c in logs)}
      FROM med LEFT JOIN hist USING (census_tract, activity_year) LEFT JOIN typical USING (activity_year) LEFT JOIN rs USING (rsi), q),
    q2 AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS {c}_lo2, quantile_cont({c}, 0.99) AS {c}_hi2' for c in second)},
      {', '.join(f'quantile_cont({c}_log, 0.25) AS {c}_q1, quantile_cont({c}_log, 0.5) AS {c}_q2, quantile_cont({c}_log, 0.75) AS {c}_q3' for c in features.QUARTILE_COLUMNS)} FROM imp),
    fin AS (SELECT *, {', '.join(f'CASE WHEN {c} IS NULL OR {c} < {c}_lo2 THEN {c}_lo2 WHEN {c} > {c}_hi2 THEN {c}_hi2 ELSE {c} END AS {c}_capped' for c in second)},
      CASE WHEN debt_to_income_ratio < 30 THEN 'Low' WHEN debt_to_income_ratio < 40 THEN 'Medium' WHEN debt_to_income_ratio < 50 THEN 'High'
        ELSE 'Very High' END AS dti_bin,
      CASE WHEN minority_population_pct_filled < 20 THEN 'Low Minority' WHEN minority_population_pct_filled < 50 THEN 'Moderate Minority'
        WHEN minority_population_pct_filled < 80 THEN 'High Minority' ELSE 'Very High Minority' END AS minority_pct_bin,
      CASE WHEN gini_index_of_income_inequality_filled < 0.3::DOUBLE THEN 'Low Inequality' WHEN gini_index_of_income_inequality_filled < 0.5
        THEN 'Moderate Inequality' ELSE 'High Inequality' END AS gini_bin,
      CASE WHEN debt_to_income_ratio >= 40 AND loan_amount > loan_amount_threshold THEN 1 ELSE 0 END AS high_dti_large_loan,
      {', '.join(f"CASE WHEN {c}_log < {c}_q1 THEN 'Low' WHEN {c}_log < {c}_q2 THEN 'Med-Low' WHEN {c}_log < {c}_q3 THEN 'Med-High' ELSE 'High' END AS {c}_log_bin" for c in features.QUARTILE_COLUMNS)},
      row_number() OVER (ORDER BY loan_application_id) AS rn FROM imp, q2)
    SELECT {', '.join(outs)} FROM fin"""
    )


_PRE_COLUMNS = (
    "loan_application_id activity_year loan_approved applicant_derived_racial_category applicant_sex_category applicant_age "
    "lender_registration_status loan_purpose_grouped race_sex_interaction race_state_interaction distressed_or_underserved_race "
    "is_distressed is_underserved has_property_value has_acs_data has_gini_data has_prior_approval_rate_data prior_approval_rate "
    "debt_to_income_ratio dti_bin minority_pct_bin gini_bin high_dti_large_loan loan_amount_threshold "
    "income_to_loan_ratio_stratified loan_to_income_ratio property_value"
).split()


def preprocessed(spark, sf):
    stored = settle(lending.model_features(raw_tables(spark, sf), AS_OF).select(*features.INPUT_COLUMNS))
    return features.preprocess(stored, rare_minimum=30)


@query("preprocessed", _pre_sql())
def _(spark, sf):
    df = preprocessed(spark, sf)
    logs = [f"{c}_log" for c in features.LOG_COLUMNS]
    # interpolated caps and medians may differ between engines in the last bit
    filled = [F.round(c, 6).alias(c) for c in features.ACS_COLUMNS + features.MARKET_COLUMNS]
    capped = [F.round(f"{c}_capped", 6).alias(f"{c}_capped") for c in features.LOG_COLUMNS + features.RATIO_COLUMNS]
    bins = [f"{c}_log_bin" for c in features.QUARTILE_COLUMNS]
    return df.select(
        *_PRE_COLUMNS, *bins, *capped, *filled, "rn", *[F.round(c, 6).alias(c) for c in logs]
    )


def _scored(table):
    """A score from the application's own amounts, standing in for a fitted model."""
    points = F.col("loan_amount") % 700 + F.col("loan_approved") * 300
    return table.select(
        "loan_application_id",
        "applicant_derived_racial_category",
        "applicant_age",
        F.col("loan_approved").alias("actual_value"),
        (points.cast("double") / 1024).alias("score"),
        (points >= 512).cast("int").alias("predicted_label"),
    )


def _prior_sql(entity, prefix):
    rate = lambda g: f"max(CASE WHEN race = '{g}' THEN y::DOUBLE / n END)"
    return (
        f"SELECT {entity}, activity_year + 1 AS activity_year, "
        + ", ".join(f"{rate(g)} AS {prefix}_prior_approval_rate_{g.lower()}" for g in ("Latinx", "AAPI", "Black", "White"))
        + f""", {rate('White')} - max(CASE WHEN race IN ('Black', 'Latinx', 'AAPI') THEN y::DOUBLE / n END) AS {prefix}_minority_gap,
        sum(y)::DOUBLE / sum(n)::DOUBLE AS {prefix}_overall
        FROM (SELECT {entity}, activity_year, race, count(*) AS n, sum(loan_approved) AS y FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    )


_PRIOR = [f"{p}_prior_approval_rate_{g}" for p in ("lender", "tract") for g in ("latinx", "aapi", "black", "white")]


@query(
    "model_set",
    FEATURES
    + f""", m AS (SELECT *, coalesce(applicant_derived_racial_category, 'Unknown') AS race FROM features WHERE loan_purpose <> 5),
    lp AS ({_prior_sql('lender_entity_name', 'lender')}), tp AS ({_prior_sql('census_tract', 'tract')})
    SELECT loan_application_id, {', '.join(_PRIOR)}, lender_minority_gap, tract_minority_gap,
      lender_overall AS lender_prior_year_approval_rate
    FROM m LEFT JOIN lp USING (lender_entity_name, activity_year) LEFT JOIN tp USING (census_tract, activity_year)""",
)
def _(spark, sf):
    return lending.model_set(preprocessed(spark, sf)).select(
        "loan_application_id", *_PRIOR, "lender_minority_gap", "tract_minority_gap", "lender_prior_year_approval_rate"
    )


_MODELLED = FEATURES + """, m AS (SELECT *, coalesce(applicant_derived_racial_category, 'Unknown') AS race FROM features
  WHERE loan_purpose <> 5)"""


@query(
    "training_sample",
    _MODELLED
    + """ SELECT activity_year, least(count(*), 50) AS n_validation, 0::BIGINT AS n_shared, true AS quotas_met, true AS chunks_full
    FROM m GROUP BY 1""",
)
def _(spark, sf):
    """What plain SQL can state of a seeded sample: sizes, disjointness, quotas per stratum, full chunks."""
    strata = ["activity_year", rates.RACE]
    modelled = settle(lending.model_set(preprocessed(spark, sf)))
    validation = settle(lending.validation_sample(modelled, 50))
    sample = settle(lending.training_sample(modelled, validation, 2000, 600))
    rest = modelled.join(validation.select(ID), ID, "left_anti")
    quota = sampling.allocate(rest, strata, "loan_approved", 2000)
    size, rate = F.col("sample_size_group"), F.col("approval_rate")
    drawn = sample.groupBy(*strata).agg(F.count_if(F.col("loan_approved") == 1).alias("yes"), F.count_if(F.col("loan_approved") == 0).alias("no"))
    yes, total = F.col("approved_count"), F.col("total_count")
    as_planned = lambda got, quota, there: F.coalesce(F.col(got), F.lit(0)) == F.least(F.floor(quota), there)
    met = quota.join(drawn, strata, "left").agg(
        F.bool_and(as_planned("yes", size * rate, yes) & as_planned("no", size * (1 - rate), total - yes)).alias("ok")
    )
    chunks = sample.groupBy("chunk_number").agg(F.count(F.lit(1)).alias("n"), F.max("global_row_number").alias("hi"))
    full = chunks.agg(F.bool_and((F.col("n") == 600) | (F.col("hi") == F.lit(sample.count()))).alias("ok"))
    shared = sample.join(validation.select(ID), ID, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    sizes = validation.groupBy("activity_year").agg(F.count(F.lit(1)).alias("n_validation"))
    return sizes.withColumns({"n_shared": shared.scalar(), "quotas_met": met.scalar(), "chunks_full": full.scalar()})


@query(
    "interleaved_training",
    _MODELLED + " SELECT count(*) AS n_rows, true AS numbered, true AS alternating, true AS chunked FROM m",
)
def _(spark, sf):
    out = settle(lending.interleaved_training(settle(preprocessed(spark, sf)), 400))
    n, label = F.col("global_row_number"), F.col("loan_approved")
    smaller = out.groupBy("loan_approved").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return out.withColumn("__s", smaller).agg(
        F.count(F.lit(1)).alias("n_rows"),
        ((F.count_distinct(n) == F.count(F.lit(1))) & (F.min(n) == 1) & (F.max(n) == F.count(F.lit(1)))).alias("numbered"),
        F.bool_and((n > 2 * F.col("__s")) | (label == (n - 1) % 2)).alias("alternating"),
        F.bool_and(F.col("chunk_number") == F.floor((n - 1) / 400)).alias("chunked"),
    )


#: The scored applications of :func:`_audit` under the names that the queries on single operators use.
_SCORED = FEATURES + """, loans AS (SELECT loan_application_id, activity_year, census_tract, county_code,
    coalesce(applicant_derived_racial_category, 'Unknown') AS applicant_derived_racial_category, loan_approved AS actual_value,
    CAST(loan_amount % 700 + loan_approved * 300 AS DOUBLE) / 1024 AS score,
    CASE WHEN loan_amount % 700 + loan_approved * 300 >= 512 THEN 1 ELSE 0 END AS predicted_label FROM features)
"""


def _as_audit(name: str) -> str:
    """An operator's SQL on the scored applications, with their names of the reference and unknown groups."""
    sql = ORACLES[name].removeprefix(LOANS).replace("ILIKE 'building'", "ILIKE 'white'")
    sql = sql.replace("race <> 'BUILDING'", "race IN ('Black', 'Latinx', 'AAPI')").replace("'BUILDING'", "'White'")
    return _SCORED + sql.replace("'HOUSEHOLD'", "'Unknown'")


def _audit(spark, sf, name):
    raw = raw_tables(spark, sf)
    # the audit needs ids, places and outcomes only, not the imputed columns
    race = "applicant_derived_racial_category"
    t = settle(lending.model_features(raw, AS_OF).withColumn(race, or_unknown(F.col(race))))
    zips = settle(
        raw.crosswalk.filter("residential_ratio > 0").select("census_tract", "zip_code", "city_name", "state_name")
    )
    centroids = zips.select(F.col("census_tract").alias("tract_fips"), F.lit(0.0).alias("centroid_lat"), F.lit(0.0).alias("centroid_lon"))
    return lending.audit(_scored(t), t, zips, raw.state_fips, centroids, [name])[name]


#: Audit table -> the query on the operator behind it.
_AUDITED = {
    "auc": "auc_by_year",
    "overall_scores": "model_scores_overall",
    "yearly_scores": "model_scores_by_year",
    "fairness": "fairness_gaps",
    "annual_rates": None,
    "calibration": "calibration",
    "score_distribution": "score_histogram",
    "redlining": "redlining",
}
_RED = """census_tract race county_code total_apps avg_score actual_positives actual_denials avg_score_given_positive
predicted_positives actual_approval_rate predicted_approval_rate score_dpd score_eod model_vs_actual_gap
is_possible_redlining is_redlining""".split()
_ANNUAL = (
    _SCORED
    + """SELECT activity_year, applicant_derived_racial_category AS race,
    count(*) FILTER (WHERE predicted_label = 1)::DOUBLE / count(*) AS predicted_approval_rate,
    count(*) FILTER (WHERE actual_value = 1)::DOUBLE / count(*) AS actual_approval_rate
    FROM loans WHERE applicant_derived_racial_category <> 'Unknown' GROUP BY 1, 2"""
)


def _register(name: str, source: str | None) -> None:
    sql = _ANNUAL if source is None else _as_audit(source)
    if name == "redlining":
        sql = sql.replace("SELECT * FROM red", "SELECT " + ", ".join(_RED) + " FROM red")

    @query(f"audit_{name}", sql)
    def _(spark, sf):
        out = _audit(spark, sf, name)
        return out.select(*_RED) if name == "redlining" else out


for _name, _source in _AUDITED.items():
    _register(_name, _source)
