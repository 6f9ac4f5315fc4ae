from pyspark.sql import functions as F

from lendlens.operators import enrich, profiling, quality
from lendlens.queries.registry import query
from lendlens.queries.standin import LOANS, RACE, loans, table

ID = "loan_application_id"
_NULLABLE = ["property_value", "median_household_income", "minority_population_pct", "applicant_sex_category", "income"]


@query(
    "null_counts",
    LOANS + "SELECT count(*) AS total_rows, " + ", ".join(f"count(*) - count({c}) AS {c}_null_count" for c in _NULLABLE) + " FROM loans",
)
def _(spark, sf):
    return profiling.null_counts(loans(spark, sf), _NULLABLE)


_COLUMNS = [
    ID, "activity_year", "lender_entity_name", "state_code", "county_code", "census_tract", "zip_code", RACE, "applicant_sex_category",
    "loan_purpose", "loan_amount", "income", "property_value", "debt_to_income_ratio", "median_household_income",
    "minority_population_pct", "is_distressed", "loan_approved", "actual_value", "score", "predicted_label",
]


@query(
    "null_counts_all",
    LOANS + "SELECT count(*) AS total_rows, " + ", ".join(f"count(*) - count({c}) AS {c}_null_count" for c in _COLUMNS) + " FROM loans",
)
def _(spark, sf):
    """The column list comes from the table."""
    return profiling.null_counts(loans(spark, sf))


@query(
    "missing_summary",
    LOANS
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing FROM loans" for c in _NULLABLE)
    + ") WHERE n_missing > 0",
)
def _(spark, sf):
    return profiling.missing_summary(loans(spark, sf), _NULLABLE)


_NUMERIC = ["loan_amount", "income", "property_value"]


def _profile_sql(c):
    return f"""SELECT '{c}' AS feature, count({c}) AS n,
      round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 4) AS skewness, round(stddev_samp({c}), 2) AS std_dev,
      round(avg({c}), 2) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count(DISTINCT {c}) AS n_distinct,
      max({c}) > avg({c}) * 10 AS possible_outliers FROM loans, (SELECT avg({c}) AS m FROM loans)"""


@query("profile_numeric", LOANS + " UNION ALL ".join(_profile_sql(c) for c in _NUMERIC))
def _(spark, sf):
    p = profiling.profile_numeric(loans(spark, sf), _NUMERIC)
    return p.select(
        "feature", "n", F.round("skewness", 4).alias("skewness"), F.round("std_dev", 2).alias("std_dev"),
        F.round("mean", 2).alias("mean"), "min", "max", "n_distinct", "possible_outliers",
    )


_CATS = [RACE, "applicant_sex_category", "lender_entity_name"]


@query(
    "profile_categorical",
    LOANS
    + "SELECT column_name, value, n, n::DOUBLE / (sum(n) OVER (PARTITION BY column_name))::DOUBLE AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM loans GROUP BY {c}" for c in _CATS)
    + ")",
)
def _(spark, sf):
    return profiling.profile_categorical(loans(spark, sf), _CATS)


@query(
    "category_balance",
    LOANS
    + "SELECT column_name, value AS top_category, (n::DOUBLE / t::DOUBLE) * 100 AS top_pct, CASE WHEN n::DOUBLE / t * 100 > 80 "
    "THEN 'highly imbalanced' WHEN n::DOUBLE / t * 100 > 50 THEN 'moderately imbalanced' ELSE 'balanced' END AS verdict FROM ("
    "SELECT *, sum(n) OVER (PARTITION BY column_name) AS t, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS FIRST) AS rn FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM loans GROUP BY {c}" for c in _CATS)
    + ")) WHERE rn = 1",
)
def _(spark, sf):
    return profiling.category_balance(loans(spark, sf), _CATS)


def _outlier_sql(c):
    return f"""SELECT '{c}' AS column_name, count(*) AS total_rows,
      count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
      count(*) FILTER (WHERE abs({c} - m) > 3 * sd) AS z_outliers
      FROM loans, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, avg({c}) AS m,
        stddev_pop({c}) AS sd FROM loans)"""


@query("outliers", LOANS + " UNION ALL ".join(_outlier_sql(c) for c in _NUMERIC))
def _(spark, sf):
    return profiling.numeric_outliers(loans(spark, sf), _NUMERIC).drop("iqr_outliers_pct", "z_outliers_pct")


@query(
    "rare_categories",
    """WITH c AS (SELECT 'p_brand' AS column_name, p_brand AS v, count(*) AS n FROM part GROUP BY 2
      UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
    s AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS t FROM c)
    SELECT column_name, CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE n::DOUBLE / t < 0.04) AS rare_categories,
      CAST(coalesce(sum(n) FILTER (WHERE n::DOUBLE / t < 0.04), 0) AS BIGINT) AS outlier_rows FROM s GROUP BY 1""",
)
def _(spark, sf):
    return profiling.rare_categories(table(spark, sf, "part"), ["p_brand", "p_type"], 0.04)


@query(
    "histogram50",
    LOANS
    + """, e AS (SELECT min(loan_amount)::DOUBLE AS lo, max(loan_amount)::DOUBLE AS hi FROM loans)
    SELECT CAST(least(floor((loan_amount::DOUBLE - lo) / ((hi - lo) / 50)), 49) + 1 AS INTEGER) AS bin,
      lo + least(floor((loan_amount::DOUBLE - lo) / ((hi - lo) / 50)), 49) * ((hi - lo) / 50) AS bin_start, count(*) AS n
    FROM loans, e GROUP BY ALL""",
)
def _(spark, sf):
    return profiling.histogram(loans(spark, sf), "loan_amount", 50)


@query("unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return quality.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("not_null_check", LOANS + "SELECT loan_application_id FROM loans WHERE property_value IS NULL")
def _(spark, sf):
    return quality.check_not_null(loans(spark, sf), "property_value").select(ID)


@query(
    "rows_with_nulls",
    LOANS + "SELECT loan_application_id FROM loans WHERE " + " OR ".join(f"{c} IS NULL" for c in _NULLABLE if c != "income"),
)
def _(spark, sf):
    return quality.rows_with_nulls(loans(spark, sf), _NULLABLE, ignore=["income"]).select(ID)


@query("missing_keys", LOANS + "SELECT DISTINCT census_tract FROM loans WHERE median_household_income IS NULL")
def _(spark, sf):
    return enrich.missing_keys(loans(spark, sf), "census_tract", "median_household_income")


@query("set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return quality.set_difference(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), "o_custkey")


@query(
    "table_diff",
    """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1), b AS (SELECT o_orderkey, o_custkey,
      CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderkey % 20 = 3 THEN 0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 2)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
      CASE WHEN b.o_orderkey IS NULL THEN 'only_in_a' WHEN a.o_orderkey IS NULL THEN 'only_in_b' ELSE 'changed' END AS status,
      concat_ws(',', CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END,
        CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
        CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) AS changed_columns
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
      OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    a = orders.filter(key % 10 != 1)
    b = orders.filter(key % 10 != 2).withColumns(
        {
            "o_orderstatus": F.when(key % 10 != 3, F.col("o_orderstatus")),
            "o_totalprice": F.when(key % 20 == 3, 0.0).otherwise(F.col("o_totalprice")),
        }
    )
    return quality.diff_tables(a, b, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])
