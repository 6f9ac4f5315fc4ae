"""Loan applications made from the order tables.

An order is an application and its customer the applicant. Amounts are whole numbers and scores
multiples of 1/1024, so sums and means are exact and do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REFERENCE, UNKNOWN = "BUILDING", "HOUSEHOLD"
MINORITY = ["AUTOMOBILE", "FURNITURE", "MACHINERY"]
GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RACE = "applicant_derived_racial_category"
SPAN = 1000003

LOANS = """WITH base AS (
  SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 85 WHEN 'AUTOMOBILE' THEN 75 WHEN 'MACHINERY' THEN 65
            WHEN 'FURNITURE' THEN 45 ELSE 70 END AS cut
  FROM orders JOIN customer ON o_custkey = c_custkey
), decided AS (
  SELECT *, CASE WHEN (o_orderkey * 31) % 100 < cut THEN 1 ELSE 0 END AS approved FROM base
), loans AS (
  SELECT o_orderkey AS loan_application_id,
    CAST(year(o_orderdate) AS INTEGER) AS activity_year,
    'L' || CAST(o_custkey % 20 AS VARCHAR) AS lender_entity_name,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_code,
    lpad(CAST(o_custkey % 3 AS VARCHAR), 3, '0') AS county_code,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 3 AS VARCHAR), 3, '0')
      || lpad(CAST(o_custkey % 10 AS VARCHAR), 6, '0') AS census_tract,
    'Z' || CAST(o_custkey % 40 AS VARCHAR) AS zip_code,
    c_mktsegment AS applicant_derived_racial_category,
    CASE o_orderkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'information not provided' END
      AS applicant_sex_category,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 31 WHEN '4' THEN 32
      ELSE 4 END AS loan_purpose,
    CAST(floor(o_totalprice) AS BIGINT) AS loan_amount,
    CAST(floor(c_acctbal) AS BIGINT) AS income,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) * 1.25 END AS property_value,
    CASE o_orderkey % 5 WHEN 0 THEN '<20%' WHEN 1 THEN '30%-<36%' WHEN 2 THEN '41' WHEN 3 THEN '>60%'
      ELSE 'Exempt' END AS debt_to_income_ratio,
    CASE WHEN o_custkey % 11 <> 0 THEN CAST(30000 + (o_custkey * 37) % 1000 * 50 AS DOUBLE) END
      AS median_household_income,
    CASE WHEN o_custkey % 13 <> 0 THEN CAST((o_custkey * 29) % 400 AS DOUBLE) / 4 END AS minority_population_pct,
    CASE WHEN o_custkey % 9 = 0 THEN 1 END AS is_distressed,
    approved AS loan_approved,
    approved AS actual_value,
    CAST((o_orderkey * 7919) % 700 + 300 * approved AS DOUBLE) / 1024 AS score,
    CASE WHEN (o_orderkey * 7919) % 700 + 300 * approved >= 512 THEN 1 ELSE 0 END AS predicted_label
  FROM decided
)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_key(id_column: str = "loan_application_id") -> Column:
    """Evenly spread integer in [0, SPAN) that plain SQL can compute too."""
    return (F.col(id_column) * 7919) % SPAN


def digits(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    tract = "lpad(c_nationkey, 2, '0'), lpad(o_custkey % 3, 3, '0')"
    decided = joined.selectExpr(
        "*",
        """if((o_orderkey * 31) % 100 < case c_mktsegment when 'BUILDING' then 85 when 'AUTOMOBILE' then 75
           when 'MACHINERY' then 65 when 'FURNITURE' then 45 else 70 end, 1, 0) as approved""",
    )
    return decided.selectExpr(
        "o_orderkey as loan_application_id",
        "year(o_orderdate) as activity_year",
        "concat('L', o_custkey % 20) as lender_entity_name",
        "lpad(c_nationkey, 2, '0') as state_code",
        "lpad(o_custkey % 3, 3, '0') as county_code",
        f"concat({tract}, lpad(o_custkey % 10, 6, '0')) as census_tract",
        "concat('Z', o_custkey % 40) as zip_code",
        f"c_mktsegment as {RACE}",
        "case o_orderkey % 4 when 0 then 'Male' when 1 then 'Female' when 2 then 'information not provided' end"
        " as applicant_sex_category",
        "case substring(o_orderpriority, 1, 1) when '1' then 1 when '2' then 2 when '3' then 31 when '4' then 32"
        " else 4 end as loan_purpose",
        "floor(o_totalprice) as loan_amount",
        "floor(c_acctbal) as income",
        "if(o_orderkey % 7 <> 0, cast(floor(o_totalprice) as double) * 1.25D, null) as property_value",
        "case o_orderkey % 5 when 0 then '<20%' when 1 then '30%-<36%' when 2 then '41' when 3 then '>60%'"
        " else 'Exempt' end as debt_to_income_ratio",
        "if(o_custkey % 11 <> 0, cast(30000 + (o_custkey * 37) % 1000 * 50 as double), null) as median_household_income",
        "if(o_custkey % 13 <> 0, cast((o_custkey * 29) % 400 as double) / 4D, null) as minority_population_pct",
        "if(o_custkey % 9 = 0, 1, null) as is_distressed",
        "approved as loan_approved",
        "approved as actual_value",
        "cast((o_orderkey * 7919) % 700 + 300 * approved as double) / 1024D as score",
        "if((o_orderkey * 7919) % 700 + 300 * approved >= 512, 1, 0) as predicted_label",
    )


def race_as(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(RACE, "race")
