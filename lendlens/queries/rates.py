from pyspark.sql import functions as F

from lendlens.operators import rates
from lendlens.queries.registry import query
from lendlens.queries.standin import GROUPS, LOANS, MINORITY, RACE, REFERENCE, loans, table

_RATE = """SELECT {keys}, count(*) AS total_apps, count(*) FILTER (WHERE loan_approved = 1) AS total_approved,
  count(*) FILTER (WHERE loan_approved = 1)::DOUBLE / count(*) AS approval_rate FROM loans GROUP BY {keys}"""


@query("approval_by_lender_year", LOANS + _RATE.format(keys="lender_entity_name, activity_year"))
def _(spark, sf):
    return rates.approval_rate(loans(spark, sf), ["lender_entity_name", "activity_year"], drop_null_keys=True)


@query("approval_by_lender_year_group", LOANS + _RATE.format(keys=f"lender_entity_name, activity_year, {RACE}"))
def _(spark, sf):
    return rates.approval_rate(loans(spark, sf), ["lender_entity_name", "activity_year", RACE], drop_null_keys=True)


@query("approval_by_tract_year_group", LOANS + _RATE.format(keys=f"census_tract, activity_year, {RACE}"))
def _(spark, sf):
    return rates.approval_rate(loans(spark, sf), ["census_tract", "activity_year", RACE])


_GAP = """, r AS (SELECT {e}, activity_year, {race}, count(*) AS n, sum(loan_approved) AS y FROM loans GROUP BY ALL),
p AS (SELECT {e}, activity_year,
  max(CASE WHEN {race} = 'BUILDING' THEN y::DOUBLE / n END) AS white_approval_rate,
  {minority} AS minority_approval_rate
  FROM r GROUP BY {e}, activity_year)
SELECT *, white_approval_rate - minority_approval_rate AS minority_gap FROM p"""
_IN = f"{RACE} IN ('AUTOMOBILE', 'FURNITURE', 'MACHINERY')"
_BEST = f"max(CASE WHEN {_IN} THEN y::DOUBLE / n END)"
_POOLED = f"sum(CASE WHEN {_IN} THEN y END)::DOUBLE / sum(CASE WHEN {_IN} THEN n END)"


def _gap(spark, sf, entity, **options):
    return rates.group_gap(loans(spark, sf), [entity, "activity_year"], RACE, REFERENCE, MINORITY, **options)


@query("lender_gap", LOANS + _GAP.format(e="lender_entity_name", race=RACE, minority=_BEST))
def _(spark, sf):
    return _gap(spark, sf, "lender_entity_name")


@query("tract_gap", LOANS + _GAP.format(e="census_tract", race=RACE, minority=_BEST))
def _(spark, sf):
    return _gap(spark, sf, "census_tract")


@query("tract_gap_pooled", LOANS + _GAP.format(e="census_tract", race=RACE, minority=_POOLED))
def _(spark, sf):
    return _gap(spark, sf, "census_tract", pooled=True)


_SHARES = ", ".join(
    f"""round(count(*) FILTER (WHERE {RACE} = '{g}')::DOUBLE / count(*) * 100, 4) AS {g.lower()}_pct,
    round(count(*) FILTER (WHERE {RACE} = '{g}' AND loan_approved = 1)::DOUBLE
      / nullif(count(*) FILTER (WHERE {RACE} = '{g}'), 0) * 100, 4) AS {g.lower()}_approval_rate"""
    for g in GROUPS
)


@query(
    "group_share_report",
    LOANS
    + f"""SELECT activity_year, round(sum(loan_approved)::DOUBLE / count(*) * 100, 2) AS approval_rate, {_SHARES}
    FROM loans GROUP BY activity_year""",
)
def _(spark, sf):
    return rates.group_share_report(loans(spark, sf), "activity_year", RACE, GROUPS)


@query(
    "annual_rates",
    LOANS
    + f"""SELECT activity_year, {RACE},
    sum(predicted_label)::DOUBLE / count(*) AS predicted_approval_rate,
    sum(actual_value)::DOUBLE / count(*) AS actual_approval_rate
    FROM loans WHERE {RACE} <> 'HOUSEHOLD' GROUP BY ALL""",
)
def _(spark, sf):
    return rates.annual_rates(loans(spark, sf).filter(F.col(RACE) != "HOUSEHOLD"), ["activity_year", RACE])


_LAG_COLS = ", ".join(
    f"max(CASE WHEN {RACE} = '{g}' THEN y::DOUBLE / n END) AS prior_{g.lower()}" for g in GROUPS
)


@query(
    "lagged_group_rates",
    LOANS
    + f""", r AS (SELECT lender_entity_name, activity_year, {RACE}, count(*) AS n, sum(loan_approved) AS y
      FROM loans GROUP BY ALL),
    l AS (SELECT lender_entity_name, activity_year + 1 AS activity_year, {_LAG_COLS},
      sum(y)::DOUBLE / sum(n) AS prior_overall FROM r GROUP BY lender_entity_name, activity_year),
    g AS (SELECT *, prior_building - greatest(prior_automobile, prior_furniture, prior_machinery) AS prior_gap FROM l)
    SELECT loan_application_id, lender_entity_name, activity_year, prior_automobile, prior_building,
      prior_furniture, prior_household, prior_machinery, prior_overall, prior_gap
    FROM loans LEFT JOIN g USING (lender_entity_name, activity_year)""",
)
def _(spark, sf):
    df = loans(spark, sf)
    prior = rates.prior_rates(df, "lender_entity_name", "prior", groups=GROUPS, overall="prior_overall")
    minority = [f"prior_{g.lower()}" for g in MINORITY]
    prior = prior.withColumn("prior_gap", F.col("prior_building") - F.greatest(*minority))
    return rates.attach_prior(
        df.select("loan_application_id", "lender_entity_name", "activity_year"), prior, "lender_entity_name"
    )


@query(
    "target_encode",
    LOANS
    + """, m AS (SELECT lender_entity_name, sum(loan_approved)::DOUBLE / count(*) AS r FROM loans GROUP BY 1)
    SELECT loan_application_id, r AS lender_te FROM loans JOIN m USING (lender_entity_name)""",
)
def _(spark, sf):
    df = loans(spark, sf).select("loan_application_id", "lender_entity_name", "loan_approved")
    return rates.target_encode(df, "lender_entity_name", "loan_approved", "lender_te").select(
        "loan_application_id", "lender_te"
    )


@query(
    "collapse_rare",
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    lim AS (SELECT CAST(floor(count(*)::DOUBLE / count(DISTINCT p_brand)) AS BIGINT) AS m FROM part)
    SELECT p_partkey, CASE WHEN n < (SELECT m FROM lim) THEN 'Other' ELSE p_brand END AS brand_group FROM c""",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    typical = df.agg(F.floor(F.count(F.lit(1)) / F.count_distinct("p_brand"))).scalar()
    return rates.collapse_rare(df, "p_brand", typical, "brand_group").select("p_partkey", "brand_group")


@query(
    "tract_summary",
    """WITH apps AS (
      SELECT lpad(CAST(l_partkey % 200 AS VARCHAR), 11, '0') AS census_tract, 1 + l_linenumber % 5 AS action_taken,
        CASE l_suppkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 21
          WHEN 6 THEN 27 WHEN 7 THEN 5 END AS race,
        CASE l_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 14 ELSE 2 END AS eth
      FROM lineitem),
    t AS (SELECT census_tract,
      count(*) FILTER (WHERE action_taken = 1) AS "TotalOriginations",
      count(*) FILTER (WHERE action_taken = 1 AND race = 5 AND eth = 2) AS "WhiteNonHispanicOriginations",
      count(*) FILTER (WHERE action_taken = 1 AND race = 3) AS "BlackOriginations",
      count(*) FILTER (WHERE action_taken = 1 AND eth IN (1, 11, 12, 13, 14)) AS "LatinxOriginations",
      count(*) FILTER (WHERE action_taken = 1 AND race IN (2, 4, 21, 22, 23, 24, 25, 26, 27)) AS "AAPIOriginations",
      count(*) AS "Applications", count(*) FILTER (WHERE action_taken = 3) AS "Denials",
      count(*) FILTER (WHERE action_taken IN (4, 5)) AS "Fallout" FROM apps GROUP BY 1)
    SELECT *, round("TotalOriginations"::DOUBLE / "Applications", 6) AS "OriginationRate",
      round("Denials"::DOUBLE / "Applications", 6) AS "DenialRate",
      round("Fallout"::DOUBLE / "Applications", 6) AS "FalloutRate" FROM t""",
)
def _(spark, sf):
    supp, order = F.col("l_suppkey") % 9, F.col("l_orderkey") % 4
    codes = F.create_map(*[F.lit(x) for k, v in enumerate([1, 2, 3, 4, 5, 21, 27, 5]) for x in (k, v)])
    apps = (
        table(spark, sf, "lineitem").select(
            F.lpad((F.col("l_partkey") % 200).cast("string"), 11, "0").alias("census_tract"),
            (F.col("l_linenumber") % 5 + 1).alias("action_taken"),
            codes[supp.cast("int")].alias("applicant_race_1"),
            F.when(order == 0, 1).when(order == 2, 14).otherwise(2).alias("applicant_ethnicity_1"),
        )
    )
    return rates.tract_summary(apps)
