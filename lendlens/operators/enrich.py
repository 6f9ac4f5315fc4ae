"""Reference tables and their attachment to applications.

Dimensions are joined without hints: they are read from files or settled tables, so Spark knows their
size, broadcasts the small ones and shuffles the rest with adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lendlens.operators.ranks import best_row, descending, ntile
from lendlens.shared import settle

MARKET_MEASURES = (
    "median_sale_price median_sale_price_year_over_year median_price_per_square_foot "
    "median_price_per_square_foot_year_over_year median_list_price median_list_price_year_over_year "
    "inventory new_listings median_days_on_market"
).split()
CENSUS_MEASURES = (
    "median_household_income white_population_pct black_population_pct latinx_population_pct "
    "minority_population_pct bachelors_degree_population_pct graduate_degree_population_pct "
    "pct_bachelors_or_higher total_population_below_poverty_level_pct "
    "total_population_receiving_federal_assistance_pct gini_index_of_income_inequality"
).split()


def market_yearly(
    market: DataFrame, zip_code: str = "zip_code", date: str = "period_begin", measures: Sequence[str] = tuple(MARKET_MEASURES)
) -> DataFrame:
    """Mean of each measure per (zip, year)."""
    return market.groupBy(zip_code, F.year(date).alias("year")).agg(*[F.avg(m).alias(f"avg_{m}") for m in measures])


def income_buckets(acs: DataFrame, buckets: int = 4) -> DataFrame:
    """Income quartile of each tract; tracts without an income sort last."""
    narrow = acs.select("census_tract", "median_household_income")
    order = [F.isnull("median_household_income"), F.col("median_household_income"), F.col("census_tract")]
    return ntile(narrow, order, buckets, "income_bucketed")


def latest_row(df: DataFrame, key: str, period: str) -> DataFrame:
    return best_row(df, [key], [descending(period)])


def best_zip(crosswalk: DataFrame, market: DataFrame) -> DataFrame:
    """One zip per tract among those with market data: residential share, then lowest zip."""
    known = market.select("zip_code").distinct()
    share = F.col("residential_ratio")
    ranked = best_row(
        crosswalk.join(known, "zip_code", "left_semi"),
        ["census_tract"],
        [descending((F.coalesce(share, F.lit(0.0)) > 0).cast("int")), descending(share), F.col("zip_code")],
    )
    return ranked.select(
        "census_tract", "zip_code", "city_name", F.col("state_name").alias("state_postal_code"), "residential_ratio"
    )


def enrich_census(apps: DataFrame, acs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Census measures and income bucket by tract; applications without a tract are dropped."""
    dim = acs.select("census_tract", *CENSUS_MEASURES).join(
        buckets.select("census_tract", "income_bucketed"), "census_tract", "left"
    )
    return apps.filter(F.col("census_tract").isNotNull()).join(dim, "census_tract", "left")


def enrich_market(apps: DataFrame, zips: DataFrame, yearly: DataFrame) -> DataFrame:
    """Zip of the tract, then that zip's market means for the application year.

    The tract-to-zip hop is resolved between the two small tables, so the big side joins once.
    """
    by_tract = zips.select("census_tract", "zip_code").join(yearly, "zip_code")
    dim = settle(by_tract.withColumnRenamed("year", "activity_year"))
    return apps.join(dim, ["census_tract", "activity_year"], "left")


def enrich_distress(apps: DataFrame, flags: DataFrame) -> DataFrame:
    dim = flags.select("census_tract", F.col("report_year").alias("activity_year"), "is_distressed", "is_underserved")
    return apps.join(dim, ["census_tract", "activity_year"], "left")


def attach_upper(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join on a key compared without regard to case.

    Rows of ``dim`` whose keys differ by case only count as one: the fullest, then the smallest. The
    rows of ``df`` are never multiplied.
    """
    named = best_row(dim.withColumn("__k", F.upper(dim_key)).drop(dim_key), ["__k"])
    return df.withColumn("__k", F.upper(key)).join(named, "__k", "left").drop("__k")


def fill_state(df: DataFrame, fips: DataFrame) -> DataFrame:
    """State and county from the tract id where missing; rows without a state are dropped."""
    dim = fips.select(F.col("fips").alias("__fips"), F.col("usps").alias("__usps"))
    padded = F.lpad("census_tract", 11, "0")
    joined = df.join(dim, F.substring(padded, 1, 2) == F.col("__fips"), "left")
    filled = joined.withColumns(
        {
            "state_code": F.coalesce("state_code", "__usps"),
            "county_code": F.coalesce("county_code", F.substring("census_tract", 3, 3)),
        }
    )
    return filled.filter(F.col("state_code").isNotNull()).select(*df.columns)


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def missing_keys(df: DataFrame, key: str, enriched: str) -> DataFrame:
    """Distinct keys whose enrichment found nothing."""
    return df.filter(F.col(enriched).isNull()).select(key).distinct()


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
