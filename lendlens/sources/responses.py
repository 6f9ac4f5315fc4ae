"""Parsers for landed API responses and the registry's golden copy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlens.schemas import CENSUS_CODES, CROSSWALK_NAMES, CROSSWALK_RESPONSE, LEI_RESPONSE


def read_documents(spark: SparkSession, path) -> DataFrame:
    """One row per file with its whole text as ``body``."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body")


def parse_acs_json(
    df: DataFrame, header: list[str], body: str = "body", code_map: Mapping[str, str] = CENSUS_CODES
) -> DataFrame:
    """Census response (array of arrays, header row first) to typed rows.

    ``header`` is the requested field order. Every response repeats it as its first row, which is
    dropped; measures that do not parse become null.
    """
    rows = df.select(F.posexplode(F.from_json(body, "array<array<string>>")).alias("pos", "r")).filter("pos > 0")
    counts = {v for v in code_map.values() if v != "gini_index_of_income_inequality"}
    out = []
    for i, code in enumerate(header):
        name = code_map.get(code, code.lower())
        value = F.col("r")[i]
        if name in counts:
            value = value.try_cast("double").try_cast("bigint")
        elif name in code_map.values():
            value = value.try_cast("double")
        out.append(value.alias(name))
    return rows.select(*out)


def parse_crosswalk_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Tract-to-zip response: one row per entry of ``data.results``, fields renamed."""
    parsed = df.select(F.from_json(body, CROSSWALK_RESPONSE).alias("j"))
    return parsed.select(F.explode("j.data.results").alias("r")).select("r.*").withColumnsRenamed(CROSSWALK_NAMES)


def parse_lei_json(df: DataFrame, requested: DataFrame, lei: str = "lei", body: str = "body") -> DataFrame:
    """Registry lookups (lei, body) for every requested id; a failed lookup has status ``Error``."""
    j = F.from_json(body, LEI_RESPONSE)["data"]["attributes"]
    entity, registration = j["entity"], j["registration"]
    found = df.filter(F.col(body).isNotNull()).select(
        F.col(lei),
        entity["legalName"]["name"].alias("entity_name"),
        registration["status"].alias("registration_status"),
        entity["legalJurisdiction"].alias("legal_jurisdiction"),
        entity["entityCategory"].alias("entity_category"),
        registration["initialRegistrationDate"].alias("registration_initial_date"),
        registration["lastUpdateDate"].alias("registration_last_update"),
        entity["headquartersAddress"]["addressLines"].alias("headquarters_address"),
        j["bic"].alias("bic"),
        F.lit(True).alias("__found"),
    )
    joined = requested.select(lei).distinct().join(found, lei, "left")
    status = F.when(F.col("__found"), F.col("registration_status")).otherwise("Error")
    return joined.withColumn("registration_status", status).drop("__found")


def filter_registry(registry: DataFrame, loans: DataFrame, registry_id: str = "LEI", loan_id: str = "lei") -> DataFrame:
    """Registry rows whose id occurs in the loans."""
    ids = loans.select(F.col(loan_id).alias("__id")).distinct()
    return registry.join(ids, registry[registry_id] == ids["__id"], "left_semi")


def clean_distressed(df: DataFrame, year=None) -> DataFrame:
    """Distressed-tract marks to tract ids and flags; rows without a numeric tract are dropped."""
    from lendlens.functions.lending import distress_flags
    from lendlens.functions.text import fips_tract, whole_code

    distressed, underserved = distress_flags(df.columns)
    codes = {
        "tract_fips": fips_tract(F.col("state_code"), F.col("county_code"), F.col("tract_code")),
        "state_code": whole_code(F.col("state_code"), 2),
        "county_code": whole_code(F.col("county_code"), 3),
        "tract_code": whole_code(F.regexp_replace("tract_code", "[.]", ""), 6),
        "is_distressed": distressed,
        "is_underserved": underserved,
    }
    if year is not None:
        codes["report_year"] = year if not isinstance(year, int) else F.lit(year)
    return df.withColumns(codes).filter(F.col("tract_fips").isNotNull())


def ring_centroids(vertices: DataFrame, tract: str = "tract_fips") -> DataFrame:
    """Planar centroid per tract from ring vertices (tract, ring_id, seq, lon, lat).

    Shoelace sums over edges; holes with opposite orientation subtract. An edge needs only its next
    vertex in the same ring, so windows are as small as one ring.
    """
    from pyspark.sql import Window as W

    ring = W.partitionBy(tract, "ring_id").orderBy("seq")
    whole = W.partitionBy(tract, "ring_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = vertices.select(
        tract,
        "lon",
        "lat",
        F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole)).alias("lon2"),
        F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole)).alias("lat2"),
    )
    cross = F.col("lon") * F.col("lat2") - F.col("lon2") * F.col("lat")
    sums = edges.groupBy(tract).agg(
        F.sum(cross).alias("a"),
        F.sum((F.col("lon") + F.col("lon2")) * cross).alias("x"),
        F.sum((F.col("lat") + F.col("lat2")) * cross).alias("y"),
    )
    area = F.nullif(F.col("a") * 3, F.lit(0.0))
    return sums.select(tract, (F.col("y") / area).alias("centroid_lat"), (F.col("x") / area).alias("centroid_lon"))
