"""Cleaning of full register files and decoding of coded columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lendlens import codes
from lendlens.functions.lending import co_applicant_present, dti_band, units_bucket
from lendlens.functions.text import clean_number, not_exempt, to_whole
from lendlens.operators.schema import enforce_schema
from lendlens.schemas import canonical_lar

# Amount and term fields.
_MONEY = "total_loan_costs total_points_and_fees origination_charges discount_points lender_credits".split()
_TERMS = "loan_term prepayment_penalty_term intro_rate_period".split()


def label_of(code: Column, labels: Mapping[int, str | None]) -> Column:
    """Label of a code, null when the list has none."""
    return _lookup(labels, "string")[code]


def _lookup(values: Mapping[int, object], kind: str) -> Column:
    items = [x for k, v in values.items() for x in (F.lit(k).cast("bigint"), F.lit(v).cast(kind))]
    return F.create_map(*items)


def recoded(code: Column, values: Mapping[int, int | None]) -> Column:
    """Code replaced by its cleaned value; codes not listed stay."""
    if not values:
        return code
    return F.when(code.isin(list(values)), _lookup(values, "bigint")[code]).otherwise(code)


def replace_and_map(df: DataFrame, column: str, mapping: Mapping[int, tuple[str | None, int | None]]) -> DataFrame:
    """Code to (label, value): adds ``<column>_category`` and replaces the code."""
    code = to_whole(F.col(column))
    return df.withColumns(
        {
            f"{column}_category": label_of(code, {k: v[0] for k, v in mapping.items()}),
            column: _lookup({k: v[1] for k, v in mapping.items()}, "bigint")[code],
        }
    )


def clean_lar(
    df: DataFrame, income_scale: float = 1000, race_groups: Mapping[int, str] | None = None
) -> DataFrame:
    """Typed, decoded and validated register rows from any mix of text and numeric input columns.

    Every code list is one map lookup, all in a single projection. Ages of 8888 and 9999 blank only
    the age. Columns of the canonical schema that the file lacks are added as typed nulls.
    """
    have = set(df.columns)
    groups = race_groups or codes.RACE_GROUP
    out: dict[str, Column] = {c: F.col(c) for c in df.columns}

    for name, (labels, values) in codes.CODED.items():
        if name in have:
            code = to_whole(F.col(name))
            out[f"{name}_category"] = label_of(code, labels)
            out[name] = recoded(code, values)
            if "_race_" in name and not name.endswith("observed"):
                out[f"{name}_category_grouped"] = label_of(code, groups)
    for name, (label, table) in codes.LABELLED.items():
        if name in have:
            out[name] = to_whole(F.col(name))
            out[label] = label_of(to_whole(F.col(name)), table)
    if "preapproval" in have:
        out["preapproval"] = recoded(to_whole(F.col("preapproval")), {2: 0})
    if "conforming_loan_limit" in have:
        limit = F.col("conforming_loan_limit").cast("string")
        out["conforming_loan_limit"] = F.when(limit == "C", 1).when(limit == "NC", 0).otherwise(to_whole(limit))
    for name in ["loan_to_value_ratio", "combined_loan_to_value_ratio", "interest_rate", "rate_spread", *_MONEY]:
        if name in have:
            out[name] = clean_number(F.col(name))
    ltv = [out[c] for c in ("loan_to_value_ratio", "combined_loan_to_value_ratio") if c in have]
    if ltv:
        out["effective_ltv"] = F.coalesce(*ltv)
    for name in [*_TERMS, "property_value"]:
        if name in have:
            out[name] = to_whole(not_exempt(F.col(name).cast("string")))
    if "multifamily_affordable_units" in have:
        out["multifamily_affordable_units"] = F.coalesce(to_whole(F.col("multifamily_affordable_units")), F.lit(0))
    if "total_units" in have:
        out["total_units_bucketed"] = units_bucket(F.col("total_units").cast("string"))
    if "income" in have:
        out["income"] = clean_number(F.col("income")) * F.lit(float(income_scale))
    if "debt_to_income_ratio" in have:
        out["debt_to_income_ratio"] = dti_band(F.col("debt_to_income_ratio").cast("string"))
    for who in ("applicant", "co_applicant"):
        if f"{who}_age" in have:
            age = F.regexp_replace(F.col(f"{who}_age").cast("string"), r"\.0$", "")
            out[f"{who}_age"] = F.when(~age.isin("8888", "9999"), age)
        if f"{who}_age_above_62" in have:
            above = F.col(f"{who}_age_above_62").cast("string")
            out[f"{who}_age_above_62"] = F.when(above == "Yes", 1).when(above == "No", 0).otherwise(to_whole(above))
    if "co_applicant_ethnicity_1" in have:
        out["co_applicant_present"] = co_applicant_present(to_whole(F.col("co_applicant_ethnicity_1"))).cast("bigint")
    cleaned = df.select(*[c.alias(n) for n, c in out.items()])
    return enforce_schema(cleaned, canonical_lar(), keep_extra=True)


def decode(df: DataFrame, dim: DataFrame, lookups: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Labels for several coded columns from one long (column_name, category_value, category_title) table.

    ``lookups`` maps an output name to (code column, ``column_name`` in the table). The table is
    folded into one map per code column, so the big side is read once and never shuffled; a code
    list is bounded by the register's published codes.
    """
    wanted = dim.filter(F.col("column_name").isin([n for _, n in lookups.values()]))
    folded = (
        wanted.filter("category_value is not null")
        .dropDuplicates(["column_name", "category_value"])
        .agg(
            *[
                F.map_from_entries(
                    F.collect_list(
                        F.when(
                            F.col("column_name") == name,
                            F.struct(F.col("category_value").cast("int"), F.col("category_title")),
                        )
                    )
                ).alias(out)
                for out, (_, name) in lookups.items()
            ]
        )
        .select(F.struct("*").alias("maps"))
        .scalar()
    )
    with_maps = df.withColumn("__maps", folded)
    return with_maps.select(
        *df.columns,
        *[F.col("__maps")[out][F.col(code).try_cast("int")].alias(out) for out, (code, _) in lookups.items()],
    )
