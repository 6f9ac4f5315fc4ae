"""Expressions specific to loan applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lendlens.functions.numbers import stepped

# Action codes.
APPROVED_ACTIONS = [1, 2]
FILTERED_ACTIONS = [1, 2, 3, 7, 8]
DECIDED_ACTIONS = [1, 2, 3]
FALLOUT_ACTIONS = [4, 5]

# Race groups compared with the reference group.
REFERENCE_GROUP = "White"
MINORITY_GROUPS = ["Latinx", "Black", "AAPI"]
UNKNOWN_GROUP = "Unknown"

# Tract ids produced by padding a textual NA.
BAD_TRACTS = ["000000000Na", "000000000nA"]


def approved(action: Column) -> Column:
    return F.coalesce(action.isin(APPROVED_ACTIONS), F.lit(False)).cast("int")


def dti_number(c: Column) -> Column:
    """First whole number of a range or percent text, else the number itself, else null."""
    return F.when(c.rlike("[<%-]"), F.regexp_substr(c, F.lit(r"\d+")).try_cast("double")).otherwise(
        c.try_cast("double")
    )


def dti_band(c: Column) -> Column:
    """Band text for a whole-number ratio; text that is already a band passes through."""
    x = c.try_cast("int")
    banded = stepped(
        x,
        # Published debt-to-income bands.
        [
            (20, "<20%"),
            (30, "20%-<30%"),
            (36, "30%-<36%"),
            (40, "36%-<40%"),
            (46, "40%-<46%"),
            (50, "46%-<50%"),
            (61, "50%-60%"),
        ],
        ">60%",
    )
    return F.when(c.isin("nan", "Exempt"), None).otherwise(F.when(x.isNotNull(), banded).otherwise(c))


def dti_bin(c: Column) -> Column:
    return F.when((c >= 0) & (c < 100), stepped(c, [(30, "Low"), (40, "Medium"), (50, "High")], "Very High"))


def minority_bin(c: Column) -> Column:
    steps = [(20, "Low Minority"), (50, "Moderate Minority"), (80, "High Minority")]
    return stepped(c, steps, "Very High Minority")


def gini_bin(c: Column) -> Column:
    return stepped(c, [(0.3, "Low Inequality"), (0.5, "Moderate Inequality")], "High Inequality")


def bachelors_bin(c: Column) -> Column:
    return stepped(c, [(15, "Low"), (30, "Moderate"), (50, "High")], "Very High")


def units_bucket(c: Column) -> Column:
    """1 to 4 as text, everything else '5+', missing 'Unknown'."""
    n = c.try_cast("double").try_cast("int")
    return F.when(c.isNull(), "Unknown").when(n <= 4, n.cast("string")).otherwise("5+")


def purpose_group(code: Column) -> Column:
    return (
        F.when(code == 1, "Home Purchase")
        .when(code == 2, "Home Improvement")
        .when(code.isin(31, 32), "Refinancing")
        .when(code == 4, "Other")
        .otherwise("Not Applicable")
    )


def registration_group(status: Column) -> Column:
    up = F.upper(status)
    return F.when(up.isin("RETIRED", "DUPLICATE", "ERROR"), "OTHER").otherwise(up)


def sex_group(label: Column) -> Column:
    return (
        F.when(label.isin("Female", "Male"), label)
        .when(label == "information not provided", "Unknown")
        .otherwise("Other")
    )


def or_unknown(c: Column, label: str = UNKNOWN_GROUP) -> Column:
    return F.coalesce(c.cast("string"), F.lit(label))


def derived_race(ethnicity: Column, race: Column) -> Column:
    """One group per applicant from the ethnicity and race labels.

    A usable race counts unless the ethnicity is Latinx or unrecognised; with no usable race the
    group is missing when the ethnicity says nothing either.
    """
    usable = race.isNotNull() & ~race.isin("not provided", "not applicable")
    yields_to_race = (
        ethnicity.isNull()
        | ethnicity.isin("not applicable", "information not provided")
        | ethnicity.like("Not hisp%")
        | ethnicity.like("no co%")
    )
    silent = ethnicity.isNull() | ethnicity.isin(
        "not applicable", "information not provided", "Not hispanic or latinx"
    )
    return (
        F.when(usable & yields_to_race, race)
        .when(F.coalesce(~usable, F.lit(True)) & silent, None)
        .when(ethnicity == "Latinx", "Latinx")
        .otherwise("not a match")
    )


def white_non_hispanic(race: Column, ethnicity: Column, not_hispanic: int = 2) -> Column:
    return F.coalesce((race == 5) & (ethnicity == not_hispanic), F.lit(False))


def distress_flags(columns: Sequence[str]) -> tuple[Column, Column]:
    """(is_distressed, is_underserved) from the X marks of either published file layout."""
    mark = lambda name: F.coalesce(F.upper(F.col(name)) == "X", F.lit(False))
    if "distressed" in columns:
        return mark("distressed").cast("int"), mark("under_served").cast("int")
    return (
        (mark("poverty") | mark("unemployment") | mark("population_loss")).cast("int"),
        mark("remote_rural").cast("int"),
    )


def co_applicant_present(co_ethnicity: Column, absent_code: int = 5) -> Column:
    return (co_ethnicity != absent_code).cast("int")
