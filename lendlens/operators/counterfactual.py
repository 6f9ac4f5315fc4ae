"""What a model would say had the applicant belonged to another group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from lendlens.functions.lending import UNKNOWN_GROUP
from lendlens.functions.text import swap_group
from lendlens.operators.rates import RACE

GROUPS = ["White", "Black", "Latinx", "AAPI"]
LABELS = ("race_state_interaction", "distressed_or_underserved_race")


def near_threshold(scored: DataFrame, low: float = 0.4, high: float = 0.6, group: str = RACE) -> DataFrame:
    """Denied by the model but close to approval, group known."""
    return scored.filter(
        F.col("score").between(low, high) & (F.col("predicted_label") == 0) & (F.col(group) != UNKNOWN_GROUP)
    )


def flip_groups(
    df: DataFrame, groups: Sequence[str] = tuple(GROUPS), group: str = RACE, labels: Sequence[str] = LABELS
) -> DataFrame:
    """One row per other group, with the group and every label that contains it rewritten together.

    The fan-out is at most the number of groups per row and needs no shuffle. ``original_race`` and
    ``new_race`` are added.
    """
    others = df.withColumn("new_race", F.explode(F.array(*[F.lit(g) for g in groups]))).filter(
        F.col("new_race") != F.col(group)
    )
    swapped = {n: swap_group(F.col(n), F.col("original_race"), F.col("new_race")) for n in labels if n in df.columns}
    return others.withColumn("original_race", F.col(group)).withColumns({**swapped, group: F.col("new_race")})


def counterfactual(
    scored: DataFrame,
    rescore: Callable[[DataFrame], DataFrame],
    groups: Sequence[str] = tuple(GROUPS),
    group: str = RACE,
    id_column: str = "loan_application_id",
) -> DataFrame:
    """Scores before and after each group change. ``rescore`` adds a fresh ``score`` column."""
    flipped = flip_groups(scored.withColumnRenamed("score", "previous_score"), groups, group)
    fresh = F.col("score").cast("double")
    return rescore(flipped).select(
        id_column,
        "original_race",
        "new_race",
        "previous_score",
        fresh.alias("counterfactual_score"),
        (fresh - F.col("previous_score")).alias("score_change"),
    )
