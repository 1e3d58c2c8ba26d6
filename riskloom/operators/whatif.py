"""Rescoring every record under every scenario, in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import coding, numbers, scoring
from riskloom.operators.joins import scenario_cross


def apply_scenario(crossed: DataFrame) -> DataFrame:
    """Override the four scenario parameters and the features that depend on them."""
    size, phase = F.col("scenario_enrollment"), coding.phase_code(F.col("scenario_phase"))
    overrides = {
        "log_enrollment": numbers.log_size(size),
        "phase_encoded": phase,
        "has_multicenter": F.col("scenario_multicenter").cast("int"),
        "has_placebo": F.col("scenario_has_placebo").cast("int"),
        "enrollment_ratio": coding.enrollment_ratio(size, phase),
    }
    return crossed.withColumns(overrides)


def whatif_rescore(
    base: DataFrame,
    scenarios: Sequence[Mapping],
    score: Callable[[DataFrame], DataFrame],
    threshold: float,
    mode: str = "proportional",
) -> DataFrame:
    """Probability, tier and change of every record in every scenario.

    ``base`` holds the features, the current ``probability`` and the known text
    probability ``p_text`` (or null). ``score`` adds ``p_struct`` to a feature
    table. Text features are reused; nothing is shuffled.
    """
    changed = score(apply_scenario(scenario_cross(base, scenarios)))
    averaged = scoring.ensemble_average(F.col("p_struct"), F.col("p_text"))
    return (
        changed.withColumn(
            "new_probability",
            scoring.enrollment_adjust(averaged, F.col("scenario_enrollment"), F.col("phase_encoded")),
        )
        .withColumn("new_tier", scoring.risk_tier(F.col("new_probability"), threshold, mode))
        .withColumn("delta", F.col("new_probability") - F.col("probability"))
        .withColumn("direction", numbers.delta_direction(F.col("delta")))
    )
