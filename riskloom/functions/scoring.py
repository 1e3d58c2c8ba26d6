"""Risk tiers, size adjustment and change descriptions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions.coding import enrollment_ratio
from riskloom.functions.numbers import clip
from riskloom.plans.lookup import map_default


def risk_tier(probability: Column, threshold, mode: str = "additive") -> Column:
    """Tier of a probability around the decision threshold.

    ``additive`` puts the bounds a fixed margin away from it, ``proportional``
    a fixed factor. The threshold may be a number or a column.
    """
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if mode == "additive":
        high, low = cut + C.TIER_MARGIN, cut - C.TIER_MARGIN
    elif mode == "proportional":
        high, low = cut * C.TIER_HIGH_FACTOR, cut * C.TIER_LOW_FACTOR
    else:
        raise ValueError(f"unknown tier mode {mode!r}")
    return F.when(probability >= high, C.HIGH).when(probability >= low, C.MEDIUM).otherwise(C.LOW)


def tier_color(tier: Column) -> Column:
    return map_default(C.TIER_COLORS, tier, "#555555", "string", "string")


def ensemble_average(structured: Column, text: Column) -> Column:
    """Mean of the two probabilities; without a text one the structured one stands."""
    return (structured + F.coalesce(text, structured)) / F.lit(2.0)


def size_shift(size: Column, phase: Column) -> Column:
    """Probability shift by the ratio of size to the size expected in the phase."""
    ratio = enrollment_ratio(size, phase)
    shift = F.lit(C.ENROLLMENT_BAND_ABOVE)
    for bound, included, value in reversed(C.ENROLLMENT_BANDS):
        inside = ratio <= bound if included else ratio < bound
        shift = F.when(inside, F.lit(value)).otherwise(shift)
    return shift


def enrollment_adjust(probability: Column, size: Column, phase: Column) -> Column:
    return clip(probability + size_shift(size, phase), *C.PROBABILITY_RANGE)


def describe_changes(before: Column, after: Column) -> Column:
    """Map of the keys whose values differ, with both values; absent means null."""
    both = F.map_zip_with(
        before, after, lambda key, old, new: F.struct(old.alias("from"), new.alias("to"))
    )
    return F.map_filter(both, lambda key, pair: ~pair["from"].eqNullSafe(pair["to"]))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def linear_margin(columns: Mapping[str, Column], coefficients: Mapping[str, float], intercept: float) -> Column:
    """Intercept plus weighted columns, summed in the order of the coefficients."""
    margin = F.lit(float(intercept))
    for name, weight in coefficients.items():
        margin = margin + F.lit(float(weight)) * columns[name]
    return margin
