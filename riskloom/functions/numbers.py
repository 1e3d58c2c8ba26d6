"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Round half up by plain double arithmetic, the same in every engine."""
    scale = float(10**places)
    return F.floor(value.cast("double") * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def units_half_even(value: Column, places: int) -> Column:
    """The size of a number in units of its last place, a tie going to the even unit.

    What the product with the scale loses is computed exactly, so a tie is one
    of the number's true value, not of its rounded product.
    """
    scale = float(10**places)
    size = F.abs(value.cast("double"))
    product = size * scale
    # Halves of 26 bits, whose products with the scale are exact.
    high = size * 134217729.0 - (size * 134217729.0 - size)
    lost = (high * scale - product) + (size - high) * scale
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    return whole + F.when(up, 1).otherwise(0)


def half_even(value: Column, places: int) -> Column:
    """Round half to even; what rounds to zero is 0.0 without a sign."""
    units = units_half_even(value, places)
    return F.when(value < 0, -units).otherwise(units).cast("double") / F.lit(float(10**places))


def fixed(value: Column, places: int, signed: bool = False) -> Column:
    """Text of a number with a fixed count of decimals, half to even, optionally with its sign."""
    scale = 10**places
    units = units_half_even(value, places)
    whole = F.floor(units / F.lit(scale)).cast("bigint").cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((units % F.lit(scale)).cast("string"), places, "0"))
    return F.concat(F.when(value < 0, "-").otherwise("+" if signed else ""), text)


def percent(value: Column, places: int = 0) -> Column:
    """A probability as a percentage text."""
    if places:
        return F.concat(fixed(value * 100.0, places), F.lit("%"))
    return F.concat(whole_percent(value).cast("string"), F.lit("%"))


def whole_percent(value: Column) -> Column:
    return half_even(value * 100.0, 0).cast("int")


def clip(value: Column, low, high) -> Column:
    """Clamp to a closed range; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def parse_number(text: Column, default: int) -> Column:
    """Whole number from text with thousands commas; bad text gives the default."""
    plain = F.regexp_replace(text, ",", "")
    return F.coalesce(plain.try_cast("double").try_cast("int"), F.lit(default))


def metric_round(value: Column, places: int = 4) -> Column:
    """Round half to even, as metric reports do."""
    return F.bround(value, places)


def log_size(size: Column) -> Column:
    return F.log1p(size.cast("double"))


def delta_direction(delta: Column) -> Column:
    return (
        F.when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("unchanged")
    )
