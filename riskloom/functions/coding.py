"""Codes, labels and typed fields from free-form record values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as C
from riskloom.functions.text import has_any
from riskloom.plans.lookup import map_default


def status_label(status: Column, failed: Sequence[str] = C.FAILED_STATUSES) -> Column:
    """1 for a failed status, ignoring case; null counts as not failed."""
    return F.coalesce(F.upper(status).isin(*failed), F.lit(False)).cast("int")


def phase_encode(phases: Column) -> Column:
    """Code of the first listed phase; 0 when there is none or it is unknown."""
    first = F.upper(F.try_element_at(phases, F.lit(1)))
    code = F.lit(0)
    for digit in (4, 3, 2, 1):
        hit = F.contains(first, F.lit(f"PHASE{digit}")) | F.contains(first, F.lit(f"PHASE {digit}"))
        code = F.when(hit, digit).otherwise(code)
    return code


def phase_parse(text: Column, mode: str) -> Column:
    """Phase name from free text. ``last``: highest digit wins; ``first``: 1, 3, 4, else 2."""
    orders = {"last": (4, 3, 2, 1), "first": (1, 3, 4)}
    name = F.lit(None).cast("string")
    for digit in reversed(orders[mode]):
        name = F.when(F.contains(text, F.lit(str(digit))), f"Phase {digit}").otherwise(name)
    return F.coalesce(name, F.lit(C.DEFAULT_PHASE))


def phase_code(name: Column) -> Column:
    return map_default(C.PHASE_CODES, name, C.DEFAULT_PHASE_CODE, "string", "double")


def phase_name(code: Column) -> Column:
    names = {code_: name for name, code_ in C.PHASE_CODES.items()}
    return map_default(names, code.cast("double"), C.DEFAULT_PHASE, "double", "string")


def expected_enrollment(code: Column) -> Column:
    return map_default(C.EXPECTED_ENROLLMENT, code.cast("double"), C.DEFAULT_EXPECTED)


def enrollment_ratio(size: Column, phase: Column) -> Column:
    return size.cast("double") / expected_enrollment(phase)


def enrollment_deficit(size: Column, phase: Column) -> Column:
    actual = F.coalesce(size.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), expected_enrollment(phase) - actual)


def flatten_outcomes(outcomes: Column, separator: str = " | ") -> Column:
    """``measure: description`` of every element, missing parts empty."""
    lines = F.transform(
        outcomes,
        lambda o: F.concat(
            F.coalesce(o["measure"], F.lit("")), F.lit(": "), F.coalesce(o["description"], F.lit(""))
        ),
    )
    return F.coalesce(F.array_join(lines, separator), F.lit(""))


def struct_or_scalar(value: Column, field: str, target: str) -> Column:
    """Of a VARIANT: the named field when it is an object, else the scalar itself."""
    nested = F.try_variant_get(value, f"$.{field}", target)
    return F.coalesce(nested, F.try_variant_get(value, "$", target))


def size_or_one(value: Column, data_type: T.DataType) -> Column:
    """Length of a list; another value counts 1 and null 0."""
    size = F.size(value) if isinstance(data_type, T.ArrayType) else F.lit(1)
    return F.when(value.isNull(), 0).otherwise(size).cast("int")


def coalesce_alias(df: DataFrame, candidates: Sequence[str], default) -> Column:
    """First non-null of the candidate columns the table has, else the default."""
    present = [F.col(f"`{name}`") for name in candidates if name in df.columns]
    return F.coalesce(*present, F.lit(default))


def truthy(value: Column) -> Column:
    return F.coalesce(value.cast("boolean"), F.lit(False)).cast("int")


def flag_or_text(flag: Column, text: Column, keywords: Sequence[str], raising: Sequence[str]) -> Column:
    """An explicit flag, else a keyword test; the raising words set a false flag too."""
    return F.coalesce(flag, has_any(text, keywords)) | has_any(text, raising)


def equals_flag(value: Column, wanted: str) -> Column:
    return F.coalesce(F.upper(value) == F.lit(wanted), F.lit(False)).cast("int")
