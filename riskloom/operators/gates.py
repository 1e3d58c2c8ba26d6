"""Data quality gates: tables of (rule, value, ok), raised only on demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as C
from riskloom.operators.joins import alignment_audit


def _rules(row: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.expr(value).cast("double").alias("value"),
                F.coalesce(F.expr(test), F.lit(False)).alias("ok"),
            )
            for name, value, test in rules
        ]
    )
    return row.select(F.explode(items).alias("_g")).select("_g.*")


def min_rows_gate(rows: DataFrame, minimum: int = C.MIN_RECORDS) -> DataFrame:
    counted = rows.agg(F.count(F.lit(1)).alias("n"))
    return _rules(counted, [("min_rows", "n", f"n >= {minimum}")])


def null_gate(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, all columns in one aggregate."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    counts = []
    for c in columns:
        missing = F.col(c).isNull()
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            missing = missing | F.isnan(c)
        counts.append(F.count_if(missing).alias(c))
    row = rows.agg(*counts)
    return _rules(row, [(f"no_missing:{c}", f"`{c}`", f"`{c}` = 0") for c in columns])


def split_gate(
    rows: DataFrame,
    split: str,
    label: str,
    share: tuple[float, float] = (0.75, 0.85),
    min_positive: float = 0.05,
) -> DataFrame:
    """Train share within bounds, and enough positives on both sides."""
    number = F.col(label).cast("double")
    row = rows.agg(
        F.avg(F.when(F.col(split) == "train", 1.0).otherwise(0.0)).alias("share"),
        F.avg(F.when(F.col(split) == "train", number)).alias("train"),
        F.avg(F.when(F.col(split) == "test", number)).alias("test"),
    )
    return _rules(
        row,
        [
            ("train_share", "share", f"share between {share[0]} and {share[1]}"),
            ("train_positive_rate", "train", f"train >= {min_positive}"),
            ("test_positive_rate", "test", f"test >= {min_positive}"),
        ],
    )


def numeric_gate(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each column is numeric by the schema, with its count of values."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    row = rows.agg(*[F.count(c).alias(c) for c in columns])
    return _rules(
        row,
        [
            (f"numeric:{c}", f"`{c}`", str(isinstance(types[c], T.NumericType)).lower())
            for c in columns
        ],
    )


def alignment_gate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    audit = alignment_audit(left, right, key)
    return _rules(
        audit,
        [
            ("no_left_only_keys", "left_only_keys", "left_only_keys = 0"),
            ("no_right_only_keys", "right_only_keys", "right_only_keys = 0"),
            ("equal_rows", "left_rows - right_rows", "left_rows = right_rows"),
        ],
    )


def require(gates: DataFrame) -> None:
    """Raise with every failed rule; a gate table has one row per rule."""
    failed = [f"{g['rule']} = {g['value']}" for g in gates.filter("not ok").collect()]
    if failed:
        raise ValueError("quality gate failed: " + "; ".join(failed))
