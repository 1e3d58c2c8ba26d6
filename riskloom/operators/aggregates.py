"""Grouped and whole-table summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as C
from riskloom.plans.ranges import exact_quantiles


def median_by_group(rows: DataFrame, group: str, value: str, ranges: int | None = None) -> DataFrame:
    """Exact median of the positive values of each group."""
    return exact_quantiles(rows.filter(F.col(value) > 0), value, {"median_value": 0.5}, [group], ranges)


def default_medians(rows: DataFrame, group: str) -> DataFrame:
    """The medians to use where a table has no positive value at all."""
    return rows.sparkSession.createDataFrame(
        list(C.EXPECTED_ENROLLMENT.items()), f"{group} double, median_value double"
    )


def impute_group_median(
    rows: DataFrame,
    medians: DataFrame,
    group: str,
    value: str,
    output: str,
    default: float = C.DEFAULT_EXPECTED,
) -> DataFrame:
    """Replace zero values by the fitted median of their group; ``medians`` has a row per group."""
    known = rows.join(medians.select(group, "median_value"), group, "left")
    number = F.col(value).cast("double")
    filled = F.when(number == 0, F.coalesce("median_value", F.lit(default))).otherwise(number)
    return known.withColumn(output, filled).drop("median_value")


def rate_by_group(rows: DataFrame, group: str, flag: Column | str, top: int | None = None) -> DataFrame:
    """Mean flag per group; the ``top`` highest rates when asked."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    rates = rows.groupBy(group).agg(
        F.avg(flag.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    return rates.orderBy(F.desc("rate"), F.asc(group)).limit(top) if top else rates


def value_counts(rows: DataFrame, column: str, top: int | None = 20) -> DataFrame:
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(top) if top else counts


def class_balance(rows: DataFrame, label: Column, warn_below: float = 20.0) -> DataFrame:
    """Row count, share of both classes in percent, and an imbalance warning."""
    shares = rows.agg(
        F.count(F.lit(1)).alias("total"),
        (F.avg(F.when(label == 1, 1.0).otherwise(0.0)) * 100.0).alias("positive_pct"),
        (F.avg(F.when(label == 0, 1.0).otherwise(0.0)) * 100.0).alias("negative_pct"),
    )
    low = F.least("positive_pct", "negative_pct") < warn_below
    return shares.withColumn("imbalanced", F.coalesce(low, F.lit(False)))


def _unpivot(row: DataFrame, names: Sequence[str], fields: Sequence[str], prefix: Sequence[Column] = ()) -> DataFrame:
    """Turn one wide row of ``<name>|<field>`` columns into a row per name."""
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("column"),
                *[F.col(f"`{name}|{field}`").alias(field) for field in fields],
            )
            for i, name in enumerate(names)
        ]
    )
    return row.select(*prefix, F.explode(items).alias("_i")).select(*[c for c in prefix], "_i.*")


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order, type, smallest and largest value of numeric columns, in one aggregate."""
    types = dict(rows.dtypes)
    ends = []
    for c in columns:
        ends += [
            F.min(F.col(c).cast("double")).alias(f"{c}|min_value"),
            F.max(F.col(c).cast("double")).alias(f"{c}|max_value"),
            F.lit(types[c]).alias(f"{c}|dtype"),
        ]
    return _unpivot(rows.agg(*ends), columns, ["dtype", "min_value", "max_value"])


def target_correlation(rows: DataFrame, target: str, columns: Sequence[str], top: int | None = 5) -> DataFrame:
    """Absolute Pearson correlation with the target, strongest first.

    A constant column has none (null) and sorts last.
    """
    number = lambda c: F.col(c).cast("double")
    # From moments, since a constant column must not divide by zero. Both sides
    # of a pair count only where both are known.
    moments = []
    for c in columns:
        both = number(c).isNotNull() & number(target).isNotNull()
        x, y = F.when(both, number(c)), F.when(both, number(target))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        moments.append(F.try_divide(F.covar_pop(x, y), spread).alias(f"{c}|corr"))
    long = _unpivot(rows.agg(*moments), columns, ["corr"]).select(
        "column", F.abs("corr").alias("abs_corr")
    )
    return (
        long.orderBy(F.desc_nulls_last("abs_corr"), F.asc("column")).limit(top) if top else long
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Positive weight n_neg / max(n_pos, 1), and the pair (rate, 1 - rate)."""
    counted = rows.agg(
        F.coalesce(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(0)).alias("n_pos"),
        F.count(label).alias("_n"),
        F.avg(F.col(label).cast("double")).alias("weight_class_0"),
    )
    return counted.select(
        "n_pos",
        (F.col("_n") - F.col("n_pos")).alias("n_neg"),
        (
            (F.col("_n") - F.col("n_pos")).cast("double") / F.greatest("n_pos", F.lit(1)).cast("double")
        ).alias("scale_pos_weight"),
        "weight_class_0",
        (1.0 - F.col("weight_class_0")).alias("weight_class_1"),
    )


def standard_scaler_fit(rows: DataFrame, columns: Sequence[str] = tuple(C.SCALED_FEATURES)) -> DataFrame:
    """Mean and population deviation per column; a zero deviation becomes 1."""
    moments = []
    for c in columns:
        spread = F.stddev_pop(F.col(c).cast("double"))
        moments += [
            F.avg(F.col(c).cast("double")).alias(f"{c}|mean"),
            F.when(spread == 0, 1.0).otherwise(spread).alias(f"{c}|std"),
        ]
    return _unpivot(rows.agg(*moments), columns, ["mean", "std"])


def latency_summary(rows: DataFrame, value: str, groups: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Count, rate per second, mean, median, 95th percentile and total of latencies in ms."""
    present = rows.filter(F.col(value).isNotNull())
    if not groups:
        whole = latency_summary(present.withColumn("_all", F.lit(0)), value, ["_all"], ranges)
        return whole.drop("_all")
    totals = present.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("avg_ms"),
        (F.sum(value) / 1000.0).alias("total_seconds"),
    )
    ranks = exact_quantiles(present, value, {"p50_ms": 0.5, "p95_ms": 0.95}, groups, ranges)
    both = totals.join(ranks, list(groups))
    rate = F.when(F.col("total_seconds") > 0, F.col("n") / F.col("total_seconds")).otherwise(0.0)
    return both.withColumn("per_second", rate)


def throughput_summary(
    rows: DataFrame, device: str, count: str, seconds: str, base: str, other: str
) -> DataFrame:
    """Per device: best rate, total time and ms per record; and the base-to-other speedup.

    A missing device gives 0. One row, from one conditional aggregate.
    """
    rate = F.when(F.col(seconds) > 0, F.col(count) / F.col(seconds)).otherwise(0.0)
    parts = []
    for name, side in (("base", base), ("other", other)):
        mine = F.col(device) == side
        parts += [
            F.coalesce(F.max(F.when(mine, rate)), F.lit(0.0)).alias(f"{name}_best_rate"),
            F.coalesce(F.sum(F.when(mine, F.col(seconds))), F.lit(0.0)).alias(f"{name}_seconds"),
            F.coalesce(F.sum(F.when(mine, F.col(count))), F.lit(0)).cast("double").alias(f"_{name}_n"),
        ]
    row = rows.agg(*parts)
    for name in ("base", "other"):
        per = F.when(F.col(f"_{name}_n") > 0, F.col(f"{name}_seconds") * 1000.0 / F.col(f"_{name}_n"))
        row = row.withColumn(f"{name}_ms_per_record", per.otherwise(0.0))
    both = (F.col("base_seconds") > 0) & (F.col("other_seconds") > 0)
    speedup = F.when(both, F.col("base_seconds") / F.col("other_seconds")).otherwise(0.0)
    return row.withColumn("speedup", speedup).drop("_base_n", "_other_n")


def numeric_columns(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
