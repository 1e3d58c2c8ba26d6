"""Exact running totals and quantiles without one-task windows.

A window ordered over a whole table runs in one task. Here the order column is
cut into ranges at approximate quantiles (constants in the plan, so retried
tasks agree on them). Totals per range are cumulated over the few ranges, and
each range cumulates its own rows. Where the cuts fall affects only balance,
never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES = 2_000


def range_cuts(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Increasing cut points that split ``column`` into about equal ranges."""
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges, MAX_RANGES))
    if ranges == 1:
        return []
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = df.select(F.col(column).cast("double").alias("c")).approxQuantile(
        "c", probabilities, max(1e-5, 0.25 / ranges)
    )
    return sorted(set(cuts))


def with_range(df: DataFrame, column: str, cuts: Sequence[float], output: str) -> DataFrame:
    """Add the number of the range that holds ``column``."""
    if not cuts:
        return df.withColumn(output, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    staged = df.withColumn("_order", F.col(column).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="_order", outputCol=output).transform(staged)
    return bucketed.drop("_order")


def running_totals(
    cells: DataFrame,
    order: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    cuts: Sequence[float] = (),
    maxima: Sequence[str] = (),
) -> DataFrame:
    """Add ``<s>_before`` (total or maximum of earlier cells) and ``<s>_all`` (of the group).

    ``cells`` holds one row per group and order value; groups may be null, the order may not.
    A maximum without earlier cells is null, a total 0.
    """
    ranged = with_range(cells, order, cuts, "_range")
    direction = F.desc if descending else F.asc
    earlier = (Window.unboundedPreceding, -1)
    kinds = {**{s: F.sum for s in sums}, **{m: F.max for m in maxima}}

    per_range = ranged.groupBy(*groups, "_range").agg(*[k(s).alias(s) for s, k in kinds.items()])
    over_ranges = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    previous = over_ranges.orderBy(direction("_range")).rowsBetween(*earlier)
    offsets = per_range.select(
        *groups,
        "_range",
        *[k(s).over(previous).alias(f"_{s}_offset") for s, k in kinds.items()],
        *[k(s).over(over_ranges).alias(f"{s}_all") for s, k in kinds.items()],
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(direction(order)).rowsBetween(*earlier)

    def before(name, kind):
        here, offset = kind(name).over(inside), F.col(f"_{name}_offset")
        if kind is F.max:
            return F.greatest(here, offset).alias(f"{name}_before")
        return (F.coalesce(here, F.lit(0)) + F.coalesce(offset, F.lit(0))).alias(f"{name}_before")

    # Null groups are groups too, so the join treats nulls as equal.
    named = offsets.withColumnsRenamed({c: f"_offset_{c}" for c in (*groups, "_range")})
    same = F.lit(True)
    for column in (*groups, "_range"):
        same = same & ranged[column].eqNullSafe(named[f"_offset_{column}"])
    return ranged.join(named, same).select(
        *cells.columns,
        *[before(s, k) for s, k in kinds.items()],
        *[f"{s}_all" for s in kinds],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    groups: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per group, exact, with hot groups spread over tasks.

    Equal values collapse to one counted cell before the shuffle.
    """
    present = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    present = present.dropna(subset=list(groups)) if groups else present
    cuts = range_cuts(present, "_v", ranges)
    cells = present.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, "_v", ["n"], groups, cuts=cuts)

    picks, outputs = [], []
    for name, probability in quantiles.items():
        position = F.lit(float(probability)) * (F.col("n_all") - 1)
        for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{end}"))
        share = F.lit(float(probability)) * (F.col("_n") - 1)
        outputs.append(
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (share - F.floor(share))
            ).alias(name)
        )
    return (
        ranked.groupBy(*groups)
        .agg(F.max("n_all").alias("_n"), *picks)
        .select(*groups, *outputs)
    )
