"""Reproducible splits, samples, ranks and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators.joins import first_per_key
from riskloom.plans.lookup import lookup_join
from riskloom.plans.ranges import range_cuts, running_totals


def order_hash(key: Column, seed: int = C.SEED) -> Column:
    """Seeded pseudo-random order of keys, the same in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def split_cutoffs(
    rows: DataFrame, key: str, label: str, test_share: float = C.TEST_SHARE, seed: int = C.SEED
) -> DataFrame:
    """Per label, the last hash and key that belong to the test side.

    The test side is the first ``round(share * n)`` rows of a label in hash
    order. Hash prefixes are counted (65,536 cells per label), and only the
    cell in which a label's quota ends is looked at row by row.
    """
    keyed = rows.select(
        F.col(label).alias("_label"),
        F.col(key).alias("_key"),
        order_hash(F.col(key), seed).alias("_hash"),
    ).filter("_label is not null and _key is not null")
    celled = keyed.withColumn("_cell", F.substring("_hash", 1, 4))

    by_label = Window.partitionBy("_label")
    cells = celled.groupBy("_label", "_cell").agg(F.count(F.lit(1)).alias("n"))
    quota = F.floor(F.sum("n").over(by_label) * F.lit(test_share) + 0.5)
    before = F.sum("n").over(by_label.orderBy("_cell")) - F.col("n")
    edges = (
        cells.select("_label", "_cell", "n", before.alias("_before"), quota.alias("_quota"))
        .filter("_before < _quota and _quota <= _before + n")
        .select("_label", F.col("_cell").alias("_edge"), (F.col("_quota") - F.col("_before")).alias("_left"))
    )
    edge_rows = lookup_join(celled, edges, "_label").filter("_cell = _edge")
    # Copies of one key collapse to one counted row and fall on the same side.
    copies = edge_rows.groupBy("_label", "_hash", "_key").agg(
        F.count(F.lit(1)).alias("n"), F.first("_left").alias("_left")
    )
    in_cell = by_label.orderBy("_hash", "_key")
    reached = F.sum("n").over(in_cell) - F.col("n")
    last = copies.withColumn("_reached", reached).filter("_reached < _left")
    return last.groupBy("_label").agg(
        F.max(F.struct("_hash", "_key")).alias("_cut")
    ).select(F.col("_label").alias(label), F.col("_cut"))


def stratified_split(
    rows: DataFrame,
    key: str,
    label: str,
    test_share: float = C.TEST_SHARE,
    seed: int = C.SEED,
    output: str = "split",
    cutoffs: DataFrame | None = None,
) -> DataFrame:
    """Label rows train or test, an exact share of every label, without a sort of them all."""
    if cutoffs is None:
        cutoffs = split_cutoffs(rows, key, label, test_share, seed)
    placed = lookup_join(rows, cutoffs, label)
    mine = F.struct(order_hash(F.col(key), seed).alias("_hash"), F.col(key).alias("_key"))
    side = F.when(mine <= F.col("_cut"), "test").otherwise("train")
    return placed.withColumn(output, side).drop("_cut")


def stratified_folds(
    rows: DataFrame, key: str, label: str, folds: int = 5, seed: int = C.SEED, output: str = "fold"
) -> DataFrame:
    """Number the rows of every label 0 to ``folds`` - 1 in equal shares, up to one row, by seeded hash order.

    Copies of a key stay together. Rows without key or label are in fold 0.
    """
    for k in range(1, folds):
        cuts = split_cutoffs(rows, key, label, k / folds, seed + 1).withColumnRenamed("_cut", f"_cut_{k}")
        rows = rows.join(cuts, label, "left")
    mine = F.struct(order_hash(F.col(key), seed + 1).alias("_hash"), F.col(key).alias("_key"))
    above = [F.coalesce((mine > F.col(f"_cut_{k}")).cast("int"), F.lit(0)) for k in range(1, folds)]
    numbered = rows.withColumn(output, sum(above[1:], above[0]) if above else F.lit(0))
    return numbered.drop(*[f"_cut_{k}" for k in range(1, folds)])


def fold_of(key: Column, folds: int = 5, seed: int = C.SEED) -> Column:
    """Fold number from the seeded order hash."""
    return F.pmod(F.conv(F.substring(order_hash(key, seed + 1), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def sample_per_stratum(
    rows: DataFrame,
    key: str,
    strata: Mapping[str, Column],
    per_stratum: int = C.STRATUM_SAMPLE,
    total: int = C.DEMO_SIZE,
    seed: int = C.SEED,
) -> DataFrame:
    """A few rows of every stratum that has enough, filled up with rows of any kind.

    A repeated key counts once, by the copy whose other columns are smallest;
    copies collapse on the map side. Ranks are limited before the shuffle
    (window group limit and top-k), however large a stratum is.
    """
    others = [F.col(c) for c in rows.columns if c != key]
    unique = first_per_key(rows, key, others) if others else rows.distinct()
    hashed = unique.withColumn("_hash", order_hash(F.col(key), seed))
    name = F.lit(None).cast("string")
    for stratum, test in reversed(list(strata.items())):
        name = F.when(test, stratum).otherwise(name)
    in_order = ["_hash", key]
    ranked = (
        hashed.withColumn("stratum", name)
        .filter("stratum is not null")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("stratum").orderBy(*in_order)))
        .filter(F.col("_rank") <= per_stratum)
    )
    enough = F.count(F.lit(1)).over(Window.partitionBy("stratum")) == per_stratum
    chosen = ranked.withColumn("_full", enough).filter("_full").drop("_full", "_rank")

    # The first ``total + k * strata`` rows hold every wildcard that can be needed.
    pool = (
        hashed.withColumn("stratum", F.lit("wildcard"))
        .orderBy(*in_order)
        .limit(total + per_stratum * len(strata))
    )
    both = chosen.withColumn("_pick", F.lit(0)).unionByName(pool.withColumn("_pick", F.lit(1)))
    once = both.withColumn(
        "_seen", F.row_number().over(Window.partitionBy(key).orderBy("_pick", "_hash"))
    ).filter("_seen = 1")
    # At most 2k * strata + total rows are left here.
    filled = once.withColumn(
        "_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_pick", *in_order))
    ).filter(F.col("_place") <= total)
    return filled.drop("_hash", "_pick", "_seen", "_place")


def topn_abs(long: DataFrame, key: str, value: str, name: str, n: int) -> DataFrame:
    """The n rows of each key with the largest absolute value, ranked."""
    order = Window.partitionBy(key).orderBy(F.desc(F.abs(F.col(value))), F.asc(name))
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def best_so_far(
    rows: DataFrame, order: str, value: str, groups: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Best value before each row of its group and whether the row improves on it.

    ``order`` is a unique number per row; long groups are worked range by range.
    """
    ranked = running_totals(
        rows, order, [], groups, cuts=range_cuts(rows, order, ranges), maxima=[value]
    )
    best = F.coalesce(F.col(f"{value}_before"), F.lit(0.0))
    return (
        ranked.withColumn("best_before", best)
        .withColumn("improved", F.col(value) > F.col("best_before"))
        .drop(f"{value}_before", f"{value}_all")
    )


def first_match(rows: DataFrame, group: str, test: Column, position: str, value: str) -> DataFrame:
    """Value of the first qualifying row of each group, by position."""
    return rows.filter(test).groupBy(group).agg(F.min_by(value, position).alias(value))


def sort_topk(rows: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), F.asc(tie)).limit(k)


def head_limit(rows: DataFrame, key: str, n: int = C.DEMO_SIZE) -> DataFrame:
    return rows.orderBy(key).limit(n)


def union_strata(parts: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def except_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    return rows.select(key).exceptAll(selected.select(key))
