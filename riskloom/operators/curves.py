"""Classifier metrics over score tables of any size.

Scores collapse to one counted cell per distinct value before anything is
ordered, and running totals go through ranges, so no task sees all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.ranges import range_cuts, running_totals


def score_cells(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    usable = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return usable.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"),
    )


def confusion_metrics(rows: DataFrame, score: str, label: str, threshold) -> DataFrame:
    """Confusion counts at a threshold with precision, recall and macro F1."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    usable = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    said = F.col(score) >= cut
    truth = F.col(label) == 1
    row = usable.agg(
        F.count_if(~said & ~truth).alias("tn"),
        F.count_if(said & ~truth).alias("fp"),
        F.count_if(~said & truth).alias("fn"),
        F.count_if(said & truth).alias("tp"),
    )
    return row.select("*", *metric_columns())


def metric_columns() -> list[Column]:
    """Precision, recall and macro F1 of tn, fp, fn, tp; 0 where undefined."""

    def share(part, whole):
        return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0)

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1_pos = share(2 * tp, 2 * tp + fp + fn)
    f1_neg = share(2 * tn, 2 * tn + fp + fn)
    return [
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        ((f1_pos + f1_neg) / 2.0).alias("f1_macro"),
    ]


def auroc(rows: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties at mid-rank; null with a single class."""
    cells = score_cells(rows, score, label)
    cuts = range_cuts(rows.filter(F.col(score).isNotNull()), score, ranges)
    ranked = running_totals(cells, "threshold", ["pos", "neg"], cuts=cuts)
    won = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)
    row = ranked.agg(
        F.sum(won).alias("_won"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return row.select("n_pos", "n_neg", F.when(pairs > 0, F.col("_won") / pairs).alias("auroc"))


def auroc_by(
    rows: DataFrame, groups: Sequence[str], score: str, label: str, ranges: int | None = None
) -> DataFrame:
    """(groups, auroc): the area of every group's scores; null with a single class."""
    usable = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    cells = usable.groupBy(*groups, F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) != 1).cast("bigint")).alias("neg"),
    )
    ranked = running_totals(cells, "threshold", ["pos", "neg"], groups, cuts=range_cuts(usable, score, ranges))
    won = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*groups).agg(F.when(pairs > 0, F.sum(won) / pairs).alias("auroc"))


def pr_curve(rows: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """Precision, recall and F1 of every distinct score used as threshold."""
    cells = score_cells(rows, score, label)
    cuts = range_cuts(rows.filter(F.col(score).isNotNull()), score, ranges)
    ranked = running_totals(cells, "threshold", ["pos", "neg"], descending=True, cuts=cuts)
    tp = (F.col("pos_before") + F.col("pos")).cast("double")
    fp = (F.col("neg_before") + F.col("neg")).cast("double")
    positives = F.col("pos_all").cast("double")
    return ranked.select(
        "threshold",
        (tp / (tp + fp)).alias("precision"),
        F.when(positives > 0, tp / positives).otherwise(0.0).alias("recall"),
        (2.0 * tp / (tp + fp + positives)).alias("f1"),
    )


def best_f1_threshold(rows: DataFrame, score: str, label: str, ranges: int | None = None) -> DataFrame:
    """The threshold with the highest F1, the lowest one on ties."""
    curve = pr_curve(rows, score, label, ranges)
    return curve.orderBy(F.desc("f1"), F.asc("threshold")).limit(1).select("threshold", "f1")


def evaluate_report(
    rows: DataFrame, score: str, label: str, default: float = 0.5, ranges: int | None = None
) -> DataFrame:
    """Metrics at the default and at the tuned threshold, with size and positive rate."""
    best = best_f1_threshold(rows, score, label, ranges).first()
    area = auroc(rows, score, label, ranges).first()
    tuned = best["threshold"] if best else default
    size, positives = (area["n_pos"] or 0) + (area["n_neg"] or 0), area["n_pos"] or 0
    rate = positives / size if size else None

    def at(name: str, threshold: float) -> DataFrame:
        return confusion_metrics(rows, score, label, threshold).select(
            F.lit(name).alias("setting"),
            F.lit(float(threshold)).alias("threshold"),
            "*",
            F.lit(area["auroc"]).cast("double").alias("auroc"),
            F.lit(size).cast("bigint").alias("n"),
            F.lit(rate).cast("double").alias("positive_rate"),
        )

    return at("default", default).unionByName(at("tuned", tuned))
