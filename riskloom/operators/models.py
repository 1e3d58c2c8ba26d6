"""Training, calibration, scoring and comparison of boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions.numbers import whole_percent
from riskloom.functions.scoring import risk_tier, tier_color
from riskloom.operators import boosting, curves
from riskloom.operators.boosting import GbtSettings, Trees, patience_prefix, sigmoid
from riskloom.operators.calibration import Isotonic, isotonic_models
from riskloom.operators.ensembles import GbtModel
from riskloom.operators.ranking import stratified_folds

__all__ = ["GbtSettings", "patience_prefix"]

#: Models fitted at the same time; a fit on few rows is a chain of short jobs.
PARALLEL_FITS = 3


def side_by_side(make: Callable, over: Sequence, parallel: int = PARALLEL_FITS) -> list:
    """``make`` of every item, ``parallel`` of them at the same time, in the order of the items."""
    pool = ThreadPool(max(1, min(parallel, len(over))))
    try:
        return pool.map(inheritable_thread_target(SparkSession.active())(make), over)
    finally:
        pool.close()


def train_gbt(
    train: DataFrame, validation: DataFrame | None = None, settings: GbtSettings = GbtSettings(), key: str | None = None
) -> GbtModel:
    """Boosted trees on ``(label, features)``; a validation table stops the rounds and cuts the model."""
    columns = ["label", "features", *([key] if key else [])]
    rows = train.select(*columns, F.lit(boosting.ALL).alias("out"))
    if validation is not None:
        rows = rows.unionByName(validation.select(*columns, F.lit(boosting.NONE).alias("out")))
    fitted, _ = boosting.fit(rows, settings, key=key)
    return GbtModel(tuple(fitted))


@dataclass(frozen=True)
class Calibrated:
    """A calibrated model and (label, fold, score, probability) of its train rows, not seen in their fits.

    ``score`` is a row's probability by the member that was not fitted on it;
    ``probability`` calibrates it by a curve that has not seen the row either.
    """

    model: GbtModel
    held_out: DataFrame


def calibrate_isotonic(
    train: DataFrame, key: str, folds: int = 5, settings: GbtSettings = GbtSettings(), seed: int = C.SEED
) -> Calibrated:
    """Cross-fitted isotonic calibration over folds that hold an exact share of each label.

    Member k is fitted on all folds but the k-th, all members in the same
    passes, and calibrated on the k-th. The fit leaves every row's margins, so
    its held-out score needs no further scoring.
    """
    folded = stratified_folds(train.select(key, "label", "features"), key, "label", folds, seed)
    fitted, ends = boosting.fit(folded.withColumnRenamed("fold", "out"), settings, folds, key)

    def own_margin(margins: pa.Array, out: pa.Array) -> pa.Array:
        every = boosting.bytes_of(margins, float, folds)
        return pa.array(sigmoid(every[np.arange(len(every)), out.to_numpy()]))

    score = F.arrow_udf(own_margin, "double")("margins", "out")
    # Two halves of each fold, each calibrated by the other for the tuning of thresholds.
    half = F.pmod(F.shiftright("turn", 7), F.lit(2)).cast("int")
    held = ends.select("label", F.col("out").alias("fold"), (2 * F.col("out") + half).alias("part"), score.alias("score"))
    whole = isotonic_models(held, "fold")
    halves = isotonic_models(held, "part")
    none = Isotonic.of([])

    def cross(scores: pa.Array, part: pa.Array) -> pa.Array:
        values, number = scores.to_numpy(), part.to_numpy()
        out = np.zeros(len(values))
        for k in np.unique(number):
            # A fold with one row has no other half.
            curve = halves.get(int(k) ^ 1) or whole.get(int(k) // 2, none)
            out[number == k] = curve(values[number == k])
        return pa.array(out)

    held = held.withColumn("probability", F.arrow_udf(cross, "double")("score", "part")).drop("part")
    model = GbtModel(tuple(fitted), tuple(whole.get(k, none) for k in range(folds)))
    return Calibrated(model, held)


def tuned_threshold(held_out: DataFrame, default: float = 0.5) -> float:
    """The threshold of the best F1 on scores that no fit has seen; ``default`` without positives."""
    scores = held_out.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = curves.best_f1_threshold(scores, "probability", "label").first()
    finally:
        scores.unpersist()
    return best["threshold"] if best and best["f1"] else default


def gbt_members(model: GbtModel) -> list[Trees]:
    return list(model.members)


def score_records(
    matrix: DataFrame, model: GbtModel, threshold: float, mode: str = "additive"
) -> DataFrame:
    """Probability, tier, colour and whole percent of every record."""
    scored = model.transform(matrix)
    return (
        scored.withColumn("risk_tier", risk_tier(F.col("probability"), threshold, mode))
        .withColumn("risk_color", tier_color(F.col("risk_tier")))
        .withColumn("confidence_pct", whole_percent(F.col("probability")))
    )


def ablation_compare(
    sets: Mapping[str, tuple[DataFrame, DataFrame, DataFrame]], settings: GbtSettings = GbtSettings()
) -> DataFrame:
    """Same training on several feature sets, side by side; one row of test metrics per set.

    A set is (train, validation, test). The validation rows stop the rounds of
    their set and tune its threshold; the test rows only measure.
    """

    def arm(item: tuple[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
        name, (train, validation, test) = item
        model = train_gbt(train, validation, settings)
        threshold = tuned_threshold(model.transform(validation).select("probability", "label"))
        scored = model.transform(test).select("probability", "label").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            area = curves.auroc(scored, "probability", "label").first()["auroc"]
            found = curves.confusion_metrics(scored, "probability", "label", threshold).first()
        finally:
            scored.unpersist()
        facts = [(name, *found, area, threshold, model.n_features, model.n_trees)]
        kinds = "tn long, fp long, fn long, tp long, precision double, recall double, f1_macro double"
        return SparkSession.active().createDataFrame(
            facts, f"feature_set string, {kinds}, auroc double, threshold double, n_features int, trees int"
        )

    parts = side_by_side(arm, list(sets.items()))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
