"""Text classification by mini-batch descent in epochs, with a saved state after each.

Rows are dealt into parts by the hash of their key and stored part by part, so
a step reads its part only. Vectors go as the entries they have, so a task's
memory does not grow with the vocabulary. An epoch takes the parts in an order of its own;
each step is one job that sums the gradients of its rows, and AdamW moves the
weights. After an epoch the weights, the moments and the area under the ROC
curve of the validation rows are written in one commit, so a run that was
killed goes on behind its last whole epoch and comes to the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators import curves
from riskloom.operators.boosting import sigmoid
from riskloom.operators.ranking import best_so_far

STATE = "epoch int, weights array<double>, first array<double>, second array<double>, loss double, auroc double"


@dataclass(frozen=True)
class EpochSettings:
    """``steps`` parts an epoch; the rate rises over ``warm_up`` of all steps, then falls to 0."""

    epochs: int = 5
    steps: int = 16
    rate: float = 0.1
    warm_up: float = 0.1
    decay: float = 0.01
    clip: float = 1.0
    momentum: tuple[float, float] = (0.9, 0.999)
    seed: int = C.SEED

    def rate_at(self, step: int) -> float:
        whole = self.epochs * self.steps
        rising = max(1, int(self.warm_up * whole))
        return self.rate * min((step + 1) / rising, (whole - step) / max(1, whole - rising))


@dataclass(frozen=True)
class LinearModel:
    """Logistic model; the last weight is the intercept."""

    weights: np.ndarray
    vector: str

    def transform(self, df: DataFrame, output: str = "p_text") -> DataFrame:
        weights = self.weights

        def score(slots: pa.Array, x: pa.Array) -> pa.Array:
            return pa.array(sigmoid(margins(*entries(slots, x), len(x), weights)))

        return df.withColumn(output, F.arrow_udf(score, "double")(*slots_and_values(df, self.vector)))


def slots_and_values(df: DataFrame, vector: str) -> tuple[Column, Column]:
    """The entries of a vector that are given, as places and numbers; a term vector has few of them."""
    if isinstance(df.schema[vector].dataType, VectorUDT):
        raw = F.unwrap_udt(F.col(vector))
        slots, values = raw["indices"], raw["values"]
    else:
        slots, values = F.lit(None).cast("array<int>"), F.col(vector).cast("array<double>")
    every = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(slots, every), values


def entries(slots: pa.ListArray, x: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all entries of a batch of vectors."""
    row = np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy())
    return row, slots.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)


def margins(row: np.ndarray, slot: np.ndarray, value: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(row, value * weights[slot], rows) + weights[-1]


def deal(train: DataFrame, key: str, vector: str, folder: str, settings: EpochSettings) -> None:
    """Store (part, label, weight, width, slots, x) of the train rows; class c weighs 1 minus its rate."""
    rate = train.agg(F.avg("label")).first()[0] or 0.0
    slots, values = slots_and_values(train, vector)
    sparse = isinstance(train.schema[vector].dataType, VectorUDT)
    width = F.coalesce(F.unwrap_udt(F.col(vector))["size"], F.size(values)) if sparse else F.size(values)
    rows = train.select(
        F.pmod(F.xxhash64(key, F.lit(settings.seed)), F.lit(settings.steps)).cast("int").alias("part"),
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1.0, 1.0 - rate).otherwise(rate).alias("weight"),
        width.alias("width"),
        slots.alias("slots"),
        values.alias("x"),
    ).filter("label is not null")
    rows.hint("rebalance", "part").write.partitionBy("part").parquet(folder)


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The parquet rows at ``path``, or nothing where nothing was written."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """(gradient, loss) of the weighted cross-entropy over ``rows``, both by the sum of weights."""
    size = len(weights)
    if "slots" not in rows.columns:
        rows = rows.withColumn("slots", slots_and_values(rows, "x")[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            row, slot, x = entries(batch.column("slots"), batch.column("x"))
            y, w = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            margin = margins(row, slot, x, len(y), weights)
            gap = w * (sigmoid(margin) - y)
            total[: size - 1] += np.bincount(slot, gap[row] * x, size - 1)
            total[size - 1] += gap.sum()
            total[size] += (w * (np.logaddexp(0.0, margin) - y * margin)).sum()
            total[size + 1] += w.sum()
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "value"])

    made = rows.mapInArrow(sums, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(size + 2)
    total[made["slot"].to_numpy()] = made["value"].to_numpy()
    whole = total[size + 1] or 1.0
    return total[:size] / whole, float(total[size] / whole)


def train_epochs(
    train: DataFrame, validation: DataFrame, key: str, vector: str, folder: str,
    settings: EpochSettings = EpochSettings(), stop_after: int | None = None,
) -> DataFrame:
    """The states of all epochs, by the rows and states stored in ``folder`` where there are some.

    ``train`` and ``validation`` hold ``key``, ``label`` and ``vector``. A run
    with the same folder goes on with the rows dealt there. ``stop_after`` ends
    it early. An epoch without positives or negatives to tell apart has an area
    of 0.5.
    """
    spark = train.sparkSession
    dealt, states = f"{folder}/rows", f"{folder}/states"
    if stored(spark, dealt) is None:
        deal(train, key, vector, dealt, settings)
    known = stored(spark, states, STATE)
    last = known.orderBy(F.desc("epoch")).first() if known is not None else None
    if last:
        weights, first, second = (np.array(last[c]) for c in ("weights", "first", "second"))
    else:
        example = stored(spark, dealt).select(F.col("width").alias("n")).first()
        weights, first, second = np.zeros((3, (example["n"] if example else 0) + 1))
    begin = last["epoch"] + 1 if last else 0
    for epoch in range(begin, settings.epochs if stop_after is None else min(settings.epochs, stop_after)):
        losses = []
        for nth, part in enumerate(np.random.default_rng([settings.seed, epoch]).permutation(settings.steps).tolist()):
            step = epoch * settings.steps + nth
            slope, loss = gradient(stored(spark, dealt).filter(F.col("part") == part), weights)
            slope *= min(1.0, settings.clip / max(np.linalg.norm(slope), 1e-12))
            a, b = settings.momentum
            first, second = a * first + (1 - a) * slope, b * second + (1 - b) * slope**2
            move = (first / (1 - a ** (step + 1))) / (np.sqrt(second / (1 - b ** (step + 1))) + 1e-8)
            weights = weights - settings.rate_at(step) * (move + settings.decay * weights)
            losses.append(loss)
        scored = LinearModel(weights, vector).transform(validation, "p")
        area = curves.auroc(scored, "p", "label").first()["auroc"]
        row = (epoch, weights.tolist(), first.tolist(), second.tolist(), float(np.mean(losses)), 0.5 if area is None else area)
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(states)
    return spark.read.schema(STATE).parquet(states)


def progress(states: DataFrame) -> DataFrame:
    """(epoch, loss, auroc, best_before, improved): an epoch is kept if it is better than all before."""
    rows = states.select(F.col("epoch").cast("long").alias("epoch"), "loss", "auroc").withColumn("run", F.lit(0))
    return best_so_far(rows, "epoch", "auroc", ["run"]).drop("run")


def best_model(states: DataFrame, vector: str) -> tuple[LinearModel, float]:
    """The first epoch with the largest area, and that area."""
    best = states.orderBy(F.desc("auroc"), "epoch").first()
    return LinearModel(np.array(best["weights"]), vector), best["auroc"]
