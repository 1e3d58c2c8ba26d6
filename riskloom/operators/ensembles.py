"""Fitted ensembles of boosted trees: scoring, writing and reading."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import boosting
from riskloom.operators.boosting import Trees, sigmoid
from riskloom.operators.calibration import Isotonic

NODES = "member int, node int, feature int, cut double, left int, value double, cover double, is_root boolean"
POINTS = "member int, place int, at double, value double"
FACTS = "n_features int, depth int, members int, calibrated boolean"


def number_array(df: DataFrame, vector: str) -> Column:
    """A feature vector as array<double>, whether it is one of Spark ML or an array."""
    if isinstance(df.schema[vector].dataType, VectorUDT):
        return vector_to_array(vector)
    return F.col(vector).cast("array<double>")


@dataclass(frozen=True)
class GbtModel:
    """Boosted members, each with its calibration if there is one; the probability is their mean."""

    members: tuple[Trees, ...]
    calibrations: tuple[Isotonic, ...] = ()
    vector: str = "features"

    @property
    def n_features(self) -> int:
        return self.members[0].n_features

    @property
    def n_trees(self) -> int:
        return sum(m.n_trees for m in self.members)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """The probability of each row of ``x``."""
        found = [sigmoid(m.margins(x)) for m in self.members]
        if self.calibrations:
            found = [curve(p) for curve, p in zip(self.calibrations, found, strict=True)]
        return np.mean(found, axis=0)

    def transform(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """``df`` with the probability of each row; no shuffle, Arrow batches through numpy."""
        width, find = self.n_features, self.probabilities

        def score(vectors: pa.Array) -> pa.Array:
            return pa.array(find(boosting.matrix_of(vectors, width)))

        return df.withColumn(output, F.arrow_udf(score, "double")(number_array(df, self.vector)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and calibration points as parquet; the facts, written last, as JSON."""
        nodes = [(k, *row) for k, m in enumerate(self.members) for row in m.to_rows()]
        points = [(k, i, float(a), float(v)) for k, c in enumerate(self.calibrations) for i, (a, v) in enumerate(zip(c.at, c.value, strict=True))]
        spark.createDataFrame(nodes, NODES).write.parquet(f"{path}/nodes")
        spark.createDataFrame(points, POINTS).write.parquet(f"{path}/points")
        facts = [(self.n_features, self.members[0].depth, len(self.members), bool(self.calibrations))]
        spark.createDataFrame(facts, FACTS).write.json(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GbtModel:
        facts = spark.read.schema(FACTS).json(f"{path}/facts").first()
        nodes: list[list[tuple]] = [[] for _ in range(facts["members"])]
        for row in spark.read.schema(NODES).parquet(f"{path}/nodes").toArrow().to_pylist():
            nodes[row["member"]].append(tuple(row.values())[1:])
        points: list[list[tuple]] = [[] for _ in range(facts["members"])]
        for row in spark.read.schema(POINTS).parquet(f"{path}/points").toArrow().to_pylist():
            points[row["member"]].append((row["place"], row["at"], row["value"]))
        members = tuple(Trees.of_rows(own, facts["n_features"], facts["depth"]) for own in nodes)
        curves_ = tuple(Isotonic(*(np.array([p[k] for p in sorted(own)]) for k in (1, 2))) for own in points)
        return GbtModel(members, curves_ if facts["calibrated"] else ())
