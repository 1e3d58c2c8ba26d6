"""Isotonic calibration by pooling that can be merged.

Neighbouring scores whose mean labels fall are pooled to one block; blocks pool
further in the same way. The blocks of a range of scores can thus be pooled by
themselves, and pooled again beside those of its neighbours, in any order, with
the same result as one pass over all scores. Ranges are merged a few at a time
until one is left, so no task holds more than a range of scores, or the blocks
that are left of some ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.ranges import range_cuts, with_range

#: Ranges whose blocks meet in one task of a merging step.
MERGED = 16
BLOCK = "low double, high double, weight double, total double"


def pooled(low: Sequence[float], high: Sequence[float], weight: Sequence[float], total: Sequence[float]) -> list[list[float]]:
    """Blocks (low, high, weight, total) in ascending order whose means increase."""
    blocks: list[list[float]] = []
    for block in map(list, zip(low, high, weight, total, strict=True)):
        while blocks and blocks[-1][3] * block[2] >= block[3] * blocks[-1][2]:
            before = blocks.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        blocks.append(block)
    return blocks


def isotonic_blocks(scores: DataFrame, group: str, score: str = "score", label: str = "label", ranges: int | None = None) -> DataFrame:
    """(group, low, high, weight, total) of the isotonic fit of each group's labels on its scores.

    Equal scores are one cell before anything is pooled. Rows without score or
    label are left out. ``group`` is an integer column.
    """
    known = scores.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    cells = known.groupBy(F.col(group).cast("long").alias("group"), F.col(score).cast("double").alias("low")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(label).cast("double")).alias("total")
    )
    cuts = range_cuts(known, score, ranges)
    blocks = with_range(cells, "low", cuts, "range").select(
        "group", F.col("range").cast("long").alias("range"), "low", F.col("low").alias("high"), "weight", "total"
    )
    left = len(cuts) + 1

    def pool(table: pa.Table) -> pa.Table:
        table = table.sort_by("low")
        found = pooled(*(table[c].to_pylist() for c in ("low", "high", "weight", "total")))
        columns = list(zip(*found, strict=True)) or [[]] * 4
        firsts = {c: pa.array([table[c][0].as_py()] * len(found), pa.int64()) for c in ("group", "range")}
        return pa.table(firsts | {c: pa.array(v, pa.float64()) for c, v in zip(("low", "high", "weight", "total"), columns, strict=True)})

    while True:
        blocks = blocks.groupBy("group", "range").applyInArrow(pool, f"group long, range long, {BLOCK}")
        if left == 1:
            return blocks.drop("range").withColumnRenamed("group", group)
        left = -(-left // MERGED)
        blocks = blocks.withColumn("range", F.expr(f"range div {MERGED}"))


@dataclass(frozen=True)
class Isotonic:
    """An increasing function: a block's mean on it, a straight line between blocks, constant beyond."""

    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(blocks: Sequence[tuple[float, float, float, float]]) -> Isotonic:
        """From (low, high, weight, total) in any order; without blocks, 0 everywhere."""
        blocks = sorted(tuple(b) for b in blocks)
        ends = [(x, b[3] / b[2]) for b in blocks for x in b[:2]] or [(0.0, 0.0)]
        return Isotonic(np.array([e[0] for e in ends]), np.array([e[1] for e in ends]))

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.at, self.value)


def isotonic_models(scores: DataFrame, group: str, score: str = "score", label: str = "label") -> dict[int, Isotonic]:
    """The fitted function of each group; what is left of its blocks is the model, and all that reaches the driver."""
    found: dict[int, list[tuple]] = {}
    for row in isotonic_blocks(scores, group, score, label).toArrow().to_pylist():
        found.setdefault(row[group], []).append((row["low"], row["high"], row["weight"], row["total"]))
    return {k: Isotonic.of(blocks) for k, blocks in found.items()}
