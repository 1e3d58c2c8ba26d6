"""Second-order gradient boosting of a binary label, as Spark jobs over binned rows.

Rows are binned once at quantiles of the train rows. A round grows one tree
level by level: tasks sum gradients and hessians by node, feature and bin, the
sums of all tasks meet by node and feature, and one best split of each comes
back. Several models that differ in the rows they may see, such
as the folds of a calibration, are grown in the same passes. A row's margin is
carried from round to round beside its bins, so a pass walks the newest tree
only, and in a written table that is renewed every few rounds, so a lost task
is repeated from that table.

A validation part stops the rounds by the area under its ROC curve: the areas
of a block of rounds come from one job, and the model is cut behind the best
round, not fitted again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.operators import curves
from riskloom.session import shared_folder

#: Marks of rows that every model is fitted on, and that none is.
ALL, NONE = -1, -2
#: Numbers of this share of another count as equal to it, whatever the order in which their sums were added up;
#: of equal gains the first feature and cut is taken.
ALIKE = 1 - 1e-9
#: Trees of so many nodes are scored column by column, larger ones row by row from level to level.
FEW_NODES = 63


@dataclass(frozen=True)
class GbtSettings:
    """Boosting settings; the defaults are the documented training run.

    ``least_hessian`` bounds the hessian sum of each child, ``ridge`` is added to
    hessian sums, ``carry`` rounds pass between two writings of the margins.
    """

    max_iter: int = 300
    max_depth: int = 4
    step_size: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    least_hessian: float = 3.0
    ridge: float = 1.0
    least_gain: float = 1e-6
    bins: int = 256
    patience: int = 30
    carry: int = 25
    seed: int = C.SEED


@dataclass(frozen=True)
class Trees:
    """A boosted ensemble as flat arrays of nodes.

    A row goes left at ``x <= cut``, to ``left`` and else to ``left + 1``; a leaf
    is its own left child behind an infinite cut. What is null or not a number
    goes left. ``value`` is a leaf's log-odds, ``cover`` the hessian sum of the
    train rows of a node, ``roots`` the first node of each tree.
    """

    n_features: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    depth: int

    @property
    def n_trees(self) -> int:
        return len(self.roots)

    def prefix(self, trees: int) -> Trees:
        """The first ``trees`` trees."""
        nodes = int(self.roots[trees]) if trees < self.n_trees else len(self.feature)
        arrays = {c: getattr(self, c)[:nodes] for c in ("feature", "cut", "left", "value", "cover")}
        return replace(self, **arrays, roots=self.roots[:trees])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        clean = np.nan_to_num(x, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        columns = np.ascontiguousarray(clean.T)
        ends = [*self.roots[1:].tolist(), len(self.feature)]
        for root, end in zip(self.roots.tolist(), ends, strict=True):
            if end - root <= FEW_NODES:
                total += self.value[root:end].take(self._place(columns, root, root))
                continue
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.left[node] + (clean[rows, self.feature[node]] > self.cut[node])
            total += self.value[node]
        return total

    def _place(self, columns: np.ndarray, root: int, node: int) -> np.ndarray | np.uint8:
        """The leaf below ``node`` that each row comes to, counted from ``root``; whole columns are compared at each cut."""
        left = int(self.left[node])
        if left == node:
            return np.uint8(node - root)
        low, high = (self._place(columns, root, child) for child in (left, left + 1))
        # All bits of a row that goes right: the choice by bytes is several times as fast as np.where.
        right = np.negative((columns[self.feature[node]] > self.cut[node]).view(np.uint8))
        return low ^ ((low ^ high) & right)

    def to_rows(self) -> list[tuple]:
        """(node, feature, cut, left, value, cover, is_root) of every node."""
        first = set(self.roots.tolist())
        columns = (getattr(self, c).tolist() for c in ("feature", "cut", "left", "value", "cover"))
        return [(k, *node, k in first) for k, node in enumerate(zip(*columns, strict=True))]

    @staticmethod
    def of_rows(rows: Sequence[tuple], n_features: int, depth: int) -> Trees:
        rows = sorted(rows)
        column = lambda k, kind: np.array([r[k] for r in rows], kind)
        return Trees(
            n_features, column(1, np.int64), column(2, float), column(3, np.int64), column(4, float), column(5, float),
            np.array([r[0] for r in rows if r[6]], np.int64), depth,
        )


@dataclass
class Growing:
    """Trees under construction; ``bin`` is the last bin that goes left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        """A new leaf."""
        at = len(self.feature)
        for column, item in ((self.feature, 0), (self.bin, 1 << 30), (self.left, at), (self.value, value), (self.cover, cover)):
            column.append(item)
        return at

    def done(self, cuts: Sequence[np.ndarray], depth: int) -> Trees:
        leaf = [b == 1 << 30 for b in self.bin]
        cut = [np.inf if out else cuts[f][b] for f, b, out in zip(self.feature, self.bin, leaf, strict=True)]
        return Trees(
            len(cuts), np.array(self.feature, np.int64), np.array(cut, float), np.array(self.left, np.int64),
            np.array(self.value, float), np.array(self.cover, float), np.array(self.roots, np.int64), depth,
        )


@dataclass(frozen=True)
class Part:
    """What a task needs of one model: the nodes from ``roots[0]`` on, by their old numbers."""

    first: int
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @staticmethod
    def of(grown: Growing, trees: int) -> Part:
        """The last ``trees`` trees."""
        roots = np.array(grown.roots[len(grown.roots) - trees :], np.int64)
        first = int(roots[0]) if trees else len(grown.feature)
        return Part(
            first, np.array(grown.feature[first:], np.int64), np.array(grown.bin[first:], np.int64),
            np.array(grown.left[first:], np.int64) - first, np.array(grown.value[first:], float), roots - first,
        )

    def node(self, tree: int, bins: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row in a tree, by its number here."""
        node = np.full(len(bins), self.roots[tree])
        for _ in range(depth):
            node = self.left[node] + (bins[rows, self.feature[node]] > self.bin[node])
        return node


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def drawn(turn: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether a row with the random number ``turn`` is drawn, a new draw for each ``seed``."""
    x = turn.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) < share * (1 << 53)


def columns_of(settings: GbtSettings, model: int, tree: int, features: int) -> list[int]:
    """The columns a tree may split on."""
    rng = np.random.default_rng([settings.seed, model, tree])
    return sorted(rng.choice(features, max(1, int(settings.column_share * features)), replace=False).tolist())


def best_split(g: np.ndarray, h: np.ndarray, settings: GbtSettings) -> tuple[int, float, float, float, float, float]:
    """(last left bin, gain, g and h on the left, g and h in all) of one node and feature; gain 0 without a split.

    The gain of a split is GL^2/(HL + ridge) + GR^2/(HR + ridge) - G^2/(H + ridge).
    """
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = float(g.sum()), float(h.sum())
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + settings.ridge) + right_g**2 / (right_h + settings.ridge) - all_g**2 / (all_h + settings.ridge)
    least = settings.least_hessian * ALIKE
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
    most = gain.max(initial=0.0)
    if most <= settings.least_gain:
        return 0, 0.0, 0.0, 0.0, all_g, all_h
    at = int(np.argmax(gain >= most * ALIKE))
    return at, float(gain[at]), float(left_g[at]), float(left_h[at]), all_g, all_h


def quantile_cuts(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Increasing cut points of every feature, at most ``bins`` - 1 of them; a value of the rows each.

    The largest value is no cut, so each cut parts the rows.
    """
    finite = [F.when(F.abs(F.col("x")[i]) < float("inf"), F.col("x")[i]).alias(f"x{i}") for i in range(features)]
    wide = rows.select(*finite)
    shares = [k / bins for k in range(1, bins)] + [1.0]
    found = wide.approxQuantile(wide.columns, shares, 0.25 / bins)
    return [np.unique(cuts)[:-1] if cuts else np.zeros(0) for cuts in found]


STATE = "turn long, label double, out int, bins binary, margins binary"


def binned(rows: DataFrame, cuts: Sequence[np.ndarray], models: int) -> DataFrame:
    """Rows as (turn, label, out, bins, margins): a bin number per feature, a margin of 0 per model."""
    kind = np.uint8 if max((len(c) for c in cuts), default=0) < 256 else np.uint16
    start = np.zeros(models).tobytes()

    def bin_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"), len(cuts))
            numbers = np.empty(x.shape, kind)
            for f, own in enumerate(cuts):
                numbers[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(own, x[:, f], side="left"))
            rest = [pa.array([row.tobytes() for row in numbers], pa.binary()), pa.array([start] * len(x), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("turn", "label", "out")), *rest], ["turn", "label", "out", "bins", "margins"])

    return rows.mapInArrow(bin_batches, STATE)


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column of one length as a matrix; nulls are not numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def bytes_of(column: pa.BinaryArray, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def fit(rows: DataFrame, settings: GbtSettings = GbtSettings(), models: int = 1, key: str | None = None) -> tuple[list[Trees], DataFrame]:
    """``models`` ensembles on ``(label, features[, out])``, and every row's margins.

    Model k is fitted on the rows whose ``out`` is not k; ``ALL`` rows are in
    every model. ``NONE`` rows are in no fit and stop the only model by their
    area under the ROC curve. Draws of rows follow ``key``, else the row's
    values. A model's positives weigh as much as its negatives. The second
    result is (turn, label, out, margins): of each row its hash, and the
    log-odds by all rounds of each model as binary doubles. Rows without label
    are left out. Without rows or features there are no trees.
    """
    values = vector_to_array("features") if isinstance(rows.schema["features"].dataType, VectorUDT) else F.col("features").cast("array<double>")
    out = F.col("out").cast("int") if "out" in rows.columns else F.lit(ALL)
    plain = rows.select(F.col("label").cast("double").alias("label"), out.alias("out"), values.alias("x"), *([key] if key else []))
    plain = plain.filter("label is not null")
    turn = F.xxhash64(key) if key else F.xxhash64("label", "x")
    plain = plain.select(turn.alias("turn"), "label", "out", "x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = plain.groupBy("out", "label").count().collect()
        first = plain.select(F.size("x").alias("n")).first()
        features = first["n"] if first else 0
        cuts = quantile_cuts(plain.filter(F.col("out") != NONE), features, settings.bins)
        state = settled(binned(plain, cuts, models).hint("rebalance"))
    finally:
        plain.unpersist()
    counts = np.zeros((models, 2))
    for k in range(models):
        for row in sizes:
            if row["out"] not in (k, NONE):
                counts[k, int(row["label"] == 1.0)] += row["count"]
    weights = counts[:, 0] / np.maximum(counts[:, 1], 1.0)
    stops = any(row["out"] == NONE for row in sizes)
    if stops and models > 1:
        raise ValueError("only one model can be stopped by held-out rows")

    grown = [Growing() for _ in range(models)]
    areas: list[float] = []
    try:
        rounds = settings.max_iter if features else 0
        for done in range(0, rounds, settings.carry):
            blocks = batches_of(state, features, models)
            for tree in range(done, min(done + settings.carry, rounds)):
                before = blocks
                if tree > done:
                    blocks = moved(before, [Part.of(g, 1) for g in grown], settings.max_depth)
                grow(blocks, grown, tree, weights, features, cuts, settings)
                if before is not blocks:
                    before.unpersist()
            blocks.unpersist()
            recent = len(grown[0].roots) - done
            if stops:
                areas += prefix_areas(state, grown[0], recent, features, settings.max_depth)
                if len(areas) - 1 - best_round(areas) >= settings.patience:
                    break
            older, state = state, settled(carried(state, grown, recent, features, settings.max_depth))
            older.unpersist()
        ends = state.select("turn", "label", "out", "margins")
    finally:
        state.unpersist()
    fitted = [g.done(cuts, settings.max_depth) for g in grown]
    if areas:
        fitted = [fitted[0].prefix(patience_prefix(areas, settings.patience))]
    return fitted, ends


def settled(rows: DataFrame) -> DataFrame:
    """Written to the shared folder, read back and kept in memory as far as it goes."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).persist(StorageLevel.MEMORY_AND_DISK)


def best_round(areas: Sequence[float]) -> int:
    """The first round with the largest area."""
    return int(np.argmax(areas))


def patience_prefix(areas: Sequence[float], patience: int) -> int:
    """Trees to keep: up to the best round before ``patience`` rounds without a larger area."""
    best, at = -np.inf, 0
    for i, area in enumerate(areas):
        if area > best:
            best, at = area, i
        elif i - at >= patience:
            break
    return at + 1


def with_trees(margins: np.ndarray, bins: np.ndarray, parts: Sequence[Part], trees: int, depth: int) -> np.ndarray:
    """The carried margins with the first ``trees`` trees of ``parts`` added."""
    margins, rows = margins.copy(), np.arange(len(bins))
    for k, part in enumerate(parts):
        for tree in range(trees):
            margins[:, k] += part.value[part.node(tree, bins, rows, depth)]
    return margins


def bins_of(batch: pa.RecordBatch, features: int) -> np.ndarray:
    kind = np.uint8 if len(batch.column("bins")[0].as_py()) == features else np.uint16
    return bytes_of(batch.column("bins"), kind, features)


#: Of some rows: random numbers, labels, marks, bins and carried margins.
Batch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def batches_of(state: DataFrame, features: int, models: int) -> RDD[Batch]:
    """The rows as numpy arrays, kept in memory as far as it goes.

    The passes of a fit are many and short; as jobs over these arrays, reduced
    by key, one takes less than half the time it takes as a query.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = [batch.column(c).to_numpy() for c in ("turn", "label", "out")]
                arrays = (*plain, bins_of(batch, features), bytes_of(batch.column("margins"), float, models))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(arrays, 5)], pa.binary())], ["arrays"])

    packed = state.mapInArrow(pack, "arrays binary")
    return packed.rdd.map(lambda row: pickle.loads(row["arrays"])).persist(StorageLevel.MEMORY_AND_DISK)


def moved(blocks: RDD[Batch], parts: Sequence[Part], depth: int) -> RDD[Batch]:
    """The rows with one more tree of every model in their margins, kept in memory as far as it goes."""

    def add(batch: Batch) -> Batch:
        return *batch[:4], with_trees(batch[4], batch[3], parts, 1, depth)

    return blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def grow(
    blocks: RDD[Batch], grown: Sequence[Growing], tree: int, weights: np.ndarray,
    features: int, cuts: Sequence[np.ndarray], settings: GbtSettings,
) -> None:
    """Add one tree to every model, level by level; the margins of ``blocks`` hold all trees before it."""
    bins = max((len(c) for c in cuts), default=0) + 1
    columns = [columns_of(settings, k, tree, features) if features else [] for k in range(len(grown))]
    open_nodes = []
    for g in grown:
        g.roots.append(len(g.feature))
        open_nodes.append([g.add(0.0, 0.0)])
    for depth in range(settings.max_depth):
        if not any(open_nodes):
            return
        found = level_splits(blocks, grown, tree, depth, open_nodes, columns, weights, features, bins, settings)
        for k, g in enumerate(grown):
            nodes, open_nodes[k] = open_nodes[k], []
            for node in nodes:
                own = found.get((k, node), [])
                if not own:
                    continue
                most = max(s[0] for s in own) * ALIKE
                gain, feature, at, left_g, left_h, all_g, all_h = min((s for s in own if s[0] >= most), key=lambda s: s[1])
                if depth == 0:
                    g.value[node], g.cover[node] = leaf_value(all_g, all_h, settings), all_h
                if gain > 0:
                    g.feature[node], g.bin[node], g.value[node] = feature, at, 0.0
                    g.left[node] = g.add(leaf_value(left_g, left_h, settings), left_h)
                    g.add(leaf_value(all_g - left_g, all_h - left_h, settings), all_h - left_h)
                    open_nodes[k] += [g.left[node], g.left[node] + 1]


def leaf_value(g: float, h: float, settings: GbtSettings) -> float:
    return -settings.step_size * g / (h + settings.ridge)


def level_splits(blocks, grown, tree, depth, open_nodes, columns, weights, features, bins, settings) -> dict:
    """Best split per model and open node: lists of (gain, feature, bin, left g, left h, g, h), one per feature."""
    parts = [Part.of(g, 1) for g in grown]
    # Rows of leaves that are not open any more have place -1.
    places = []
    for part, nodes in zip(parts, open_nodes, strict=True):
        place = np.full(len(part.feature), -1)
        place[np.array(nodes, np.int64) - part.first] = np.arange(len(nodes))
        places.append(place)
    share, seed = settings.row_share, settings.seed

    def sums(batches: Iterable[Batch]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        held = [np.zeros((2, len(own), len(nodes) * bins)) for own, nodes in zip(columns, open_nodes, strict=True)]
        for turn, label, out, numbers, margins in batches:
            rows = np.arange(len(label))
            taken = drawn(turn, seed * 1_000_003 + tree, share)
            for k, part in enumerate(parts):
                place = places[k][part.node(0, numbers, rows, depth)]
                used = np.flatnonzero(taken & (out != k) & (out != NONE) & (place >= 0))
                if not len(used):
                    continue
                p, y = sigmoid(margins[used, k]), label[used]
                weight = np.where(y == 1.0, weights[k], 1.0)
                g, h = weight * (p - y), weight * p * (1.0 - p)
                base, own = place[used] * bins, numbers[used].T
                for i, f in enumerate(columns[k]):
                    at = base + own[f]
                    held[k][0, i] += np.bincount(at, g, held[k].shape[2])
                    held[k][1, i] += np.bincount(at, h, held[k].shape[2])
        for k, (own, nodes) in enumerate(zip(columns, open_nodes, strict=True)):
            table = held[k].reshape(2, len(own), len(nodes), bins)
            for i, f in enumerate(own):
                for j, node in enumerate(nodes):
                    if table[1, i, j].any():
                        yield (k, node, f), table[:, i, j].copy()

    most_parts = min(blocks.getNumPartitions(), int(blocks.ctx.getConf().get("spark.sql.shuffle.partitions", "200")))
    splits = blocks.mapPartitions(sums).reduceByKey(np.add, max(1, most_parts)).mapValues(lambda s: best_split(s[0], s[1], settings))
    # One split per model, open node and column of a tree: bounded by the settings.
    found: dict[tuple[int, int], list] = {}
    for (k, node, f), (at, gain, *rest) in splits.collect():
        found.setdefault((k, node), []).append((gain, f, at, *rest))
    return found


def carried(state: DataFrame, grown: Sequence[Growing], recent: int, features: int, depth: int) -> DataFrame:
    """``state`` with the last ``recent`` trees in its margins."""
    parts = [Part.of(g, recent) for g in grown]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = with_trees(bytes_of(batch.column("margins"), float, len(parts)), bins_of(batch, features), parts, recent, depth)
                new = pa.array([row.tobytes() for row in margins], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], batch.schema.names)

    return state.mapInArrow(add, STATE)


def prefix_areas(state: DataFrame, grown: Growing, recent: int, features: int, depth: int) -> list[float]:
    """Area under the ROC curve of the held-out rows after each of the last ``recent`` trees; 0.5 with one label."""
    part = Part.of(grown, recent)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, margin = bins_of(batch, features), bytes_of(batch.column("margins"), float, 1)[:, 0]
            rows = np.arange(len(bins))
            for tree in range(recent):
                margin = margin + part.value[part.node(tree, bins, rows, depth)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), tree), pa.int32()), pa.array(margin), batch.column("label")],
                    ["tree", "margin", "label"],
                )

    scored = state.filter(F.col("out") == NONE).mapInArrow(score, "tree int, margin double, label double")
    found = {r["tree"]: r["auroc"] for r in curves.auroc_by(scored, ["tree"], "margin", "label").collect()}
    return [found.get(tree) if found.get(tree) is not None else 0.5 for tree in range(recent)]
