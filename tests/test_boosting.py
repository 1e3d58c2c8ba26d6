"""Boosting and calibration beside plain repetitions on few rows."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import boosting, calibration, explain, models, ranking

SETTINGS = boosting.GbtSettings(max_iter=14, max_depth=3, step_size=0.3, patience=4, carry=4, least_hessian=1.0)


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(1)
    x[:, 4] = rng.integers(0, 2, n)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.5) > 0.8).astype(float)
    return x, y


def table(spark, x, y, out):
    rows = [(i, float(y[i]), [float(v) for v in x[i]], int(out[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, label double, features array<double>, out int").repartition(3)


def turns(spark, n):
    return np.array([r[0] for r in spark.range(n).select(F.xxhash64("id"), "id").orderBy("id").collect()])


def plain_fit(x, y, turn, used, cuts, settings, model=0):
    """Margins of all rows after each round, every cut of every node tried by summing rows."""
    weight = np.where(y == 1, (y[used] == 0).sum() / max((y[used] == 1).sum(), 1), 1.0)
    margin, after = np.zeros(len(y)), []
    for tree in range(settings.max_iter):
        columns = boosting.columns_of(settings, model, tree, x.shape[1])
        taken = used & boosting.drawn(turn, settings.seed * 1_000_003 + tree, settings.row_share)
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows, depth):
            own = rows & taken
            total_g, total_h = g[own].sum(), h[own].sum()
            step[rows] = -settings.step_size * total_g / (total_h + settings.ridge)
            if depth == settings.max_depth:
                return
            tried = []
            for f in columns:
                for cut in cuts[f]:
                    left = own & (x[:, f] <= cut)
                    lg, lh = g[left].sum(), h[left].sum()
                    rg, rh = total_g - lg, total_h - lh
                    if min(lh, rh) < settings.least_hessian * (1 - 1e-9):
                        continue
                    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - total_g**2 / (total_h + 1)
                    tried.append((gain, f, cut))
            most = max((t[0] for t in tried), default=0.0)
            if most > settings.least_gain:
                _, f, cut = next(t for t in tried if t[0] >= most * (1 - 1e-9))
                grow(rows & (x[:, f] <= cut), depth + 1)
                grow(rows & (x[:, f] > cut), depth + 1)

        grow(np.ones(len(y), bool), 0)
        margin = margin + step
        after.append(margin)
    return after


def plain_auroc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def all_cuts(x):
    """Few distinct values: every one but the largest is a cut."""
    return [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]


def test_trees_equal_a_plain_fit(spark):
    x, y = made(500)
    out = np.where(np.arange(500) % 5 == 0, boosting.NONE, boosting.ALL)
    fitted, _ = boosting.fit(table(spark, x, y, out), SETTINGS, key="id")
    used = out == boosting.ALL
    after = plain_fit(x, y, turns(spark, 500), used, all_cuts(x[used]), SETTINGS)
    areas = [plain_auroc(m[~used], y[~used]) for m in after]
    kept = boosting.patience_prefix(areas, SETTINGS.patience)
    best = max(areas[: kept + SETTINGS.patience])
    assert areas[kept - 1] == best and all(a < best for a in areas[: kept - 1])
    assert fitted[0].n_trees == kept
    assert np.allclose(fitted[0].margins(x), after[kept - 1], atol=1e-9)


def test_models_of_folds_grow_in_the_same_passes(spark):
    x, y = made(300, 5)
    out = np.arange(300) % 3
    fitted, ends = boosting.fit(table(spark, x, y, out), SETTINGS, 3, "id")
    for k in range(3):
        after = plain_fit(x, y, turns(spark, 300), out != k, all_cuts(x), SETTINGS, k)
        assert np.allclose(fitted[k].margins(x), after[-1], atol=1e-9)
    carried = {r["turn"]: np.frombuffer(r["margins"]) for r in ends.collect()}
    for turn, row in zip(turns(spark, 300), x, strict=True):
        assert np.allclose(carried[turn], [m.margins(row[None])[0] for m in fitted], atol=1e-9)


def test_many_bins_and_wide_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 30))
    y = (x[:, 7] > 0.3).astype(float)
    rows = table(spark, x, y, np.full(1500, boosting.ALL))
    for bins in (16, 600):
        fitted, _ = boosting.fit(rows, boosting.GbtSettings(max_iter=6, max_depth=2, step_size=0.5, bins=bins, carry=3), key="id")
        assert plain_auroc(fitted[0].margins(x), y) > 0.98


def test_rows_without_values_or_labels(spark):
    empty = spark.createDataFrame([], "label double, features array<double>")
    fitted, ends = boosting.fit(empty, SETTINGS)
    assert fitted[0].n_trees == 0 and ends.count() == 0
    odd = spark.createDataFrame([(1.0, [float("nan"), 1.0]), (0.0, [None, 2.0]), (0.0, [float("inf"), 3.0]), (None, [1.0, 1.0])] * 20, "label double, features array<double>")
    settings = boosting.GbtSettings(max_iter=3, least_hessian=0.0, row_share=1.0, column_share=1.0)
    fitted, ends = boosting.fit(odd, settings)
    assert ends.count() == 60
    margins = fitted[0].margins(np.array([[np.nan, 1.0], [np.nan, 2.0], [np.inf, 3.0]]))
    assert margins[0] > margins[1] and margins[0] > margins[2]
    one = spark.createDataFrame([(1.0, [1.0]), (1.0, [2.0])], "label double, features array<double>")
    assert boosting.fit(one, settings)[0][0].n_trees == 3


def test_folds_hold_an_equal_share_of_each_label(spark):
    rows = spark.range(1013).select("id", F.when(F.col("id") % 23 == 0, 1.0).otherwise(0.0).alias("label"))
    counts = {(r["label"], r["fold"]): r["count"] for r in ranking.stratified_folds(rows, "id", "label").groupBy("label", "fold").count().collect()}
    for label, n in ((0.0, 968), (1.0, 45)):
        own = [counts.get((label, k), 0) for k in range(5)]
        assert max(own) - min(own) <= 1 and sum(own) == n
    copies = ranking.stratified_folds(rows.unionByName(rows.filter("id < 30")), "id", "label")
    assert copies.groupBy("id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    odd = spark.createDataFrame([(None, 1.0), (1, None)], "id long, label double")
    assert [r["fold"] for r in ranking.stratified_folds(odd, "id", "label").collect()] == [0, 0]


def plain_pooling(score, label):
    order = np.argsort(score, kind="stable")
    cells = {}
    for s, v in zip(score[order], label[order], strict=True):
        n, t = cells.get(s, (0, 0))
        cells[s] = (n + 1, t + v)
    at = list(cells)
    return calibration.pooled(at, at, [cells[s][0] for s in at], [cells[s][1] for s in at])


def test_pooling_of_ranges_equals_one_pass(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        (F.col("id") % 2).cast("int").alias("fold"),
        ((F.col("id") * 7919 % n) / n).alias("score"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < (F.col("id") * 7919 % n) / n).cast("double").alias("label"),
    )
    assert rows.select("score").distinct().count() == n
    found = calibration.isotonic_blocks(rows, "fold", ranges=37).toPandas().sort_values(["fold", "low"])
    local = rows.toPandas()
    for fold, own in local.groupby("fold"):
        want = plain_pooling(own.score.to_numpy(), own.label.to_numpy())
        got = found[found.fold == fold]
        assert got[["low", "high", "weight", "total"]].to_numpy().tolist() == want
        means = got.total / got.weight
        assert (np.diff(means) > 0).all() and 0 < len(got) < 5000
    curve = calibration.Isotonic.of(found[found.fold == 0][["low", "high", "weight", "total"]].to_numpy().tolist())
    assert np.abs(curve(np.linspace(0.1, 0.9, 50)) - np.linspace(0.1, 0.9, 50)).max() < 0.05


def test_pooling_of_few_scores(spark):
    rows = spark.createDataFrame([(0, 0.5, 1.0), (0, 0.5, 0.0), (0, None, 1.0), (0, 0.1, None), (1, 0.2, 1.0), (1, 0.3, 0.0)], "fold int, score double, label double")
    found = {k: (c.at.tolist(), c.value.tolist()) for k, c in calibration.isotonic_models(rows, "fold").items()}
    assert found == {0: ([0.5, 0.5], [0.5, 0.5]), 1: ([0.2, 0.3], [0.5, 0.5])}
    assert calibration.isotonic_models(rows.limit(0), "fold") == {}


def deep_tree(depth, features, rng):
    """A full random tree; leaves have a value, inner nodes a cut, both a cover."""
    grown = boosting.Growing()
    grown.roots.append(grown.add(0.0, 1000.0))
    level, cuts = [0], [np.sort(rng.normal(size=9)) for _ in range(features)]
    for _ in range(depth):
        following = []
        for node in level:
            share = rng.uniform(0.2, 0.8)
            grown.feature[node], grown.bin[node] = int(rng.integers(features)), int(rng.integers(9))
            grown.left[node] = grown.add(rng.normal(), grown.cover[node] * share)
            grown.add(rng.normal(), grown.cover[node] * (1 - share))
            following += [grown.left[node], grown.left[node] + 1]
        level = following
    return grown.done(cuts, depth)


def known_margin(tree, x, known, node):
    left = int(tree.left[node])
    if left == node:
        return tree.value[node]
    f = tree.feature[node]
    if f in known:
        return known_margin(tree, x, known, left + int(x[f] > tree.cut[node]))
    parts = tree.cover[left], tree.cover[left + 1]
    return sum(c / sum(parts) * known_margin(tree, x, known, left + k) for k, c in enumerate(parts))


@pytest.mark.parametrize("depth,features", [(3, 4), (6, 6), (12, 6), (9, 9)])
def test_attributions_of_deep_trees_are_shapley_values(depth, features):
    rng = np.random.default_rng(depth)
    tree = deep_tree(depth, features, rng)
    leaves = explain.tree_leaves([tree])
    x = rng.normal(size=(2, features))
    found = explain.attribute_batch(x, leaves)
    for row, phi in zip(x, found, strict=True):
        value = {s: known_margin(tree, row, set(s), 0) for n in range(features + 1) for s in combinations(range(features), n)}
        for i in range(features):
            others = [j for j in range(features) if j != i]
            want = sum(
                factorial(n) * factorial(features - n - 1) / factorial(features) * (value[tuple(sorted((*s, i)))] - value[s])
                for n in range(features) for s in combinations(others, n)
            )
            assert phi[i] == pytest.approx(want, abs=1e-9)
        assert leaves.base + phi.sum() == pytest.approx(tree.margins(row[None])[0], abs=1e-9)


def test_ablation_stops_and_tunes_each_set(spark):
    x, y = made(400, 9)
    rows = table(spark, x, y, np.arange(400) % 4).cache()
    narrow = rows.withColumn("features", F.slice("features", 4, 2))
    parts = lambda t: (t.filter("out > 1"), t.filter("out = 1"), t.filter("out = 0"))
    found = {r["feature_set"]: r for r in models.ablation_compare({"all": parts(rows), "few": parts(narrow)}, SETTINGS).collect()}
    assert found["all"]["auroc"] > found["few"]["auroc"] and found["all"]["n_features"] == 5 and found["few"]["n_features"] == 2
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == 100 and 0 < r["threshold"] < 1 and 1 <= r["trees"] <= 14 for r in found.values())


def grown_at_random(rng, trees, depth, features=6):
    grown = boosting.Growing()
    for _ in range(trees):
        open_ = [grown.add(0.0, 100.0)]
        grown.roots.append(open_[0])
        for _ in range(depth):
            below = []
            for node in open_:
                if rng.random() < 0.2:
                    continue
                grown.feature[node], grown.bin[node] = int(rng.integers(features)), int(rng.integers(20))
                grown.left[node] = grown.add(float(rng.normal()), grown.cover[node] * 0.3)
                grown.add(float(rng.normal()), grown.cover[node] * 0.7)
                below += [grown.left[node], grown.left[node] + 1]
            open_ = below
    return grown.done([np.sort(rng.normal(size=21)) for _ in range(features)], depth)


def test_tables_of_leaf_groups_equal_leaf_paths():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[0, 2], x[1, 1], x[2, 0] = np.nan, np.inf, -np.inf
    for depth, deep in ((4, False), (10, True)):
        models = [grown_at_random(rng, 5, depth) for _ in range(2)]
        groups, rest = explain.leaf_groups(models)
        assert (rest is not None) == deep
        found = explain.attribute_groups(x, groups, 6) + (explain.attribute_batch(x, rest) if deep else 0.0)
        assert np.allclose(found, explain.attribute_batch(x, explain.tree_leaves(models)), atol=1e-12)
        # A row costs a look-up per group and feature, not the leaves' arithmetic.
        assert all(len(g.table) <= 256 for g in groups)


def test_margins_column_by_column_equal_the_walk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6))
    x[0, 2], x[1, 1], x[2, 0] = np.nan, np.inf, -np.inf
    for depth in (0, 3, 9):
        tree = grown_at_random(rng, 7, depth)
        clean = np.nan_to_num(x, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        want = np.zeros(len(x))
        for root in tree.roots:
            for i, row in enumerate(clean):
                node = root
                while tree.left[node] != node:
                    node = tree.left[node] + int(row[tree.feature[node]] > tree.cut[node])
                want[i] += tree.value[node]
        assert np.allclose(tree.margins(x), want, atol=1e-12)


def test_a_pass_walks_only_the_newest_tree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(float(rng.random() < 0.3 + 0.4 * (v[0] > 0)), v.tolist(), k) for k, v in enumerate(rng.normal(size=(400, 3)))]
    sent, of = [], boosting.Part.of
    monkeypatch.setattr(boosting.Part, "of", staticmethod(lambda grown, trees: sent.append(trees) or of(grown, trees)))
    settings = boosting.GbtSettings(max_iter=5, max_depth=2, carry=5)
    boosting.fit(spark.createDataFrame(rows, "label double, features array<double>, id long"), settings, key="id")
    # All five trees go to the tasks once, when the margins are written; the passes before get one each.
    assert sorted(sent)[-2:] == [1, 5]
