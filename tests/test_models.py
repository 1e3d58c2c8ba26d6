"""Invariants of fitted models and their attributions."""

import random
from collections import Counter
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import boosting, curves, embed, epochs, explain, features, models
from riskloom.operators.features import fit_tfidf, tfidf_long, vocabulary_of, with_terms
from riskloom.session import shared_folder
from riskloom.sources import artifacts

SETTINGS = models.GbtSettings(max_iter=5, max_depth=3, patience=2)
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).round(2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) * 0.5) > 0.8).astype(float)
    rows = [(int(i), float(y[i]), [float(v) for v in x[i]]) for i in range(400)]
    table = spark.createDataFrame(rows, "id int, label double, x array<double>")
    return table.select("id", "label", array_to_vector("x").alias("features")).cache()


@pytest.fixture(scope="module")
def cross_fitted(matrix):
    return models.calibrate_isotonic(matrix, "id", 3, SETTINGS)


@pytest.fixture(scope="module")
def calibrated(cross_fitted):
    return cross_fitted.model


def test_patience():
    assert models.patience_prefix([1, 2, 3], 2) == 3
    assert models.patience_prefix([1, 3, 2, 2, 4], 2) == 2
    assert models.patience_prefix([1, 3, 2, 3.5, 2], 3) == 4


def test_early_stop_keeps_a_prefix(matrix):
    fold = F.col("id") % 4
    model = models.train_gbt(matrix.filter(fold != 0), matrix.filter(fold == 0), SETTINGS)
    assert 1 <= model.n_trees <= 5


def test_calibration_is_monotone_and_bounded(matrix, calibrated):
    scored = calibrated.transform(matrix).select("probability").toPandas()
    assert scored.probability.between(0, 1).all()
    for curve in calibrated.calibrations:
        assert list(curve.value) == sorted(curve.value) and list(curve.at) == sorted(curve.at)


def test_reloaded_model_scores_equal(spark, matrix, calibrated):
    folder = shared_folder(spark)
    artifacts.model_sink(calibrated, folder)
    again = artifacts.model_scan(folder).transform(matrix).select("id", F.col("probability").alias("q"))
    gap = calibrated.transform(matrix).join(again, "id").agg(F.max(F.abs(F.col("probability") - F.col("q")))).first()[0]
    assert gap == 0.0


def test_stored_model_belongs_to_its_rows(spark, matrix, calibrated):
    fits = []

    def fit():
        fits.append(1)
        return calibrated, 0.3

    rows = matrix.select("id", "label", "features")
    score = lambda model: model.transform(matrix).agg(F.sum("probability")).first()[0]
    first, _ = artifacts.stored_model(rows, "a", fit)
    again, threshold = artifacts.stored_model(rows, "a", fit)
    assert len(fits) == 1 and threshold == 0.3
    assert score(again) == pytest.approx(score(first))
    artifacts.stored_model(rows.filter("id > 0"), "a", fit)
    artifacts.stored_model(rows, "b", fit)
    assert len(fits) == 3


def test_threshold_comes_from_held_out_rows(matrix, cross_fitted):
    rows = cross_fitted.held_out.toPandas()
    assert len(rows) == 400 and rows.probability.between(0, 1).all()
    own = np.stack([r["features"].toArray() for r in matrix.collect()])
    every = [boosting.sigmoid(m.margins(own)) for m in cross_fitted.model.members]
    for k, found in rows.groupby("fold").score:
        assert np.isin(found.round(9), every[k].round(9)).all()
    threshold = models.tuned_threshold(cross_fitted.held_out)
    f1 = lambda t: 2 * ((rows.probability >= t) & (rows.label == 1)).sum() / ((rows.probability >= t).sum() + (rows.label == 1).sum())
    assert f1(threshold) == pytest.approx(max(f1(t) for t in rows.probability.unique()))


def test_held_out_probability_has_not_seen_its_row(spark, matrix):
    """Labels that nothing explains: a curve fitted on the rows themselves would seem to know them."""
    noise = matrix.withColumn("label", (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)) == 0).cast("double"))
    found = models.calibrate_isotonic(noise, "id", 3, SETTINGS).held_out
    assert curves.auroc(found, "probability", "label").first()["auroc"] < 0.6


def margin(leaves, x, known):
    """Expected margin of a row when only some features are known."""
    total = 0.0
    for i in range(len(leaves.value)):
        part = leaves.value[i]
        for j, f in enumerate(leaves.feature[i]):
            if f < 0:
                continue
            if f in known:
                part *= leaves.low[i, j] < x[f] <= leaves.high[i, j]
            else:
                part *= leaves.share[i, j]
        total += part
    return total


def test_attributions_are_exact(matrix, calibrated):
    members = models.gbt_members(calibrated)
    leaves = explain.tree_leaves(members)
    rows = matrix.filter("id < 12").coalesce(1)
    found = explain.tree_attributions(rows, members).orderBy("id").collect()
    vectors = [r["features"].toArray() for r in rows.orderBy("id").collect()]
    for row, x in zip(found, vectors):
        for i in range(4):
            others = [j for j in range(4) if j != i]
            value = 0.0
            for size in range(4):
                weight = factorial(size) * factorial(3 - size) / factorial(4)
                for s in combinations(others, size):
                    value += weight * (margin(leaves, x, {*s, i}) - margin(leaves, x, set(s)))
            assert row["phi"][i] == pytest.approx(value, abs=1e-9)
        assert row["base_value"] == pytest.approx(margin(leaves, x, set()), abs=1e-9)


def test_attributions_add_up_to_log_odds(matrix, calibrated):
    members = models.gbt_members(calibrated)
    attributed = explain.tree_attributions(matrix, members).select("id", "log_odds", "phi", "base_value")
    rows = matrix.join(attributed, "id").collect()
    for row in rows:
        odds = np.mean([m.margins(row["features"].toArray()[None])[0] for m in members])
        assert row["log_odds"] == pytest.approx(odds, abs=1e-6)
        assert row["log_odds"] == pytest.approx(row["base_value"] + sum(row["phi"]), abs=1e-9)


def test_section_order_and_rest(spark):
    row = spark.sql("select 0.2D a, -0.5D b, 0.1D c, 1e-9D d")
    parts = {n: F.col(n) for n in NAMES}
    found = row.select(
        explain.section_attributions(parts, {"One": ["a", "c"], "Two": ["b"], "None": ["z"]}, {"a": "Label a"}).alias("s")
    ).first()["s"]
    assert [(s["section"], s["contribution"], s["direction"]) for s in found] == [
        ("Two", -0.5, "reduces risk"), ("One", 0.3, "increases risk"),
    ]
    assert [(f["name"], f["shap"]) for f in found[1]["features"]] == [("Label a", 0.2), ("c", 0.1)]


def test_summary_sentences(spark):
    schema = "s array<struct<section string, contribution double, features array<struct<name string, shap double>>>>"
    rows = spark.createDataFrame(
        [
            ([("Eligibility criteria", 0.34, [("Criteria length", 0.21)]), ("Primary endpoints", 0.18, []), ("Study design", -0.15, [])],),
            ([("Study design", 0.1, [("Randomized", 0.1)])],),
            ([],),
        ],
        schema,
    )
    texts = [r[0] for r in rows.coalesce(1).select(explain.nl_summary(F.col("s"), F.lit("HIGH RISK"), F.lit(0.82))).collect()]
    assert texts[0] == (
        "This trial is predicted HIGH RISK (82% probability) primarily because the eligibility criteria and primary endpoints "
        "are both strong predictors of early termination in historical trials. The strongest individual signal is "
        '"Criteria length" (SHAP contribution: +0.21). However, the study design partially offset this risk.'
    )
    assert "primarily due to concerns with the study design" in texts[1] and "However" not in texts[1]
    assert texts[2] == "This trial is predicted HIGH RISK (82% probability) with no single dominant risk factor."


def test_term_weights_equal_the_formula(spark):
    docs = ["the cat sat", "the dog sat down", "a cat and the dog", "", "the the the"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, body string")
    model = fit_tfidf(with_terms(rows, "body").select("id", "terms"), size=5, min_df=2)
    names = vocabulary_of(model)
    assert set(names) == {"the", "cat", "dog", "sat", "the dog"}
    long = tfidf_long(model.transform(with_terms(rows, "body").select("id", "terms")), names, "id").collect()
    got = {(r["id"], r["term"]): r["tfidf"] for r in long}
    df = {"the": 4, "cat": 2, "dog": 2, "sat": 2, "the dog": 2}
    idf = {t: np.log(6 / (1 + n)) + 1 for t, n in df.items()}
    norm = np.sqrt(idf["the"] ** 2 + idf["cat"] ** 2 + idf["sat"] ** 2)
    assert got[(0, "cat")] == pytest.approx(idf["cat"] / norm)
    assert got[(4, "the")] == pytest.approx(1.0)
    assert not any(key == 3 for key, _ in got)


def test_term_statistics_of_some_lists_at_a_time():
    draw = random.Random(5)
    lists = [[draw.choice("abcdef") for _ in range(draw.choice([0, 1, 2, 9]))] if draw.random() < 0.9 else None for _ in range(60)]
    held = pa.array([["before"], *lists], pa.list_(pa.string())).slice(1)
    for pairs in (False, True):
        every = [own + [f"{a} {b}" for a, b in zip(own, own[1:])] * pairs for own in (x or [] for x in lists)]
        want = Counter(t for own in every for t in own), Counter(t for own in every for t in set(own))
        for most in (1, 7, 10_000):
            got = Counter(), Counter()
            for part in features._some_lists(held, most):
                for row in (r for counts in features._counted_terms(part, pairs) for r in counts.to_pylist()):
                    got[0][row["term"]] += row["total"]
                    got[1][row["term"]] += row["df"]
            assert got == want


def test_term_statistics_equal_plain_counts(spark):
    docs = ["The cat sat", "the dog sat down\nthe cat", None, "", "a", "Ünïcode ünïcode x1", "the the the"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs * 3)], "id int, body string")
    listed = with_terms(rows, "body").select("id", "terms")
    every = [r["terms"] for r in listed.collect()]
    want = {(t, sum(t in own for own in every), sum(own.count(t) for own in every)) for t in {t for own in every for t in own}}
    for terms in (listed, features.document_terms(rows, "id", "body")):
        found = features.doc_frequency(terms)
        assert found.dtypes == [("term", "string"), ("df", "bigint"), ("total", "bigint")]
        assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 5, 8, 30])
def test_the_vocabulary_is_that_of_all_terms(spark, size):
    draw = random.Random(size)
    docs = [" ".join(draw.choices(["aa", "bb", "cc", "dd", "ee", "ff"], [9, 9, 4, 2, 1, 1], k=draw.choice([0, 1, 4, 12]))) for _ in range(40)]
    rows = spark.createDataFrame([*enumerate([*docs, "gg " * 90, None])], "id int, body string")
    terms = features.document_terms(rows, "id", "body")
    model, want = fit_tfidf(terms, size, 2), fit_tfidf(terms.drop("singles"), size, 2)
    assert vocabulary_of(model) == vocabulary_of(want)
    assert model.stages[1].getScalingVec() == want.stages[1].getScalingVec()
    known = features.vocabulary_terms(terms, vocabulary_of(model))
    vectors = [m.transform(t).select("id", "tfidf").orderBy("id").collect() for m, t in ((want, terms), (model, known))]
    assert vectors[0] == vectors[1]


def test_the_vocabulary_counts_pairs_of_its_own_terms_only(spark):
    rows = spark.createDataFrame([(i, "aa bb cc " * 3 + f"rare{i} common") for i in range(6)], "id int, body string")
    terms = features.document_terms(rows, "id", "body")
    assert features._candidates(terms, 3, 2) == ["aa", "bb", "cc"]
    found = features.doc_frequency(terms, ["aa", "bb", "cc"]).collect()
    assert {r["term"] for r in found} == {"aa", "bb", "cc", "aa bb", "bb cc", "cc aa"}
    assert features._candidates(terms, 5, 2) is None and features._candidates(terms.drop("singles"), 3, 2) is None


def test_embedding_sections(spark):
    rows = spark.createDataFrame([(1, "some text", ""), (2, None, "more words")], "id int, full_text string, eligibility_criteria string")
    made = embed.embed_sections(rows, "id", dimension=16)
    assert made.count() == 6
    assert embed.shape_audit(made, "embedding", 16).first()["wrong_size"] == 0
    norms = [sum(v * v for v in r["embedding"]) for r in made.collect()]
    assert np.allclose(norms, 1.0, atol=1e-6)


def test_own_encoder(spark):
    def make():
        def encode(texts):
            return np.array([[len(t), t == "[UNK]"] for t in texts], dtype="float32")

        return encode

    rows = spark.createDataFrame([(1, "four"), (2, " ")], "id int, body string")
    made = embed.embed_texts(rows, "body", make_encoder=make).orderBy("id").collect()
    assert [r["embedding"] for r in made] == [[4.0, 0.0], [5.0, 1.0]]


def test_copies_of_a_key_are_explained_once_each(matrix, calibrated):
    row = matrix.filter("id = 5")
    copies = row.unionByName(row).unionByName(matrix.filter("id = 6"))
    scored = models.score_records(copies, calibrated, 0.4)
    found = explain.explain_batch(scored, models.gbt_members(calibrated), NAMES).collect()
    assert sorted(r["id"] for r in found) == [5, 5, 6]
    assert all(r["natural_language_summary"].startswith("This trial is predicted") for r in found)
    assert {"section_attributions", "base_value", "risk_tier", "confidence_pct"} <= set(found[0].asDict())


def test_epochs_resume_to_the_same_weights(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)) * (rng.random((600, 6)) < 0.5)
    y = (x[:, 0] - 2 * x[:, 3] + 0.3 * rng.normal(size=600) > 0.7).astype(float)
    rows = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(600)], "id long, label double, v array<double>").repartition(5)
    train, held = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    settings = epochs.EpochSettings(epochs=4, steps=5)
    whole = epochs.train_epochs(train, held, "id", "v", shared_folder(spark), settings)
    folder = shared_folder(spark)
    assert epochs.train_epochs(train, held, "id", "v", folder, settings, stop_after=2).count() == 2
    again = epochs.train_epochs(train, held, "id", "v", folder, settings)
    state = lambda t: np.array([[*r["weights"], r["loss"], r["auroc"]] for r in t.orderBy("epoch").collect()])
    assert state(whole).shape == (4, 9) and np.allclose(state(whole), state(again), atol=1e-12)
    best, area = epochs.best_model(again, "v")
    assert area > 0.9 and area == max(r["auroc"] for r in again.collect())
    kept = epochs.progress(again).orderBy("epoch").collect()
    assert [r["improved"] for r in kept] == [r["auroc"] > max([0.0] + [k["auroc"] for k in kept[:i]]) for i, r in enumerate(kept)]
    # One step equals the gradient written out.
    weight = np.where(y == 1, 1 - y[np.arange(600) % 4 > 0].mean(), y[np.arange(600) % 4 > 0].mean())
    w = rng.normal(size=7)
    sample = spark.createDataFrame([(float(y[i]), float(weight[i]), x[i].tolist()) for i in range(50)], "label double, weight double, x array<double>").repartition(3)
    slope, loss = epochs.gradient(sample, w)
    p = boosting.sigmoid(x[:50] @ w[:-1] + w[-1])
    gap = weight[:50] * (p - y[:50])
    assert np.allclose(slope, [*(gap @ x[:50]), gap.sum()] / weight[:50].sum())
    assert loss == pytest.approx(-(weight[:50] * (y[:50] * np.log(p) + (1 - y[:50]) * np.log(1 - p))).sum() / weight[:50].sum())
