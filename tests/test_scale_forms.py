"""Scale forms give the same rows as the plain forms, also under skew."""

import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import aggregates, curves, gates, joins, ranking
from riskloom.operators.features import FeatureSpec, engineer_features, fit_medians
from riskloom.plans.lookup import lookup_join
from riskloom.plans.ranges import exact_quantiles, range_cuts, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value."""
    random.seed(7)
    rows = [("hot", 5.0, 1) for _ in range(1000)]
    rows += [(f"k{random.randrange(40)}", round(random.expovariate(0.1), 1), random.randrange(2)) for _ in range(2000)]
    return spark.createDataFrame(rows, "g string, v double, y int").cache()


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_running_totals(spark, skewed, ranges):
    cells = skewed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.max("y").cast("double").alias("m"))
    cuts = range_cuts(cells, "v", ranges)
    got = running_totals(cells, "v", ["n"], ["g"], cuts=cuts, maxima=["m"])
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = cells.withColumns(
        {"n_before": F.coalesce(F.sum("n").over(w), F.lit(0)), "m_before": F.max("m").over(w)}
    )
    columns = ["g", "v", "n", "n_before", "m_before"]
    assert sorted(got.select(columns).collect(), key=str) == sorted(want.select(columns).collect(), key=str)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_exact_quantiles(spark, skewed, ranges):
    got = {r["g"]: (r["a"], r["b"]) for r in exact_quantiles(skewed, "v", {"a": 0.5, "b": 0.95}, ["g"], ranges).collect()}
    for group, rows in skewed.toPandas().groupby("g"):
        want = np.percentile(rows["v"], [50, 95])
        assert np.allclose(got[group], want, rtol=0, atol=1e-12)


def test_quantiles_of_nothing(spark, skewed):
    assert exact_quantiles(skewed.filter("g = 'none'"), "v", {"a": 0.5}, ["g"]).count() == 0


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_auroc_and_threshold(spark, skewed, ranges):
    scores = skewed.select((F.col("v") / 100.0).alias("s"), "y")
    pdf = scores.toPandas()
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert curves.auroc(scores, "s", "y", ranges).first()["auroc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)

    best = (-1.0, 0.0)
    for cut in sorted(pdf.s.unique()):
        said = pdf.s >= cut
        tp, fp, fn = (said & (pdf.y == 1)).sum(), (said & (pdf.y == 0)).sum(), (~said & (pdf.y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn)
        if f1 > best[0] + 1e-15:
            best = (f1, cut)
    found = curves.best_f1_threshold(scores, "s", "y", ranges).first()
    assert (found["f1"], found["threshold"]) == pytest.approx(best)


def test_single_class_and_empty(spark):
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert curves.auroc(one, "s", "y").first()["auroc"] is None
    none = one.filter("y = 0")
    assert curves.confusion_metrics(none, "s", "y", 0.5).first()["recall"] == 0.0
    assert curves.pr_curve(none, "s", "y").count() == 0
    assert curves.evaluate_report(none, "s", "y").count() == 2


def plain_split(rows):
    w = Window.partitionBy("label").orderBy(ranking.order_hash(F.col("id")), "id")
    size = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return rows.withColumn("side", F.when(F.row_number().over(w) <= F.floor(size * 0.2 + 0.5), "test").otherwise("train"))


def test_split_equals_plain_form(spark):
    rows = spark.range(4001).select("id", F.when(F.col("id") % 11 == 0, 1).otherwise(0).alias("label"))
    got = ranking.stratified_split(rows, "id", "label")
    want = plain_split(rows).select("id", F.col("side"))
    assert got.join(want, "id").filter("split <> side").count() == 0
    assert got.count() == 4001


def test_copies_stay_on_one_side(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("id"), F.lit(0).alias("label"))
    got = ranking.stratified_split(rows, "id", "label")
    assert got.count() == 300
    assert got.filter("id = 7").select("split").distinct().count() == 1


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_lookup_of_a_hot_key(spark, skewed, broadcast):
    """The hot key's rows, a third of all, find their value whichever join the optimizer takes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        table = skewed.groupBy("g").agg(F.avg("v").alias("mean")).filter("g <> 'k3'")
        found = lookup_join(skewed, table, "g")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (broadcast == "-1")
        got = found.groupBy("g").agg(F.count("mean").alias("n"), F.sum("y").alias("y"), F.max("mean").alias("mean"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    local = skewed.toPandas().groupby("g")
    for r in got.collect():
        own = local.get_group(r["g"])
        assert (r["n"], r["y"]) == (0 if r["g"] == "k3" else len(own), own.y.sum())
        assert r["mean"] is None if r["g"] == "k3" else r["mean"] == pytest.approx(own.v.mean())


def test_lookup_joins_without_shuffling_the_rows(spark, skewed):
    table = skewed.groupBy("g").agg(F.avg("v").alias("mean"))
    plan = joins.dimension_default_lookup(skewed, table, "g", "mean", 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cache_lookup(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    cache = spark.createDataFrame([(1, "a"), (1, "b"), (9, "z")], "k int, v string")
    found = joins.cache_lookup(rows, cache, "k", lambda m: m.select("k", F.lit("new").alias("v")))
    assert sorted(map(tuple, found.collect())) == [(1, "a", True), (2, "new", False), (3, "new", False)]


def test_alignment(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1,), (3,)], "k int")
    row = joins.alignment_audit(left, right, "k").first()
    assert (row.matched_keys, row.left_only_keys, row.right_only_keys, row.left_rows, row.right_rows) == (1, 1, 1, 3, 2)
    assert not row.aligned
    assert joins.alignment_audit(left, left, "k").first().aligned


def test_gates_raise(spark):
    gates.require(gates.min_rows_gate(spark.range(5), 5))
    with pytest.raises(ValueError, match="min_rows"):
        gates.require(gates.min_rows_gate(spark.range(4), 5))
    with pytest.raises(ValueError, match="no_missing:x"):
        gates.require(gates.null_gate(spark.sql("select double('nan') x, 1 y"), ["x", "y"]))


def test_constant_column_has_no_correlation(spark, skewed):
    rows = skewed.withColumn("c", F.lit(1.0))
    found = aggregates.target_correlation(rows, "y", ["c", "v"]).collect()
    assert [r["column"] for r in found] == ["v", "c"] and found[1]["abs_corr"] is None
    assert {r["column"]: r["std"] for r in aggregates.standard_scaler_fit(rows, ["c"]).collect()} == {"c": 1.0}


def trial(key, size, phase, title="t", criteria="a b"):
    return (key, size, phase, title, criteria, "", 1)


TRIAL = "trial_id int, enrollment_count int, phase_encoded double, official_title string, eligibility_criteria string, full_text string, terminated int"


def sizes_of(spark, rows):
    made = engineer_features(spark.createDataFrame(rows, TRIAL))
    return {r["trial_id"]: round(float(np.expm1(r["log_enrollment"])), 6) for r in made.collect()}


def test_zero_sizes_take_group_medians(spark):
    rows = [trial(1, 10, 1.0), trial(2, 30, 1.0), trial(3, 0, 1.0), trial(4, 0, 2.0), trial(5, None, None), trial(6, 8, 2.5)]
    assert sizes_of(spark, rows) == {1: 10, 2: 30, 3: 20, 4: 150, 5: 150, 6: 8}


def test_all_sizes_zero(spark):
    rows = [trial(1, 0, 1.0), trial(2, 0, 4.0), trial(3, 0, 0.0)]
    assert sizes_of(spark, rows) == {1: 30, 2: 1000, 3: 150}


def test_missing_and_null_texts(spark):
    rows = spark.createDataFrame([trial(1, 5, 1.0, None, None)], TRIAL)
    row = engineer_features(rows).first()
    assert (row.title_length, row.criteria_length, row.outcome_count, row.criteria_unique_ratio) == (0.0, 0.0, 1.0, 0.0)
    bare = rows.select("trial_id")
    assert engineer_features(bare, fit_medians(bare), FeatureSpec()).first()["enrollment_ratio"] == 1.0


def test_empty_table(spark):
    rows = spark.createDataFrame([], TRIAL)
    assert engineer_features(rows).count() == 0


def test_sample_fills_up_with_wildcards(spark):
    rows = spark.range(100).select("id", (F.col("id") < 12).alias("a"), (F.col("id") >= 97).alias("b"))
    got = ranking.sample_per_stratum(rows, "id", {"a": F.col("a"), "b": F.col("b")})
    counts = {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert counts == {"a": 5, "wildcard": 15}
    assert got.select("id").distinct().count() == 20


def test_patterns():
    names = ["has_a", "size", "has_b", "emb_1", "emb_2"]
    assert joins.match_patterns(names, {"x": ["has_b", "has_*"], "y": ["emb_?"], "z": ["none"]}) == {
        "x": ["has_b", "has_a"], "y": ["emb_1", "emb_2"], "z": [],
    }


def test_latencies_without_groups(spark, skewed):
    row = aggregates.latency_summary(skewed, "v").first()
    v = skewed.toPandas()["v"]
    assert row["n"] == 3000 and row["p95_ms"] == pytest.approx(np.percentile(v, 95))
    assert row["per_second"] == pytest.approx(3000 / (v.sum() / 1000))
    assert aggregates.latency_summary(skewed.filter("v < 0"), "v").count() == 0


def test_best_so_far_keeps_rows_of_a_null_group(spark):
    rows = spark.createDataFrame(
        [(None, 1, 0.5), (None, 2, 0.7), ("a", 1, 0.2), ("a", 2, 0.1)], "g string, step int, v double"
    )
    found = ranking.best_so_far(rows, "step", "v", ["g"], ranges=2).collect()
    assert sorted((r["g"] or "", r["step"], r["best_before"], r["improved"]) for r in found) == [
        ("", 1, 0.0, True),
        ("", 2, 0.5, True),
        ("a", 1, 0.0, True),
        ("a", 2, 0.2, False),
    ]


def test_sample_counts_a_repeated_key_once(spark):
    keys = [*range(60), *[7] * 100]
    rows = spark.createDataFrame([(k, k % 2) for k in keys], "id int, kind int")
    strata = {"odd": F.col("kind") == 1, "one": F.col("id") == 7}
    sample = ranking.sample_per_stratum(rows, "id", strata, per_stratum=5, total=20).collect()
    assert len(sample) == len({r.id for r in sample}) == 20
    assert sorted(r.stratum for r in sample if r.stratum != "wildcard") == ["odd"] * 5


def test_cache_generates_once_per_key(spark):
    handed = []

    def make(missed):
        handed.append(missed.count())
        return missed.select("id", F.col("n").alias("v"))

    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0)], "id int, n int")
    cache = spark.createDataFrame([(2, 9)], "id int, v int")
    got = joins.cache_lookup(rows, cache, "id", make).collect()
    assert handed == [1] and {(r.id, r.v, r.cached) for r in got} == {(1, 0, False), (2, 9, True)}


def small_records(spark, folder):
    docs = [(k, f"Title {k}\nthe body, with und words {k % 7} " + "tion " * (k % 5), "en" if k % 2 else "de", "s", 40 + 13 * k) for k in range(1, 61)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(k, int(k % 3 == 0), 0) for k in range(1, 61) if k % 4]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_scores_are_read_from_stored_features(spark, tmp_path):
    from riskloom.catalog import fixtures

    small_records(spark, tmp_path)
    scored, _ = fixtures.linear_scores(spark, str(tmp_path), "p", labelled=True)
    assert scored.count() == 60
    # The texts are read once, when the features are made.
    assert not [f for f in scored.inputFiles() if "documents.parquet" in f]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from riskloom.sources import records

    for k in range(400):
        (tmp_path / f"{k}.txt").write_text(f"Title {k}\nbody")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = records.text_scan(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r.title for r in found.collect()) == sorted(f"Title {k}" for k in range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_arriving_files_are_as_many_as_the_splits(spark, tmp_path, monkeypatch):
    from riskloom.catalog import modelling

    small_records(spark, tmp_path)
    seen, run = [], modelling.run_stream

    def watched(session, source, *rest):
        seen.append(len(session.read.parquet(source).inputFiles()))
        return run(session, source, *rest)

    monkeypatch.setattr(modelling, "run_stream", watched)
    found = modelling.QUERIES["stream_score"](spark, str(tmp_path))
    assert found.count() == 15 and seen[0] > 4


def test_bundles_are_written_compressed(spark, tmp_path, monkeypatch):
    from riskloom.catalog import files

    small_records(spark, tmp_path)
    seen, scan = [], files.records.bundle_scan

    def watched(session, path, **options):
        seen.extend(session.read.text(path).inputFiles())
        return scan(session, path, **options)

    monkeypatch.setattr(files.records, "bundle_scan", watched)
    assert files.QUERIES["bundle_scan"](spark, str(tmp_path)).count() == 60
    assert seen and all(f.endswith(".json.gz") for f in seen)


def test_epochs_send_only_given_entries(spark):
    from pyspark.ml.linalg import Vectors
    from riskloom.operators import epochs
    from riskloom.session import shared_folder

    rows = [(k, float(k % 2), Vectors.sparse(1000, {k % 3: 1.0, 500 + k % 2: 2.0})) for k in range(40)]
    train = spark.createDataFrame(rows, ["id", "label", "v"])
    folder = shared_folder(spark)
    states = epochs.train_epochs(train, train, "id", "v", folder, epochs.EpochSettings(epochs=2, steps=2))
    stored = spark.read.parquet(f"{folder}/rows")
    assert stored.selectExpr("max(size(x))").first()[0] == 2 and stored.selectExpr("min(width)").first()[0] == 1000
    assert states.count() == 2 and all(len(r["weights"]) == 1001 for r in states.collect())


def test_text_files_are_read_some_folders_at_a_time(spark, tmp_path, monkeypatch):
    from riskloom.catalog import files

    texts = [None, "", " \n", "a\n b ", "Twice\nplacebo", "Twice\nplacebo", *(f"Title {k}\nbody {k}" for k in range(90))]
    docs = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    asked, written, scan, write = [], [], files.records.text_scan, files.records.write_texts

    def watched_scan(session, paths):
        asked.append(paths)
        return scan(session, paths)

    def watched_write(rows, path):
        written.extend(write(rows, path, 4))
        return written

    monkeypatch.setattr(files, "FOLDERS", 5)
    monkeypatch.setattr(files.records, "text_scan", watched_scan)
    monkeypatch.setattr(files.records, "write_texts", watched_write)
    found = sorted(tuple(r) for r in files.QUERIES["text_scan"](spark, str(tmp_path)).collect())
    shown = [t or "" for t in texts]
    assert found == sorted((t.strip().split("\n")[0], hashlib.md5(t.encode()).hexdigest(), len(t)) for t in shown)
    # Each folder is read once, and no pass is handed more than five of them.
    assert [f for paths in asked for f in paths] == written and max(map(len, asked)) == 5 < len(written)
    made = [f for folder in written for f in os.listdir(folder.removeprefix("file:"))]
    assert len(made) == len(texts) and not [f for f in made if f.endswith(".crc")]


def test_no_text_is_no_file(spark, tmp_path):
    from riskloom.catalog import files

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = files.QUERIES["text_scan"](spark, str(tmp_path))
    assert found.count() == 0 and found.columns == ["title", "text_md5", "n_chars"]


def test_text_files_in_a_store_that_only_spark_reaches(spark, tmp_path):
    from riskloom.sources import records

    spark.conf.set("fs.viewfs.mounttable.texts.link./in", f"file://{tmp_path}")
    rows = spark.createDataFrame([(f"Title {k}\nbody",) for k in range(23)] + [(None,)], "text string").repartition(3)
    folders = records.write_texts(rows, "viewfs://texts/in/files", 5)
    assert len(folders) >= 5 and all(f.startswith("viewfs:") for f in folders)
    found = records.text_scan(spark, folders).select("title", "text").collect()
    assert sorted(map(tuple, found)) == sorted([(f"Title {k}", f"Title {k}\nbody\n") for k in range(23)] + [("", "\n")])


def test_text_files_are_not_written_into_a_folder_that_is_there(spark, tmp_path):
    from riskloom.sources import records

    with pytest.raises(FileExistsError):
        records.write_texts(spark.createDataFrame([("a",)], "text string"), str(tmp_path))


def test_compressed_text_files_among_others(spark, tmp_path):
    from riskloom.sources import records

    (tmp_path / "a.txt").write_text("Plain\nplacebo")
    (tmp_path / "b%20 c.txt").write_bytes(b"\xff\n")
    for name in ("c.txt.gz", "d.GZ"):
        (tmp_path / name).write_bytes(gzip.compress(f"Packed {name}\nmulticenter".encode()))
    found = {r.path.rpartition("/")[2]: r for r in records.text_scan(spark, str(tmp_path)).selectExpr("*", "hex(text) as bytes").collect()}
    assert sorted(found) == ["a.txt", "b%2520%20c.txt", "c.txt.gz", "d.GZ"]
    assert found["b%2520%20c.txt"].bytes == "FF0A"
    assert found["c.txt.gz"].title == "Packed c.txt.gz" and found["d.GZ"].multicenter and found["a.txt"].has_placebo


def test_first_lines(spark):
    from riskloom.sources import records

    bodies = ["", " \t", "\n\n", "one", " one \n", "one \ntwo", "\n one\t\r\n\n \x1c ", " one\x85\n\n\n two \n", "x" * 200, "x" * 149 + "  \n y", "a" + " " * 3000 + "\n" + "\n" * 3000, "a\n \U0001f600"]
    rows = spark.createDataFrame([*((b,) for b in bodies), (None,)], "body string")
    found = {r.body: r.title for r in rows.select("body", records.first_line(F.col("body")).alias("title")).collect()}
    assert found == {None: None, **{b: b.strip().split("\n")[0][:150] for b in bodies}}
