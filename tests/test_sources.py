"""Record files, artifacts and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.catalog import modelling
from riskloom.session import shared_folder
from riskloom.sources import artifacts, records
from riskloom.sources.tables import parquet_sink, parquet_scan


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows))
    return str(path)


def test_harvest_stops_between_pages(spark, tmp_path):
    pages = [
        {"term": t, "page": p, "studies": [{"id": t * 100 + p * 10 + i} for i in range(10)], "nextPageToken": "x"}
        for t in range(2) for p in range(5)
    ]
    path = lines(tmp_path / "pages.json", pages)
    count = lambda n: records.harvest_pages(spark, path, "struct<id: bigint>", n).count()
    assert [count(n) for n in (1, 10, 11, 65, 1000)] == [10, 10, 20, 70, 100]
    assert records.harvest_pages(spark, path, "struct<id: bigint>", key="id").count() == 100


def found(spark, rows, key="k"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    hit = records.find_key(F.col("v"), records.variant_shape(frame, "v"), key)
    return [r[0] for r in frame.orderBy("i").select(F.try_variant_get(hit, "$", "string")).collect()]


def test_key_search_order(spark):
    rows = [
        '{"k": 1, "a": {"k": 2}}',
        '{"a": {"b": {"k": 3}}, "z": {"k": 4}}',
        '{"a": {"k": null}, "z": {"k": 5}}',
        '{"a": [{"x": 1}, {"k": null}, {"y": {"k": 6}}, {"k": 7}]}',
        '{"a": [[{"k": 8}]], "b": 1}',
        '{"a": 1}',
        "not json",
        None,
    ]
    assert found(spark, rows) == ["1", "3", "5", "6", None, None, None, None]


def test_flatten_records(spark):
    full = {
        "one": {"nctId": "N1", "officialTitle": "Title"},
        "two": {"overallStatus": "Withdrawn", "briefSummary": "Short"},
        "three": {"eligibilityCriteria": {"text": "Adults"}, "enrollmentCount": {"count": 12}},
        "primaryOutcomes": [{"measure": "OS", "description": "12 months"}, {"measure": "PFS"}],
        "phases": ["PHASE2", "PHASE3"], "conditions": ["a", "b"], "hasExpandedAccess": True,
    }
    bare = {"nctId": "N2", "enrollmentCount": 7, "eligibilityCriteria": "Plain"}
    rows = spark.createDataFrame([(json.dumps(full),), (json.dumps(bare),)], "r string")
    one, two = records.flatten_records(rows, "r").orderBy("nct_id").collect()
    assert one.full_text == "Title\nShort\nAdults\nOS: 12 months | PFS: "
    assert (one.terminated, one.enrollment_count, one.phase_encoded, one.has_expanded_access, one.condition_count) == (1, 12, 2, True, 2)
    assert (two.full_text, two.enrollment_count, two.condition_count, two.eligibility_criteria) == ("Plain", 7, 0, "Plain")


def test_csv_uploads(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text(
        'title,Detailed Description,Brief Summary,Enrollment,Phases,placebo\n'
        'A,"line one\nline ""two""",short,"1,234",PHASE3,true\n'
        ',multi-center study,nan,lots,,\n'
    )
    rows = records.csv_records(records.read_csv(spark, str(path), line_breaks=True)).orderBy("enrollment").collect()
    second, first = rows
    assert first.text == '--- DETAILED DESCRIPTION ---\nline one\nline "two"\n\n--- BRIEF SUMMARY ---\nshort'
    assert (first.title, first.enrollment, first.phase, first.multicenter, first.has_placebo) == ("A", 1234, "Phase 3", False, True)
    assert (second.enrollment, second.phase, second.multicenter, second.has_placebo) == (100, "Phase 2", True, False)
    assert second.title == "--- DETAILED DESCRIPTION ---" and "BRIEF SUMMARY" not in second.text


def test_csv_without_text_columns(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("x,title\n1,T\n")
    row = records.csv_records(records.read_csv(spark, str(path), line_breaks=True)).first()
    assert json.loads(row.text) == {"x": "1", "title": "T"} and row.title == "T"


def test_bundles(spark, tmp_path):
    study = {"resourceType": "ResearchStudy", "id": "s", "title": "S", "objective": "Goal", "enrollment": [{"actual": 9}], "phase": "phase-4"}
    documents = [
        {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Group", "id": "g"}}, {"resource": study}]},
        {"resourceType": "ResearchStudy", "id": "t", "description": "First line\nmore placebo", "enrollment_count": 55},
        {"resourceType": "ResearchStudy", "id": "u", "description": "x", "enrollment": [{"other": 1}], "enrollment_count": 55},
    ]
    rows = {r["id"]: r for r in records.bundle_scan(spark, lines(tmp_path / "b.json", documents), False).collect()}
    assert (rows["s"].text, rows["s"].enrollment, rows["s"].phase) == ("Goal", 9, "Phase 4")
    assert (rows["t"].title, rows["t"].enrollment, rows["t"].phase, rows["t"].has_placebo) == ("First line", 55, "Phase 2", True)
    assert rows["u"].enrollment == 100


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n Title here\nbody multicenter")
    row = records.text_scan(spark, str(tmp_path)).first()
    assert (row.title, row.multicenter, row.has_placebo) == ("Title here", True, False)


def test_missing_artifact_is_empty(spark):
    assert artifacts.json_artifact_scan(spark, shared_folder(spark), "a int").count() == 0


def test_keyed_cache_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"N1": {"v": 1},\n "N2": {"v": 2}}')
    rows = artifacts.keyed_cache_scan(spark, str(tmp_path), "v int").collect()
    assert sorted(map(tuple, rows)) == [("N1", 1), ("N2", 2)]


def test_partitioned_sink_prunes(spark):
    folder = shared_folder(spark)
    parquet_sink(spark.range(10).withColumn("side", F.when(F.col("id") < 3, "test").otherwise("train")), folder, ["side"])
    rows = parquet_scan(spark, folder).filter("side = 'test'")
    assert rows.count() == 3
    assert "PartitionFilters: [isnotnull(side" in rows._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_needs_a_setting_on_clusters(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_stream_equals_batch(spark):
    from riskloom.catalog import fixtures as X
    from riskloom.functions import scoring

    folder = "/root/testdata/sf0.001"
    streamed = modelling.stream_score(spark, folder)
    batch = X.linear_scores(spark, folder, "p")[0].select(
        "trial_id", "p", scoring.risk_tier(F.col("p"), X.THRESHOLD).alias("tier")
    )
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("trial_id"))
    want = batch.join(labels, "trial_id", "left_anti")
    assert streamed.exceptAll(want).count() == 0 and want.exceptAll(streamed).count() == 0


def test_key_search_with_odd_names(spark):
    rows = [
        """{"it's": {"k": 1}}""",
        """{"OBJECT<a": {"k": 2}}""",
        """{"what?": [{"k": 3}]}""",
        """{"it's": {"what?": {"k": 4}}, "b": 1}""",
    ]
    assert found(spark, rows) == ["1", "2", "3", "4"]
    assert found(spark, ["""{"a": {"it's": 5}}""", """{"it's": 6}"""], "it's") == ["5", "6"]


def test_harvest_keeps_the_first_copy(spark, tmp_path):
    page = lambda t, p, v: {"term": t, "page": p, "studies": [{"id": 1, "v": v}, {"id": 1, "v": v + 1}], "nextPageToken": "x"}
    path = lines(tmp_path / "copies.json", [page(1, 0, 30), page(0, 1, 20), page(0, 0, 10)])
    rows = records.harvest_pages(spark, path, "struct<id: bigint, v: bigint>", key="id")
    assert [tuple(r) for r in rows.collect()] == [(1, 10)]


def test_a_key_that_arrives_again_is_stored_once(spark, tmp_path):
    from riskloom.streaming.scoring import stream_score

    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = lambda *ids: spark.createDataFrame([(i, float(i)) for i in ids], "trial_id long, x double")
    score = lambda arriving: arriving.withColumn("p", F.col("x") / 10)
    for ids in ((1, 2, 2), (2, 3), (1, 4)):
        rows(*ids).coalesce(1).write.mode("append").parquet(source)
        stream_score(spark, source, rows(1).schema, score, target, checkpoint, rows(4), files_per_batch=1)
    assert sorted(r["trial_id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    path = tmp_path / "numbers.csv"
    path.write_text("a,b\n" + "".join(f"{i},{i / 2}\n" for i in range(20_000)))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "20000")
    try:
        table = records.read_csv(spark, str(path), "a int, b double")
        assert table.rdd.getNumPartitions() > 5
        assert table.agg(F.count(F.lit(1)), F.sum("a")).first() == (20_000, sum(range(20_000)))
        assert records.read_csv(spark, str(path), "a int, b double", True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set(size, before)


def test_the_cache_keeps_what_was_generated(spark, tmp_path):
    from riskloom.operators.joins import cached_or_generated

    path, asked = str(tmp_path / "cache"), []

    def generate(missed):
        asked.append(missed.count())
        return missed.select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("reply"))

    rows = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    look = lambda table: cached_or_generated(table, path, "id long, reply string", "id", generate)
    answers = lambda table: sorted((r["id"], r["reply"], r["cached"]) for r in look(table).collect())
    assert answers(rows) == [(1, "text 1", False), (2, "text 2", False)]
    assert answers(rows) == [(1, "text 1", True), (2, "text 2", True)]
    more = rows.unionByName(spark.createDataFrame([(3,)], "id long"))
    assert answers(more) == [(1, "text 1", True), (2, "text 2", True), (3, "text 3", False)]
    assert asked == [2, 0, 1]
    assert artifacts.json_artifact_scan(spark, path, "id long, reply string").count() == 3


def test_records_without_a_key_are_all_stored(spark, tmp_path):
    from riskloom.streaming.scoring import stream_score

    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "trial_id long, x double")
    for pairs in (((None, 1.0), (None, 1.0), (1, 2.0)), ((None, 3.0), (1, 2.0))):
        rows(*pairs).coalesce(1).write.mode("append").parquet(source)
        stream_score(spark, source, rows((1, 1.0)).schema, lambda r: r, target, checkpoint, rows((4, 1.0)), files_per_batch=1)
    stored = spark.read.parquet(target)
    assert stored.columns == ["trial_id", "x"]
    assert sorted((r["trial_id"] or 0, r["x"]) for r in stored.collect()) == [(0, 1.0), (0, 1.0), (0, 3.0), (1, 2.0)]


def test_state_of_the_stream_levels_off(spark, tmp_path):
    from riskloom.streaming.scoring import stream_score

    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = "trial_id long, at timestamp"
    sizes = []
    for hour in range(8):
        rows = spark.range(20).select((F.lit(100 * hour) + F.col("id")).alias("trial_id"), F.expr(f"timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, {hour})").alias("at"))
        again = rows.limit(5).unionByName(rows.limit(3).withColumn("trial_id", F.lit(None).cast("long")))
        rows.unionByName(again).coalesce(1).write.mode("append").parquet(source)
        query = stream_score(spark, source, spark.createDataFrame([], schema).schema, lambda r: r, target, checkpoint, files_per_batch=1, time="at", bound="2 hours")
        sizes.append(sum(s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]))
    stored = spark.read.parquet(target)
    assert stored.filter("trial_id is not null").count() == stored.select("trial_id").distinct().count() - 1 == 160
    assert stored.filter("trial_id is null").count() == 24
    assert max(sizes) <= 80 and sizes[-1] <= sizes[3]
    stream_score(spark, source, stored.schema, lambda r: r, target, checkpoint, files_per_batch=1, time="at", bound="2 hours")
    assert spark.read.parquet(target).count() == 184
