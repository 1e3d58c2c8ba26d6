"""Plans: what is shuffled, what reaches the scan."""

from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.catalog import QUERIES
from riskloom.catalog import fixtures as X
from riskloom.operators import explain, ranking, whatif
from riskloom.operators import features as features_
from riskloom.sources.tables import table, trials

FOLDER = "/root/testdata/sf0.001"
SCALER = {c: (0.0, 1.0) for c in C.SCALED_FEATURES}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def shuffles(rows):
    return sum("Exchange hashpartitioning" in s or "Exchange range" in s or "SinglePartition" in s for s in plan(rows).splitlines())


def made(spark):
    rows = trials(spark, FOLDER, labelled=False, texts=False)
    return features_.engineer_features(rows, X.medians(spark, FOLDER), X.SPEC)


def test_features_sections_and_grids_never_shuffle(spark):
    rows = made(spark)
    assert shuffles(rows) == 0
    scored = X.linear_score(rows, SCALER, "probability").withColumn("p_text", F.lit(None).cast("double"))
    contributions = explain.linear_contributions(X.COEFFICIENTS)
    assert shuffles(explain.with_sections(scored, contributions)) == 0
    grid = whatif.whatif_rescore(scored, X.SCENARIOS, lambda r: X.linear_score(r, SCALER, "p_struct"), 0.4)
    assert shuffles(grid) == 0 and "CartesianProduct" not in plan(grid) and "NestedLoop" not in plan(grid)


def test_split_is_applied_without_a_shuffle(spark):
    rows = table(spark, FOLDER, "orders").select("o_orderkey", "o_orderstatus")
    split = ranking.stratified_split(rows, "o_orderkey", "o_orderstatus")
    assert shuffles(split) == 0 and "Window" not in plan(split)


def test_term_vectors_never_shuffle(spark):
    rows = table(spark, FOLDER, "documents").select("doc_id", "text")
    terms = features_.document_terms(rows, "doc_id", "text")
    assert shuffles(features_.fit_tfidf(terms).transform(terms)) == 0


def test_term_statistics_make_no_row_per_occurrence(spark):
    rows = table(spark, FOLDER, "documents")
    text = plan(features_.doc_frequency(features_.document_terms(rows, "doc_id", "text")))
    assert "Generate" not in text and "explode" not in text
    assert "UDF(" not in text  # no list of pairs
    assert text.count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["parquet_scan"](spark, FOLDER))
    assert "EqualTo(l_returnflag,R)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_returnflag:string>" in text
    assert "text" not in plan(X.t(spark, FOLDER).select("trial_id", "enrollment_count")).split("ReadSchema")[1]


def test_top_k_is_limited_before_the_shuffle(spark):
    long = explain.contributions_long(made(spark), "trial_id", explain.linear_contributions(X.COEFFICIENTS))
    assert "WindowGroupLimit" in plan(ranking.topn_abs(long, "trial_id", "shap", "feature", 3))
    assert "TakeOrderedAndProject" in plan(QUERIES["sort_topk"](spark, FOLDER))


def test_labels_join_no_text(spark):
    node = QUERIES["engineer_features"](spark, FOLDER)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join" or "terminated" not in node.toString().splitlines()[-1] + str(node.right().output()):
        node = node.children().head()
    assert "trial_id" in str(node.left().output())
    assert not any(name in str(node.left().output()) for name in ("text#", "full_text", "official_title", "eligibility_criteria"))
