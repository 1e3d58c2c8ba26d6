"""Queries of joins, aggregates, ranks, set operations and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.catalog import fixtures as X
from riskloom.catalog.fixtures import FEAT, SCALER, SCORED, SPLIT, T, r, rounded, t
from riskloom.catalog.registry import registry
from riskloom.catalog.scalars import SCENARIO_SQL
from riskloom.operators import aggregates, curves, gates, joins, ranking
from riskloom.operators.explain import contributions_long, linear_contributions
from riskloom.operators.features import doc_frequency, document_terms, vocab_topk
from riskloom.sources.tables import documents, table, trials

QUERIES, ORACLES, query = registry()

# --- demo sample, used by several joins ------------------------------------

STRATA_SQL = """case when terminated = 1 and phase_encoded in (2, 3) and enrollment_count < 100 then 'high'
  when terminated = 1 and phase_encoded = 3 and enrollment_count between 100 and 500 then 'medium'
  when terminated = 0 and phase_encoded = 3 and enrollment_count > 500 then 'low' end"""

SAMPLE_SQL = f"""{T},
h as (select *, md5(trial_id || ':42') as hash, {STRATA_SQL} as s from t),
k as (select *, row_number() over (partition by s order by hash, trial_id) as rn, count(*) over (partition by s) as n from h where s is not null),
chosen as (select trial_id, s as stratum, hash from k where rn <= 5 and n >= 5),
wild as (select trial_id, 'wildcard' as stratum, hash from h where trial_id not in (select trial_id from chosen)
  order by hash, trial_id limit (select 20 - count(*) from chosen)),
sample as (select * from chosen union all select * from wild)"""


def strata():
    label, phase, size = F.col("terminated"), F.col("phase_encoded"), F.col("enrollment_count")
    return {
        "high": (label == 1) & phase.isin(2, 3) & (size < 100),
        "medium": (label == 1) & (phase == 3) & size.between(100, 500),
        "low": (label == 0) & (phase == 3) & (size > 500),
    }


def sample(spark, sf):
    rows = trials(spark, sf).select("trial_id", "terminated", "phase_encoded", "enrollment_count")
    return ranking.sample_per_stratum(rows, "trial_id", strata())


@query(f"with {SAMPLE_SQL} select trial_id, stratum from sample")
def sample_per_stratum(spark, sf):
    return sample(spark, sf).select("trial_id", "stratum")


@query(f"with {SAMPLE_SQL} select stratum, count(*) as n from sample group by 1")
def union_strata(spark, sf):
    rows = trials(spark, sf).select("trial_id", "terminated", "phase_encoded", "enrollment_count")
    chosen = ranking.sample_per_stratum(rows, "trial_id", strata())
    parts = [chosen.filter("stratum <> 'wildcard'"), chosen.filter("stratum = 'wildcard'")]
    return ranking.union_strata(parts).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SAMPLE_SQL} select trial_id, enrollment_count from t where trial_id not in (select trial_id from sample)")
def exclude_selected(spark, sf):
    rows = t(spark, sf).select("trial_id", "enrollment_count")
    return joins.exclude_selected(rows, sample(spark, sf), "trial_id")


@query(f"with {SAMPLE_SQL} select trial_id from t except all select trial_id from sample")
def except_selected(spark, sf):
    return ranking.except_selected(t(spark, sf), sample(spark, sf), "trial_id")


# --- joins -----------------------------------------------------------------


@query("""
select d.doc_id as trial_id, coalesce(l.quality, (d.n_chars % 2)::INTEGER) as quality,
  coalesce(l.toxic, 0) as toxic, l.doc_id is not null as cached from documents d left join labels l using (doc_id)""")
def cache_lookup(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("trial_id"), "n_chars")
    cache = table(spark, sf, "labels").withColumnRenamed("doc_id", "trial_id")
    make = lambda missed: missed.select(
        "trial_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")
    )
    return joins.cache_lookup(docs, cache, "trial_id", make)


@query("""
select vec_id as trial_id, unnest(range(66))::INTEGER as place,
  unnest(list_concat(embedding, [(d.n_chars % 1500)::FLOAT, (d.doc_id % 5)::FLOAT])) as value
from embeddings v join documents d on v.vec_id = d.doc_id""")
def combine_features(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial_id"), "embedding")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("trial_id"),
        (F.col("n_chars") % 1500).alias("size"),
        (F.col("doc_id") % 5).alias("phase"),
    )
    combined = joins.combine_features(vectors, "embedding", docs, ["size", "phase"], "trial_id")
    return combined.select("trial_id", F.posexplode("combined").alias("place", "value"))


@query(f"""with {T}, m as (select phase_encoded, median(enrollment_count) as m from t where enrollment_count > 0 group by 1)
select trial_id, coalesce(m, 150.0)::DOUBLE as median_value from t left join m using (phase_encoded)""")
def dimension_default_lookup(spark, sf):
    rows = t(spark, sf).select("trial_id", "phase_encoded", "enrollment_count")
    known = aggregates.median_by_group(rows, "phase_encoded", "enrollment_count")
    looked = joins.dimension_default_lookup(rows, known, "phase_encoded", "median_value", 150.0)
    return looked.select("trial_id", "median_value")


@query("""
with m as (select event_type, user_id, max(value) as value from events group by all),
j as (select user_id, a.value as base_value, b.value as other_value from m a join m b using (user_id)
  where a.event_type = 'view' and b.event_type = 'click')
select *, case when base_value > 0 and other_value > 0 then other_value / base_value else 0.0::DOUBLE end as speedup from j""")
def measure_pairing(spark, sf):
    return joins.measure_pairing(table(spark, sf, "events"), "event_type", "view", "click", ["user_id"], "value")


def contribution_rows(spark, sf):
    """(trial_id, feature, shap) of the fixed linear scorer on unscaled features."""
    contributions = linear_contributions(X.COEFFICIENTS)
    rows = X.features(spark, sf, labelled=False)
    return contributions_long(rows, "trial_id", contributions)


CONTRIB_SQL = FEAT + ",\nlong as (" + " union all ".join(
    f"select trial_id, '{c}' as feature, {w}::DOUBLE * {c}::DOUBLE as shap from feat" for c, w in X.COEFFICIENTS.items()
) + ")"

GLOBS = {"Presence": ["has_*", "is_?nterventional"], "Criteria": ["criteria_length", "criteria_*"], "Size": ["*enroll*"]}


@query(f"""with {CONTRIB_SQL}, s as (select *, case when feature = 'criteria_length' then 'Criteria'
  when feature like 'has\\_%' escape '\\' or feature = 'is_interventional' then 'Presence'
  when feature like 'criteria\\_%' escape '\\' then 'Criteria' when feature like '%enroll%' then 'Size' end as section from long)
select section, feature, count(*) as n, {r('sum(shap)', 2)} as total from s group by all""")
def pattern_map_join(spark, sf):
    mapped = joins.pattern_map_join(contribution_rows(spark, sf), "feature", GLOBS)
    return mapped.groupBy("section", "feature").agg(
        F.count(F.lit(1)).alias("n"), X.numbers.half_up(F.sum("shap"), 2).alias("total")
    )


_ASSIGNED = ", ".join(f"'{f}'" for names in C.SECTION_FEATURES.values() for f in names)


@query(f"with {CONTRIB_SQL} select trial_id, feature, {r('shap', 6)} as shap from long where feature not in ({_ASSIGNED})")
def unassigned_rest(spark, sf):
    return rounded(joins.unassigned_rest(contribution_rows(spark, sf), "feature"), 6, "shap")


_LABEL_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in C.FEATURE_LABELS.items())


@query(f"""with {CONTRIB_SQL} select case feature {_LABEL_CASE} else feature end as label, count(*) as n,
  {r('max(shap)', 6)} as largest from long group by 1""")
def label_lookup(spark, sf):
    named = joins.label_lookup(contribution_rows(spark, sf), "feature", C.FEATURE_LABELS)
    return named.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), X.numbers.half_up(F.max("shap"), 6).alias("largest")
    )


@query(f"""with {T} select trial_id, l.doc_id is not null as labelled from t left join labels l on trial_id = l.doc_id""")
def split_membership(spark, sf):
    members = table(spark, sf, "labels").select(F.col("doc_id").alias("trial_id"))
    return joins.split_membership(t(spark, sf).select("trial_id"), members, "trial_id", "labelled")


@query(f"""with {T}, {SCENARIO_SQL}
select trial_id, enrollment_count, scenario_id::INTEGER as scenario_id, enrollment::INTEGER as scenario_enrollment, phase as scenario_phase,
  multicenter as scenario_multicenter, has_placebo as scenario_has_placebo from t, scenarios""")
def scenario_cross(spark, sf):
    return joins.scenario_cross(t(spark, sf).select("trial_id", "enrollment_count"), X.SCENARIOS)


# --- aggregates ------------------------------------------------------------


@query(f"with {T} select phase_encoded, median(enrollment_count)::DOUBLE as median_value from t where enrollment_count > 0 group by 1")
def median_by_group(spark, sf):
    return aggregates.median_by_group(t(spark, sf), "phase_encoded", "enrollment_count")


@query(f"with {FEAT} select trial_id, size from sized")
def impute_group_median(spark, sf):
    rows = t(spark, sf).select("trial_id", "phase_encoded", "enrollment_count")
    known = X.medians(spark, sf)
    filled = aggregates.impute_group_median(rows, known, "phase_encoded", "enrollment_count", "size")
    return filled.select("trial_id", "size")


@query("""
select o_orderpriority, avg((o_orderstatus = 'F')::INTEGER::DOUBLE) as rate, count(*) as n from orders
group by 1 order by rate desc, 1 limit 10""")
def rate_by_group(spark, sf):
    flag = (F.col("o_orderstatus") == "F").cast("int")
    return aggregates.rate_by_group(table(spark, sf, "orders"), "o_orderpriority", flag, 10)


@query("select event_type, count(*) as n from events group by 1 order by n desc, 1 limit 20")
def value_counts(spark, sf):
    return aggregates.value_counts(table(spark, sf, "events"), "event_type")


@query("""
select count(*) as total, avg(f) * 100.0::DOUBLE as positive_pct, avg(1 - f) * 100.0::DOUBLE as negative_pct,
  least(avg(f), avg(1 - f)) * 100.0 < 20.0 as imbalanced from (select (o_orderstatus = 'F')::INTEGER::DOUBLE as f from orders)""")
def class_balance(spark, sf):
    label = (F.col("o_orderstatus") == "F").cast("int")
    return aggregates.class_balance(table(spark, sf, "orders"), label)


PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]
_SPARK_TYPES = {"l_linenumber": "int", "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint"}


@query(" union all ".join(
    f"select {i}::INTEGER as ordinal, '{c}' as \"column\", '{_SPARK_TYPES.get(c, 'double')}' as dtype, "
    f"min({c})::DOUBLE as min_value, max({c})::DOUBLE as max_value from lineitem"
    for i, c in enumerate(PROFILE)))
def column_profile(spark, sf):
    return aggregates.column_profile(table(spark, sf, "lineitem"), PROFILE)


@query("with c as (" + " union all ".join(
    f"select '{c}' as \"column\", {r(f'abs(corr({c}, l_quantity))', 9)} as abs_corr from lineitem"
    for c in PROFILE[1:]) + ") select * from c order by abs_corr desc nulls last, \"column\" limit 5")
def target_correlation(spark, sf):
    found = aggregates.target_correlation(table(spark, sf, "lineitem"), "l_quantity", PROFILE[1:])
    return rounded(found, 9, "abs_corr")


@query(f"""with {FEAT}, c as (select trial_id, case when terminated = 1 then 1 else 0 end as y, * exclude (trial_id, terminated) from feat where terminated is not null)
select "column", abs_corr from (""" + " union all ".join(
    f"select '{c}' as \"column\", {r(f'abs(corr({c}, y))', 7)} as abs_corr from c" for c in C.FEATURES
) + ") order by abs_corr desc nulls last, \"column\" limit 5")
def feature_correlation(spark, sf):
    rows = X.features(spark, sf).filter("terminated is not null")
    return rounded(aggregates.target_correlation(rows, "terminated", C.FEATURES), 7, "abs_corr")


@query(f"""with {T} select sum(terminated)::BIGINT as n_pos, (count(terminated) - sum(terminated))::BIGINT as n_neg,
  (count(terminated) - sum(terminated))::DOUBLE / greatest(sum(terminated), 1)::DOUBLE as scale_pos_weight,
  avg(terminated::DOUBLE) as weight_class_0, 1.0::DOUBLE - avg(terminated::DOUBLE) as weight_class_1 from t""")
def class_weights(spark, sf):
    return aggregates.class_weights(trials(spark, sf).select("terminated"), "terminated")


@query(f"with {SCALER} " + " union all ".join(
    f"select {i}::INTEGER as ordinal, '{c}' as \"column\", {r(f'mean_{c}', 7)} as mean, {r(f'std_{c}', 7)} as std from scaler"
    for i, c in enumerate(C.SCALED_FEATURES)))
def standard_scaler_fit(spark, sf):
    train = X.split_features(spark, sf).filter("split = 'train'")
    return rounded(aggregates.standard_scaler_fit(train), 7, "mean", "std")


ORDER_SCORE = "(o_totalprice / 500000.0::DOUBLE)"
ORDER_LABEL = "(o_orderstatus = 'F')::INTEGER"


def order_scores(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / F.lit(500000.0)).alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


CONFUSION = """count(*) filter (where not said and y = 0) as tn, count(*) filter (where said and y = 0) as fp,
  count(*) filter (where not said and y = 1) as fn, count(*) filter (where said and y = 1) as tp"""
METRICS = """case when tp + fp > 0 then tp::DOUBLE / (tp + fp) else 0.0::DOUBLE end as "precision",
  case when tp + fn > 0 then tp::DOUBLE / (tp + fn) else 0.0::DOUBLE end as recall,
  (case when 2 * tp + fp + fn > 0 then (2 * tp)::DOUBLE / (2 * tp + fp + fn) else 0.0::DOUBLE end
   + case when 2 * tn + fp + fn > 0 then (2 * tn)::DOUBLE / (2 * tn + fp + fn) else 0.0::DOUBLE end) / 2.0::DOUBLE as f1_macro"""


@query(f"""with s as (select {ORDER_SCORE} >= 0.5::DOUBLE as said, {ORDER_LABEL} as y from orders),
c as (select {CONFUSION} from s) select *, {METRICS} from c""")
def confusion_metrics(spark, sf):
    return curves.confusion_metrics(order_scores(spark, sf), "score", "label", 0.5)


AUROC_SQL = """cells as (select score, sum(y)::DOUBLE as pos, sum(1 - y)::DOUBLE as neg from s group by 1),
run as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from cells),
area as (select sum(pos)::BIGINT as n_pos, sum(neg)::BIGINT as n_neg,
  sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auroc from run)"""


@query(f"""with s as (select {ORDER_SCORE} as score, {ORDER_LABEL} as y from orders), {AUROC_SQL}
select n_pos, n_neg, {r('auroc', 9)} as auroc from area""")
def auroc(spark, sf):
    return rounded(curves.auroc(order_scores(spark, sf), "score", "label"), 9, "auroc")


@query(f"""with {SCORED}, s as (select p as score, terminated as y from scored where terminated is not null), {AUROC_SQL}
select n_pos, n_neg, {r('auroc', 9)} as auroc from area""")
def auroc_of_records(spark, sf):
    scored = X.linear_scores(spark, sf, "p", labelled=True)[0].filter("terminated is not null")
    return rounded(curves.auroc(scored, "p", "terminated"), 9, "auroc")


CURVE_SQL = """cells as (select score, sum(y)::DOUBLE as pos, sum(1 - y)::DOUBLE as neg from s group by 1),
run as (select score as threshold, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
  sum(pos) over () as p from cells),
curve as (select threshold, tp / (tp + fp) as "precision", case when p > 0 then tp / p else 0.0::DOUBLE end as recall,
  2 * tp / (tp + fp + p) as f1 from run)"""


@query(f"""with s as (select {ORDER_SCORE} as score, {ORDER_LABEL} as y from orders), {CURVE_SQL} select * from curve""")
def pr_curve(spark, sf):
    return curves.pr_curve(order_scores(spark, sf), "score", "label")


@query(f"""with s as (select {ORDER_SCORE} as score, {ORDER_LABEL} as y from orders), {CURVE_SQL}
select threshold, f1 from curve order by f1 desc, threshold limit 1""")
def best_f1_threshold(spark, sf):
    return curves.best_f1_threshold(order_scores(spark, sf), "score", "label")


@query(f"""with s as (select {ORDER_SCORE} as score, {ORDER_LABEL} as y from orders), {CURVE_SQL},
best as (select threshold from curve order by f1 desc, threshold limit 1),
cuts as (select 'default' as setting, 0.5::DOUBLE as threshold union all select 'tuned', threshold from best),
c as (select setting, threshold, {CONFUSION}, count(*) as n, avg(y::DOUBLE) as positive_rate
  from (select cuts.*, y, score >= threshold as said from s, cuts) group by setting, threshold),
cells2 as (select score, sum(y)::DOUBLE as pos, sum(1 - y)::DOUBLE as neg from s group by 1),
run2 as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from cells2),
area as (select sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auroc from run2)
select setting, threshold, tn, fp, fn, tp, {METRICS}, {r('auroc', 9)} as auroc, n, positive_rate from c, area""")
def evaluate_report(spark, sf):
    return rounded(curves.evaluate_report(order_scores(spark, sf), "score", "label"), 9, "auroc")


@query(f"""select event_type, count(*) as n, {r('avg(value)', 6)} as avg_ms, {r('median(value)', 6)} as p50_ms,
  {r('quantile_cont(value, 0.95)', 6)} as p95_ms, {r('sum(value) / 1000', 4)} as total_seconds,
  {r('count(*) / (sum(value) / 1000)', 6)} as per_second from events group by 1""")
def latency_summary(spark, sf):
    rows = aggregates.latency_summary(table(spark, sf, "events"), "value", ["event_type"])
    return rounded(rounded(rows, 6, "avg_ms", "p50_ms", "p95_ms", "per_second"), 4, "total_seconds")


@query(f"""with m as (select event_type as device, 1.0::DOUBLE + event_id % 4 as n, value / 1000 as seconds from events),
b as (select coalesce(max(case when seconds > 0 then n / seconds else 0 end) filter (where device = 'view'), 0) as base_best_rate,
  sum(seconds) filter (where device = 'view') as base_seconds, sum(n) filter (where device = 'view') as base_n,
  coalesce(max(case when seconds > 0 then n / seconds else 0 end) filter (where device = 'click'), 0) as other_best_rate,
  sum(seconds) filter (where device = 'click') as other_seconds, sum(n) filter (where device = 'click') as other_n from m)
select {r('base_best_rate', 4)} as base_best_rate, {r('base_seconds', 6)} as base_seconds, {r('other_best_rate', 4)} as other_best_rate,
  {r('other_seconds', 6)} as other_seconds, {r('base_seconds * 1000 / base_n', 6)} as base_ms_per_record,
  {r('other_seconds * 1000 / other_n', 6)} as other_ms_per_record, {r('base_seconds / other_seconds', 9)} as speedup from b""")
def throughput_summary(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("device"),
        (F.lit(1.0) + F.col("event_id") % 4).alias("n"),
        (F.col("value") / 1000.0).alias("seconds"),
    )
    row = aggregates.throughput_summary(runs, "device", "n", "seconds", "view", "click")
    row = rounded(row, 4, "base_best_rate", "other_best_rate")
    row = rounded(row, 9, "speedup")
    return rounded(row, 6, "base_seconds", "other_seconds", "base_ms_per_record", "other_ms_per_record")


TERMS_SQL = f"""terms as (select doc_id, regexp_extract_all(lower(text), '{X.TERM}') as w from documents),
grams as (select doc_id, unnest(w) as term from terms union all
  select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from terms),
freq as (select term, count(distinct doc_id) as df, count(*) as total from grams group by 1)"""


def all_frequencies(spark, sf):
    return doc_frequency(document_terms(documents(spark, sf), "doc_id", "text"))


@query(f"with {TERMS_SQL} select * from freq", "doc_frequency")
def all_terms(spark, sf):
    return all_frequencies(spark, sf)


@query(f"with {TERMS_SQL} select * from freq where df >= 5 order by total desc, term limit 500", "vocab_topk")
def vocab(spark, sf):
    return vocab_topk(all_frequencies(spark, sf))


# --- ranks, limits, set operations -----------------------------------------


@query("""
with o as (select *, md5(o_orderkey || ':42') as h from orders),
k as (select *, row_number() over (partition by o_orderstatus order by h, o_orderkey) as rn, count(*) over (partition by o_orderstatus) as n from o)
select o_orderkey, o_orderstatus, case when rn <= floor(n * 0.2 + 0.5) then 'test' else 'train' end as split from k""")
def stratified_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ranking.stratified_split(rows, "o_orderkey", "o_orderstatus")


@query(f"""with {CONTRIB_SQL}, k as (select *, row_number() over (partition by trial_id order by abs(shap) desc, feature) as rank from long)
select trial_id, feature, {r('shap', 6)} as shap, rank::INTEGER as rank from k where rank <= 10""")
def topn_abs(spark, sf):
    return rounded(ranking.topn_abs(contribution_rows(spark, sf), "trial_id", "shap", "feature", 10), 6, "shap")


@query("""
with b as (select event_id, event_type, value, coalesce(max(value) over (partition by event_type order by event_id
  rows between unbounded preceding and 1 preceding), 0.0::DOUBLE) as best_before from events)
select *, value > best_before as improved from b""")
def best_so_far(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return ranking.best_so_far(rows, "event_id", "value", ["event_type"])


@query("select conv_id, arg_min(text, turn) as text from conversations where role = 'assistant' group by 1")
def first_match(spark, sf):
    rows = table(spark, sf, "conversations")
    return ranking.first_match(rows, "conv_id", F.col("role") == "assistant", "turn", "text")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def sort_topk(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.sort_topk(rows, "o_totalprice", 10, "o_orderkey")


@query(f"with {T} select trial_id, official_title from t order by trial_id limit 20")
def head_limit(spark, sf):
    return ranking.head_limit(t(spark, sf).select("trial_id", "official_title"), "trial_id")


def users_of(spark, sf, kind):
    return table(spark, sf, "events").filter(F.col("event_type") == kind).select("user_id")


@query("select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error'")
def key_intersection(spark, sf):
    return ranking.key_intersection(users_of(spark, sf, "purchase"), users_of(spark, sf, "error"), "user_id")


@query("select user_id from events where event_type = 'purchase' union select user_id from events where event_type = 'error'")
def key_union(spark, sf):
    return ranking.key_union(users_of(spark, sf, "purchase"), users_of(spark, sf, "error"), "user_id")


# --- gates -----------------------------------------------------------------


@query("select 'min_rows' as rule, count(*)::DOUBLE as value, count(*) >= 2000 as ok from orders")
def min_rows_gate(spark, sf):
    return gates.min_rows_gate(table(spark, sf, "orders"))


@query(f"with {FEAT} " + " union all ".join(
    f"select 'no_missing:{c}' as rule, count(*) filter (where {c} is null)::DOUBLE as value, "
    f"count(*) filter (where {c} is null) = 0 as ok from feat" for c in [C.LABEL, *C.FEATURES]))
def null_gate(spark, sf):
    return gates.null_gate(X.features(spark, sf), [C.LABEL, *C.FEATURES])


@query(f"""with {SPLIT}, s as (select avg((split = 'train')::INTEGER::DOUBLE) as share,
  avg(terminated::DOUBLE) filter (where split = 'train') as train, avg(terminated::DOUBLE) filter (where split = 'test') as test from split)
select 'train_share' as rule, share as value, share between 0.75 and 0.85 as ok from s
union all select 'train_positive_rate', train, train >= 0.05 from s union all select 'test_positive_rate', test, test >= 0.05 from s""")
def split_gate(spark, sf):
    return gates.split_gate(X.split_features(spark, sf), "split", "terminated")


@query(" union all ".join(
    f"select 'numeric:{c}' as rule, count({c})::DOUBLE as value, {ok} as ok from lineitem"
    for c, ok in [("l_quantity", "true"), ("l_linenumber", "true"), ("l_returnflag", "false"), ("l_shipdate", "false")]))
def numeric_gate(spark, sf):
    columns = ["l_quantity", "l_linenumber", "l_returnflag", "l_shipdate"]
    return gates.numeric_gate(table(spark, sf, "lineitem"), columns)


@query("""
with k as (select coalesce(d.doc_id, v.vec_id) as id, d.doc_id as l, v.vec_id as r from documents d full join embeddings v on d.doc_id = v.vec_id),
c as (select count(*) filter (where r is null) as lo, count(*) filter (where l is null) as ro, count(l) - count(r) as diff from k)
select 'no_left_only_keys' as rule, lo::DOUBLE as value, lo = 0 as ok from c
union all select 'no_right_only_keys', ro::DOUBLE, ro = 0 from c union all select 'equal_rows', diff::DOUBLE, diff = 0 from c""")
def alignment_gate(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return gates.alignment_gate(docs, vectors, "id")
