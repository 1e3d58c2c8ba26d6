"""Queries of features, models, explanations, what-if grids and the stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.catalog import fixtures as X
from riskloom.catalog import given
from riskloom.catalog.fixtures import FEAT, SCALER, SCORED, T, r, rounded, sql_scaled, t
from riskloom.catalog.registry import registry
from riskloom.catalog.scalars import SCENARIO_SQL, SCORE, share_score
from riskloom.functions import scoring
from riskloom.operators import embed, epochs, explain, models, ranking, whatif
from riskloom.operators import features as features_
from riskloom.session import shared_folder
from riskloom.sources import artifacts
from riskloom.sources.tables import documents, table, trials
from riskloom.streaming.scoring import stream_score as run_stream

QUERIES, ORACLES, query = registry()

SETTINGS = models.GbtSettings()


@dataclass(frozen=True)
class Prepared:
    """Stored features of all records, gold features and the scaler of their train rows."""

    made: DataFrame
    rows: DataFrame
    scaler: features_.Scaler

    def matrix(self, split):
        scaled = features_.scale_features(self.rows.filter(F.col("split") == split), self.scaler)
        return features_.feature_matrix(scaled, columns=C.FEATURES)

    def scaled(self, spark, sf):
        """The feature vectors of all records, labelled or not."""
        rows = features_.scale_features(X.with_labels(spark, sf, self.made), self.scaler)
        return features_.feature_matrix(rows.drop("terminated"), columns=C.FEATURES)


def prepare(spark, sf):
    """Gold: labelled features with their split, stored in files of even size whatever the scan's splits."""
    folder = shared_folder(spark)
    made = X.stored_features(spark, sf)
    even = X.split_features(spark, sf, made=made).hint("rebalance", "split").sortWithinPartitions("split", "trial_id")
    even.write.partitionBy("split").parquet(folder)
    rows = spark.read.parquet(folder)
    return Prepared(made, rows, features_.fit_scaler(rows.filter("split = 'train'")))


def calibrated(prepared):
    """The calibrated model and its threshold: loaded if one was stored for these very rows and settings."""
    train = prepared.matrix("train")

    def fit():
        found = models.calibrate_isotonic(train, "trial_id", settings=SETTINGS)
        return found.model, models.tuned_threshold(found.held_out)

    return artifacts.stored_model(train.select("trial_id", "label", "features"), f"calibrated {SETTINGS}", fit)


# --- features --------------------------------------------------------------

@query(f"with {FEAT} select * replace ({r('log_enrollment', 9)} as log_enrollment) from feat")
def engineer_features(spark, sf):
    return rounded(X.features(spark, sf), 9, "log_enrollment")


@query(f"with {SCALER} select trial_id, terminated, " + ", ".join(
    f"{r(sql_scaled(c), 6)} as {c}" for c in C.FEATURES) + " from split, scaler")
def scale_features(spark, sf):
    rows = X.split_features(spark, sf)
    fitted = features_.fit_scaler(rows.filter("split = 'train'"))
    return rounded(features_.scale_features(rows, fitted), 6, *C.FEATURES)


@query(f"with {FEAT} select trial_id, terminated::DOUBLE as label, unnest(range(15))::INTEGER as place, "
       f"unnest([{', '.join(r(c, 6) for c in C.FEATURES)}]) as value from feat where terminated is not null")
def feature_matrix(spark, sf):
    rows = X.features(spark, sf).filter("terminated is not null")
    wide = features_.feature_matrix(rows, columns=C.FEATURES)
    long = wide.select("trial_id", "label", F.posexplode(vector_to_array("features")).alias("place", "value"))
    return rounded(long, 6, "value")


def term_vectors(spark, sf):
    """Vectors of all documents, with the vocabulary fitted on the train documents."""
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    placed = ranking.stratified_split(docs, "doc_id", "lang")
    train = features_.document_terms(placed.filter("split = 'train'"), "doc_id", "text")
    model = features_.fit_tfidf(train)
    terms = features_.document_terms(docs, "doc_id", "text")
    return model, model.transform(features_.vocabulary_terms(terms, features_.vocabulary_of(model)))


@query(f"""with o as (select doc_id, lang, text, row_number() over (partition by lang order by md5(doc_id || ':42'), doc_id) as rn,
    count(*) over (partition by lang) as n from documents),
d as (select doc_id, rn > floor(n * 0.2 + 0.5) as train, regexp_extract_all(lower(text), '{X.TERM}') as w from o),
grams as (select doc_id, train, unnest(w) as term from d union all
  select doc_id, train, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from d),
counts as (select doc_id, train, term, count(*) as tf from grams group by all),
freq as (select term, count(*) as df, sum(tf) as total from counts where train group by 1),
vocab as (select term, ln((1 + (select count(*) from d where train))::DOUBLE / (1 + df)) + 1 as idf
  from freq where df >= 5 order by total desc, term limit 500),
w as (select doc_id, term, tf * idf as w from counts join vocab using (term))
select doc_id, term, {r('w / sqrt(sum(w * w) over (partition by doc_id))', 6)} as tfidf from w""")
def tfidf(spark, sf):
    model, vectors = term_vectors(spark, sf)
    return rounded(features_.tfidf_long(vectors, features_.vocabulary_of(model), "doc_id"), 6, "tfidf")


# --- scores ----------------------------------------------------------------


@query(f"""with {T}, s as (select trial_id, {SCORE} as p from t)
select trial_id, {X.sql_tier('p', X.THRESHOLD)} as additive, {X.sql_tier('p', X.THRESHOLD, 'proportional')} as proportional,
  case {X.sql_tier('p', X.THRESHOLD)} when 'HIGH RISK' then '#E24B4A' when 'MEDIUM RISK' then '#EF9F27' else '#1D9E75' end as color from s""")
def risk_tier(spark, sf):
    rows = t(spark, sf).select("trial_id", share_score().alias("p"))
    additive = scoring.risk_tier(F.col("p"), X.THRESHOLD)
    return rows.select(
        "trial_id",
        additive.alias("additive"),
        scoring.risk_tier(F.col("p"), X.THRESHOLD, "proportional").alias("proportional"),
        scoring.tier_color(additive).alias("color"),
    )


TEXT_P = "((trial_id * 53) % 1000)::DOUBLE / 1000.0::DOUBLE"


def text_share():
    """A text probability for two records in three; the others have none."""
    known = (F.col("trial_id") * 53 % 1000).cast("double") / 1000.0
    return F.when(F.col("trial_id") % 3 != 0, known)


@query(f"""with {T} select trial_id, ({SCORE} + case when trial_id % 3 <> 0 then {TEXT_P} else {SCORE} end) / 2.0::DOUBLE as p from t""")
def ensemble_average(spark, sf):
    return t(spark, sf).select("trial_id", scoring.ensemble_average(share_score(), text_share()).alias("p"))


@query(f"""with {T}, q as (select trial_id, {SCORE} as p, enrollment_count::DOUBLE / {X.sql_expected('phase_encoded')} as ratio from t)
select trial_id, greatest(0.01::DOUBLE, least(p + {X.sql_shift('ratio')}, 0.99::DOUBLE)) as adjusted from q""")
def enrollment_adjust(spark, sf):
    return t(spark, sf).select(
        "trial_id",
        scoring.enrollment_adjust(share_score(), F.col("enrollment_count"), F.col("phase_encoded")).alias("adjusted"),
    )


_OVERRIDES = f"""trial_id, scenario_id::INTEGER as scenario_id, ln(1 + s.enrollment::DOUBLE) as log_enrollment,
  case s.phase when 'Phase 1' then 1.0 when 'Phase 2' then 2.0 when 'Phase 3' then 3.0 when 'Phase 4' then 4.0 end::DOUBLE as phase_encoded,
  s.multicenter::INTEGER as has_multicenter, s.has_placebo::INTEGER as has_placebo,
  s.enrollment::DOUBLE / {X.sql_expected("right(s.phase, 1)::DOUBLE")} as enrollment_ratio"""
_KEPT = ", ".join(
    c for c in C.FEATURES
    if c not in ("log_enrollment", "phase_encoded", "has_multicenter", "has_placebo", "enrollment_ratio")
)


@query(f"""with {SCORED}, {SCENARIO_SQL},
x as (select {_OVERRIDES}, {_KEPT}, p as old_p from scored, scenarios s),
q as (select x.*, {X.sql_logistic(X.sql_margin())} as ps from x, scaler),
n as (select trial_id, scenario_id, old_p, greatest(0.01::DOUBLE, least((ps + case when trial_id % 3 <> 0 then {TEXT_P} else ps end) / 2.0::DOUBLE
  + {X.sql_shift('enrollment_ratio')}, 0.99::DOUBLE)) as new_probability from q)
select trial_id, scenario_id, {r('new_probability', 5)} as new_probability, {X.sql_tier('new_probability', X.THRESHOLD, 'proportional')} as new_tier,
  {r('new_probability - old_p', 5)} as delta,
  case when new_probability > old_p then 'increased' when new_probability < old_p then 'decreased' else 'unchanged' end as direction from n""")
def whatif_rescore(spark, sf):
    base, fitted = X.linear_scores(spark, sf, "probability")
    base = base.withColumn("p_text", text_share())
    scored = whatif.whatif_rescore(
        base, X.SCENARIOS, lambda rows: X.linear_score(rows, fitted, "p_struct"), X.THRESHOLD
    )
    found = scored.select("trial_id", "scenario_id", "new_probability", "new_tier", "delta", "direction")
    return rounded(found, 5, "new_probability", "delta")


@query()
def whatif_rescore_trees(spark, sf):
    """The same grid scored by the calibrated trees."""
    prepared = prepare(spark, sf)
    fitted = prepared.scaler
    model, threshold = calibrated(prepared)

    def score(rows, output):
        vector = features_.scaled_vector(rows, fitted)
        return model.transform(vector).withColumnRenamed("probability", output).drop("features")

    base = score(prepared.made, "now").withColumn("p_text", F.lit(None).cast("double"))
    scored = whatif.whatif_rescore(
        base, X.SCENARIOS, lambda rows: score(rows, "p_struct").withColumnRenamed("now", "probability"), threshold
    )
    return scored.select("trial_id", "scenario_id", "new_probability", "new_tier", "delta", "direction")


# --- linear attributions, sections, summaries ------------------------------


def scaled_contributions(fitted):
    return {c: F.lit(float(w)) * features_.scaled_column(c, fitted) for c, w in X.COEFFICIENTS.items()}


def contribution_sql(scored=SCORED, effects=None):
    """``scored`` with a table ``long`` of every record's contributions, by feature."""
    parts = []
    labels = C.FEATURE_LABELS
    effects = effects or {c: f"{w}::DOUBLE * {sql_scaled(c)}" for c, w in X.COEFFICIENTS.items()}
    section_of = {f: (i, s) for i, (s, fs) in enumerate(C.SECTION_FEATURES.items()) for f in fs}
    for k, (c, effect) in enumerate(effects.items()):
        i, section = section_of.get(c, (9, C.OTHER_SECTION))
        order = C.SECTION_FEATURES[section].index(c) if section in C.SECTION_FEATURES else k
        parts.append(
            f"select trial_id, p, '{c}' as feature, '{labels[c]}' as label, '{section}' as section, {i} as so, {order} as fo, "
            f"{effect} as shap from scored, scaler"
        )
    return scored + ",\nlong as (" + " union all ".join(parts) + ")"


@query(f"with {contribution_sql()} select trial_id, feature, {r('shap', 6)} as shap from long")
def linear_attributions(spark, sf):
    known, fitted = X.fitted(spark, sf)
    rows = X.features(spark, sf, False, known)
    long = explain.contributions_long(rows, "trial_id", scaled_contributions(fitted))
    return rounded(long, 6, "shap")


def section_sql(contributions):
    return f"""{contributions},
sums as (select trial_id, p, section, so, sum(shap order by fo) as s from long group by all),
secs as (select trial_id, p, section, {X.sql_half_even('s', 4)} as contribution, case when s >= 0 then 'increases risk' else 'reduces risk' end as direction,
  row_number() over (partition by trial_id order by abs({X.sql_half_even('s', 4)}) desc, so) - 1 as place
  from sums where section <> '{C.OTHER_SECTION}' or abs(s) > 1e-6),
feats as (select trial_id, section, feature, label, {X.sql_half_even('shap', 4)} as shap,
  row_number() over (partition by trial_id, section order by abs({X.sql_half_even('shap', 4)}) desc, fo) - 1 as feature_place from long)"""


SECTION_SQL = section_sql(contribution_sql())


def explained_rows(spark, sf):
    rows, fitted = X.linear_scores(spark, sf, "probability")
    explained = explain.with_sections(rows, scaled_contributions(fitted), "sections")
    return explained.select("trial_id", "probability", "sections")


@query(f"""with {SECTION_SQL} select trial_id, section, contribution, abs(contribution) as abs_contribution, direction, place::INTEGER as place,
  feature_place::INTEGER as feature_place, label as name, feature as raw_name, shap from secs join feats using (trial_id, section)""")
def section_attributions(spark, sf):
    sections = explained_rows(spark, sf).select("trial_id", F.posexplode("sections").alias("place", "s"))
    features = sections.select(
        "trial_id", "place", "s.section", "s.contribution", "s.abs_contribution", "s.direction",
        F.posexplode("s.features").alias("feature_place", "f"),
    )
    return features.select(*features.columns[:-1], "f.name", "f.raw_name", "f.shap")


@query(f"""with {SECTION_SQL},
tops as (select trial_id, section, contribution, row_number() over (partition by trial_id, contribution > 0 order by place) as k
  from secs where contribution <> 0)
select trial_id, section, contribution, case when contribution > 0 then 'risk' else 'protective' end as side from tops
where k <= case when contribution > 0 then 3 else 2 end""")
def top_sections(spark, sf):
    rows = explained_rows(spark, sf)
    sides = {
        "risk": explain.top_risk_sections(F.col("sections")),
        "protective": explain.top_protective_sections(F.col("sections")),
    }
    both = F.concat(*[_named(found, name) for name, found in sides.items()])
    return rows.select("trial_id", F.explode(both).alias("s")).select("trial_id", "s.*")


def _named(found, name):
    return F.transform(
        found,
        lambda s: F.struct(
            F.lit(name).alias("side"), s["section"].alias("section"), s["contribution"].alias("contribution")
        ),
    )


def summary_sql(sections, threshold):
    return f"""with {sections},
ids as (select distinct trial_id, p from secs),
risk as (select trial_id, count(*) as n, arg_min(section, place) as s1, max(case when k = 2 then section end) as s2
  from (select *, row_number() over (partition by trial_id order by place) as k from secs where contribution > 0) group by 1),
guard as (select trial_id, arg_min(section, place) as g from secs where contribution < 0 group by 1),
strong as (select risk.trial_id, label, shap from risk join feats on feats.trial_id = risk.trial_id and feats.section = risk.s1 where feature_place = 0)
select trial_id, 'This trial is predicted ' || {X.sql_tier('p', threshold)} || ' (' || {X.sql_percent('p')} || ' probability) '
  || case when n >= 2 then 'primarily because the ' || lower(s1) || ' and ' || lower(s2) || ' are both strong predictors of early termination in historical trials.'
     when n = 1 then 'primarily due to concerns with the ' || lower(s1) || ', a strong predictor of early termination.'
     else 'with no single dominant risk factor.' end
  || case when n >= 1 then ' The strongest individual signal is "' || label || '" (SHAP contribution: ' || {X.sql_fixed('shap', 2, True)} || ').' else '' end
  || case when g is not null then ' However, the ' || lower(g) || ' partially offset this risk.' else '' end as summary
from ids left join risk using (trial_id) left join guard using (trial_id) left join strong using (trial_id)"""


@query(summary_sql(SECTION_SQL, X.THRESHOLD))
def nl_summary(spark, sf):
    tier = scoring.risk_tier(F.col("probability"), X.THRESHOLD)
    return explained_rows(spark, sf).select(
        "trial_id", explain.nl_summary(F.col("sections"), tier, F.col("probability")).alias("summary")
    )


# --- fitted models ---------------------------------------------


# The same operators with a given ensemble, whose results SQL can tell.

GIVEN_SCORED = f"{SCALER},\nscored as (select feat.*, {given.sql_probability()} as p from feat, scaler)"


def given_matrix(spark, sf):
    known, fitted = X.fitted(spark, sf)
    rows = features_.scale_features(X.features(spark, sf, False, known), fitted)
    return features_.feature_matrix(rows, columns=C.FEATURES)


@query(f"""with {GIVEN_SCORED} select trial_id, {r('p', 6)} as probability, {X.sql_tier('p', given.THRESHOLD)} as risk_tier,
  case {X.sql_tier('p', given.THRESHOLD)} when 'HIGH RISK' then '#E24B4A' when 'MEDIUM RISK' then '#EF9F27' else '#1D9E75' end as risk_color,
  {X.sql_half_even('p * 100.0::DOUBLE', 0)}::INTEGER as confidence_pct from scored""")
def score_given_trees(spark, sf):
    scored = models.score_records(given_matrix(spark, sf), given.MODEL, given.THRESHOLD)
    return rounded(scored.select("trial_id", "probability", "risk_tier", "risk_color", "confidence_pct"), 6, "probability")


@query(f"with {GIVEN_SCORED} select count(*) as n, {r('sum(p)', 6)} as total from scored")
def given_model_round_trip(spark, sf):
    """Every record scored by the given ensemble after it was written and read back."""
    folder = shared_folder(spark)
    artifacts.model_sink(given.MODEL, folder)
    scored = artifacts.model_scan(folder).transform(given_matrix(spark, sf))
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("total")), 6, "total")


GIVEN_EFFECTS = {c: given.sql_effect(c) for c in C.FEATURES}


@query(f"""with {contribution_sql(GIVEN_SCORED, GIVEN_EFFECTS)} select trial_id, feature, {r('shap', 6)} as shap,
  {r(repr(given.base_value()) + '::DOUBLE', 6)} as base_value,
  {r(repr(given.base_value()) + '::DOUBLE + sum(shap) over (partition by trial_id)', 6)} as log_odds from long""")
def attribute_given_trees(spark, sf):
    found = explain.tree_attributions(given_matrix(spark, sf).select("trial_id", "features"), given.MODEL.members)
    names = F.array(*map(F.lit, C.FEATURES))
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap")))
    long = found.select("trial_id", pairs.alias("one"), "base_value", "log_odds")
    return rounded(long.select("trial_id", "one.*", "base_value", "log_odds"), 6, "shap", "base_value", "log_odds")


@query(summary_sql(section_sql(contribution_sql(GIVEN_SCORED, GIVEN_EFFECTS)), given.THRESHOLD).replace(
    "as summary\nfrom", f"as natural_language_summary, {X.sql_half_even(repr(given.base_value()), 4)} as base_value\nfrom"))
def explain_given_trees(spark, sf):
    """Score, attribute and summarise every record, stored by key and read back."""
    scored = models.score_records(given_matrix(spark, sf), given.MODEL, given.THRESHOLD)
    folder = shared_folder(spark)
    artifacts.json_artifact_sink(explain.explain_batch(scored, given.MODEL.members), folder)
    return artifacts.json_artifact_scan(spark, folder, EXPLAINED).select("trial_id", "natural_language_summary", "base_value")


@query(f"""with {GIVEN_SCORED}, {SCENARIO_SQL},
x as (select {_OVERRIDES}, {_KEPT}, p as old_p from scored, scenarios s),
q as (select x.*, {given.sql_probability()} as ps from x, scaler),
n as (select trial_id, scenario_id, old_p, greatest(0.01::DOUBLE, least(ps + {X.sql_shift('enrollment_ratio')}, 0.99::DOUBLE)) as new_probability from q)
select trial_id, scenario_id, {r('new_probability', 5)} as new_probability, {X.sql_tier('new_probability', given.THRESHOLD, 'proportional')} as new_tier,
  {r('new_probability - old_p', 5)} as delta from n""")
def whatif_given_trees(spark, sf):
    known, fitted = X.fitted(spark, sf)
    rows = X.features(spark, sf, False, known)
    score = lambda table, name: given.MODEL.transform(features_.scaled_vector(table, fitted), name).drop("features")
    base = score(rows, "probability").withColumn("p_text", F.lit(None).cast("double"))
    scored = whatif.whatif_rescore(base, X.SCENARIOS, lambda table: score(table, "p_struct"), given.THRESHOLD)
    return rounded(scored.select("trial_id", "scenario_id", "new_probability", "new_tier", "delta"), 5, "new_probability", "delta")


@query()
def train_gbt(spark, sf):
    """The documented run, always fitted anew; ``trees`` tells how many rounds were kept."""
    prepared = prepare(spark, sf)
    train = prepared.matrix("train")
    fold = ranking.fold_of(F.col("trial_id"))
    model = models.train_gbt(train.filter(fold != 0), train.filter(fold == 0), SETTINGS, "trial_id")
    scored = model.transform(prepared.matrix("test"), "p")
    return scored.select("trial_id", "label", "p", F.lit(model.n_trees).alias("trees"))


@query()
def calibrate_isotonic(spark, sf):
    prepared = prepare(spark, sf)
    model, _ = calibrated(prepared)
    return model.transform(prepared.matrix("test")).select("trial_id", "label", "probability")


@query()
def score_records(spark, sf):
    prepared = prepare(spark, sf)
    scored = models.score_records(prepared.scaled(spark, sf), *calibrated(prepared))
    return scored.select("trial_id", "probability", "risk_tier", "risk_color", "confidence_pct")


def _model_round_trip(spark, sf):
    """Every record scored by the model and by what was written and read back."""
    folder = shared_folder(spark)
    prepared = prepare(spark, sf)
    model, _ = calibrated(prepared)
    artifacts.model_sink(model, folder)
    loaded = artifacts.model_scan(folder)
    again = loaded.transform(prepared.scaled(spark, sf)).withColumnRenamed("probability", "reloaded")
    return model.transform(again).select("trial_id", "probability", "reloaded")


@query()
def model_sink(spark, sf):
    return _model_round_trip(spark, sf)


@query("select count(*) as n, 0.0::DOUBLE as largest_gap from documents")
def model_scan(spark, sf):
    rows = _model_round_trip(spark, sf)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("probability") - F.col("reloaded"))).alias("largest_gap"))


def _text_epochs(spark, sf):
    """The test rows' term vectors, and the states of all epochs on the train rows."""
    docs = trials(spark, sf).select("trial_id", "terminated", "full_text").filter("terminated is not null")
    placed = ranking.stratified_split(docs, "trial_id", "terminated")
    terms = features_.document_terms(placed.filter("split = 'train'"), "trial_id", "full_text")
    model = features_.fit_tfidf(terms)
    tokens = features_.with_terms(placed, "full_text")
    vectors = model.transform(tokens).select("trial_id", "split", F.col("terminated").cast("double").alias("label"), "tfidf")
    # Every epoch scores the held-out rows: no text is cut into terms again for that.
    folder = shared_folder(spark)
    vectors.hint("rebalance", "split").write.partitionBy("split").parquet(folder)
    vectors = spark.read.schema(vectors.schema).parquet(folder)
    train, test = vectors.filter("split = 'train'"), vectors.filter("split = 'test'")
    held = ranking.fold_of(F.col("trial_id")) == 0
    return test, epochs.train_epochs(train.filter(~held), train.filter(held), "trial_id", "tfidf", shared_folder(spark))


@query()
def text_classifier(spark, sf):
    """The test rows scored by the best epoch."""
    test, states = _text_epochs(spark, sf)
    best, area = epochs.best_model(states, "tfidf")
    return best.transform(test).select("trial_id", "label", "p_text", F.lit(area).alias("validation_auroc"))


@query()
def text_epochs(spark, sf):
    """Loss and area of every epoch, and whether it was kept."""
    return epochs.progress(_text_epochs(spark, sf)[1])


@query()
def ablation_compare(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("trial_id"), "embedding")
    prepared = prepare(spark, sf)
    scaled = features_.scale_features(prepared.rows, prepared.scaler, keep=("trial_id", "terminated", "split"))
    joined = scaled.join(vectors, "trial_id").select(
        F.col("terminated").cast("double").alias("label"),
        "split", "trial_id",
        F.array(*[F.col(c).cast("double") for c in C.FEATURES]).alias("structured"),
        F.col("embedding").cast("array<double>").alias("text"),
    )
    folder = shared_folder(spark)
    joined.hint("rebalance", "split").write.partitionBy("split").parquet(folder)
    joined = spark.read.parquet(folder)
    columns = {"text": F.col("text"), "structured": F.col("structured"), "combined": F.concat("text", "structured")}
    sets = {}
    for name, column in columns.items():
        rows = joined.select("label", "split", "trial_id", array_to_vector(column).alias("features"))
        train, held = rows.filter("split = 'train'"), ranking.fold_of(F.col("trial_id")) == 0
        sets[name] = (train.filter(~held), train.filter(held), rows.filter("split = 'test'"))
    return models.ablation_compare(sets, SETTINGS)


@query()
def embed_texts(spark, sf):
    vectors = embed.embed_sections(t(spark, sf), "trial_id")
    return vectors.select("trial_id", "section", F.size("embedding").alias("dimension"), "embedding")


@query()
def tree_attributions(spark, sf):
    prepared = prepare(spark, sf)
    model, _ = calibrated(prepared)
    rows = prepared.scaled(spark, sf).select("trial_id", "features")
    return explain.tree_attributions(rows, models.gbt_members(model))


@query()
def explain_batch(spark, sf):
    """Score, attribute and summarise every record, stored by key and read back."""
    prepared = prepare(spark, sf)
    model, threshold = calibrated(prepared)
    scored = models.score_records(prepared.scaled(spark, sf), model, threshold)
    folder = shared_folder(spark)
    artifacts.json_artifact_sink(explain.explain_batch(scored, models.gbt_members(model)), folder)
    return artifacts.json_artifact_scan(spark, folder, EXPLAINED)


EXPLAINED = """trial_id bigint, probability double, risk_tier string, risk_color string, confidence_pct int, base_value double,
  section_attributions array<struct<section: string, contribution: double, abs_contribution: double, direction: string,
    features: array<struct<name: string, raw_name: string, shap: double>>>>, natural_language_summary string"""


# --- stream ----------------------------------------------------------------


@query(f"""with {SCORED} select trial_id, p, {X.sql_tier('p', X.THRESHOLD)} as tier from scored
where trial_id not in (select doc_id from labels)""")
def stream_score(spark, sf):
    """Records arrive as files; those with a label count as cached and are skipped."""
    source, target, checkpoint = (shared_folder(spark) for _ in range(3))
    rows = t(spark, sf)
    rows.write.parquet(source)
    known, fitted = X.fitted(spark, sf)

    def score(arriving):
        made = features_.engineer_features(arriving, known, X.SPEC)
        scored = X.linear_score(made, fitted, "p")
        return scored.select("trial_id", "p", scoring.risk_tier(F.col("p"), X.THRESHOLD).alias("tier"))

    cached = table(spark, sf, "labels").select(F.col("doc_id").alias("trial_id"))
    run_stream(spark, source, rows.schema, score, target, checkpoint, cached)
    return spark.read.parquet(target)
