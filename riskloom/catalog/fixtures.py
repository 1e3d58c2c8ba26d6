"""Bindings of the operators to the given tables, and the SQL they are checked by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.functions import numbers, scoring, text
from riskloom.operators import features as X
from riskloom.operators import ranking
from riskloom.plans.lookup import fitted_table
from riskloom.sources.tables import labels, trials

# The prose of the given documents is invented, so the words looked for are
# words that occur in it.
SPEC = X.FeatureSpec(
    outcome=("eligibility_criteria",),
    outcome_delimiter=",",
    age_words=["the"],
    placebo_words=["und"],
    randomized_words=["tion", "heit"],
    multicenter_words=["http", "www", "@"],
)

SCENARIOS = [
    {"id": 1, "enrollment": 45, "phase": "Phase 2", "multicenter": False, "has_placebo": False},
    {"id": 2, "enrollment": 150, "phase": "Phase 2", "multicenter": False, "has_placebo": True},
    {"id": 3, "enrollment": 500, "phase": "Phase 3", "multicenter": True, "has_placebo": True},
    {"id": 4, "enrollment": 2000, "phase": "Phase 4", "multicenter": True, "has_placebo": False},
]

# A fixed linear scorer stands in where results must be checkable by SQL.
COEFFICIENTS = {
    "phase_encoded": 0.15,
    "log_enrollment": -0.45,
    "has_expanded_access": -0.2,
    "condition_count": 0.1,
    "title_length": 0.12,
    "criteria_length": 0.3,
    "outcome_count": 0.01,
    "has_age_restriction": 0.25,
    "is_interventional": -0.3,
    "has_placebo": 0.2,
    "has_randomized": -0.15,
    "has_multicenter": -0.1,
    "text_complexity": 0.22,
    "enrollment_ratio": -0.35,
    "criteria_unique_ratio": 0.4,
}
INTERCEPT = -0.8
THRESHOLD = 0.4


def t(spark: SparkSession, folder: str) -> DataFrame:
    return trials(spark, folder, labelled=False)


def medians(spark: SparkSession, folder: str) -> DataFrame:
    return X.fit_medians(trials(spark, folder, labelled=False, texts=False), SPEC)


def features(
    spark: SparkSession, folder: str, labelled: bool = True, known: DataFrame | None = None
) -> DataFrame:
    """Features of every record; the label joins the narrow result, so that no text is shuffled for it."""
    made = X.engineer_features(t(spark, folder), known or medians(spark, folder), SPEC)
    return with_labels(spark, folder, made) if labelled else made


def with_labels(spark: SparkSession, folder: str, made: DataFrame) -> DataFrame:
    return made.join(labels(spark, folder), "trial_id", "left")


def stored_features(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Features of every record without label, written once: what is fitted on them and what scores them read no text again."""
    return fitted_table(features(spark, folder, False, known))


def split_features(
    spark: SparkSession, folder: str, known: DataFrame | None = None, made: DataFrame | None = None
) -> DataFrame:
    """Labelled features with their split; the split is fitted on keys and labels alone."""
    keys = trials(spark, folder, texts=False).select("trial_id", "terminated")
    cutoffs = ranking.split_cutoffs(keys, "trial_id", "terminated")
    every = with_labels(spark, folder, made) if made is not None else features(spark, folder, known=known)
    labelled = every.filter("terminated is not null")
    return ranking.stratified_split(labelled, "trial_id", "terminated", cutoffs=cutoffs)


def fitted(spark: SparkSession, folder: str) -> tuple[DataFrame, X.Scaler]:
    """The medians, and the scaler of the train rows made with them."""
    known = medians(spark, folder)
    train = split_features(spark, folder, known).filter("split = 'train'")
    return known, X.fit_scaler(train)


def linear_scores(spark: SparkSession, folder: str, output: str, labelled: bool = False):
    """Features with the fixed linear score, and the scaler used."""
    made = stored_features(spark, folder)
    scaler = X.fit_scaler(split_features(spark, folder, made=made).filter("split = 'train'"))
    return linear_score(with_labels(spark, folder, made) if labelled else made, scaler, output), scaler


def linear_score(rows: DataFrame, scaler: X.Scaler, output: str) -> DataFrame:
    """Logistic probability of the fixed linear scorer, to 6 decimals."""
    columns = {c: X.scaled_column(c, scaler) for c in C.FEATURES}
    margin = scoring.linear_margin(columns, COEFFICIENTS, INTERCEPT)
    return rows.withColumn(output, numbers.half_up(scoring.logistic(margin), 6))


def rounded(rows: DataFrame, places: int, *columns: str) -> DataFrame:
    return rows.withColumns({c: numbers.half_up(F.col(c), places) for c in columns})


# --- SQL -------------------------------------------------------------------

# The white space of the word functions, spelled out for the SQL engine.
BLANK = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD = rf"[^{BLANK}]+"
TERM = text.TERM
STRIP = rf"^[{BLANK}]+|[{BLANK}]+$"


def r(expr: str, places: int) -> str:
    """Round half up by plain double arithmetic."""
    return f"floor(({expr}) * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE"


def sql_units(expr: str, places: int) -> str:
    """The size of a number in units of its last place, half to even by its true value."""
    size, scale = f"abs(({expr})::DOUBLE)", f"{10**places}::DOUBLE"
    product = f"({size} * {scale})"
    high = f"({size} * 134217729::DOUBLE - ({size} * 134217729::DOUBLE - {size}))"
    lost = f"(({high} * {scale} - {product}) + ({size} - {high}) * {scale})"
    whole, rest = f"floor({product})::BIGINT", f"({product} - floor({product}))"
    up = f"{rest} > 0.5 or ({rest} = 0.5 and ({lost} > 0 or ({lost} = 0 and {whole} % 2 = 1)))"
    return f"({whole} + case when {up} then 1 else 0 end)"


def sql_half_even(expr: str, places: int) -> str:
    units = sql_units(expr, places)
    return f"((case when ({expr}) < 0 then -{units} else {units} end)::DOUBLE / {10**places}::DOUBLE)"


def sql_fixed(expr: str, places: int, signed: bool = False) -> str:
    scale, units = 10**places, sql_units(expr, places)
    plus = "+" if signed else ""
    return (
        f"(case when ({expr}) < 0 then '-' else '{plus}' end || "
        f"({units} // {scale})::VARCHAR || '.' || lpad(({units} % {scale})::VARCHAR, {places}, '0'))"
    )


def sql_percent(expr: str, places: int = 0) -> str:
    if places:
        return f"({sql_fixed(f'({expr}) * 100.0::DOUBLE', places)} || '%')"
    return f"({sql_half_even(f'({expr}) * 100.0::DOUBLE', 0)}::INTEGER::VARCHAR || '%')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def sql_words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{WORD}')"


def sql_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({expr}), '{w}')" for w in words) + ")"


def sql_flag(expr: str, words) -> str:
    return f"{sql_any(expr, words)}::INTEGER"


def sql_expected(phase: str) -> str:
    arms = " ".join(f"when {p} then {e}::DOUBLE" for p, e in C.EXPECTED_ENROLLMENT.items())
    return f"(case {phase} {arms} else {C.DEFAULT_EXPECTED}::DOUBLE end)"


T = """t as (
  select d.doc_id as trial_id, d.text as full_text,
    split_part(d.text, chr(10), 1) as official_title,
    case when instr(d.text, chr(10)) > 0 then substr(d.text, instr(d.text, chr(10)) + 1)
         else '' end as eligibility_criteria,
    case when d.lang = 'en' then 'INTERVENTIONAL' else 'OBSERVATIONAL' end as study_type,
    case when d.doc_id % 10 = 0 then 0 else d.n_chars % 1500 end as enrollment_count,
    cast(d.doc_id % 5 as double) as phase_encoded,
    d.doc_id % 7 = 0 as has_expanded_access,
    1 + d.doc_id % 4 as condition_count,
    1 - l.quality as terminated
  from documents d left join labels l on d.doc_id = l.doc_id)"""

FEAT = f"""{T},
med as (
  select phase_encoded, median(enrollment_count) as m from t
  where enrollment_count > 0 group by 1),
sized as (
  select t.*, case when enrollment_count = 0 then coalesce(m, 150.0) else enrollment_count end::DOUBLE as size
  from t left join med using (phase_encoded)),
counted as (
  select *, len({sql_words('official_title')})::DOUBLE as title_length,
    {sql_words('eligibility_criteria')} as w,
    (length(eligibility_criteria) - length(replace(eligibility_criteria, ',', '')) + 1)::DOUBLE as outcome_count
  from sized),
feat as (
  select trial_id, terminated, phase_encoded, ln(1 + size) as log_enrollment,
    has_expanded_access::INTEGER as has_expanded_access, condition_count::DOUBLE as condition_count,
    title_length, len(w)::DOUBLE as criteria_length, outcome_count,
    {sql_flag('eligibility_criteria', SPEC.age_words)} as has_age_restriction,
    (upper(study_type) = 'INTERVENTIONAL')::INTEGER as is_interventional,
    {sql_flag('full_text', SPEC.placebo_words)} as has_placebo,
    {sql_flag('full_text', SPEC.randomized_words)} as has_randomized,
    {sql_flag('full_text', SPEC.multicenter_words)} as has_multicenter,
    (len(w) + title_length)::DOUBLE / (outcome_count + 1)::DOUBLE as text_complexity,
    size / {sql_expected('phase_encoded')} as enrollment_ratio,
    len(list_distinct(w))::DOUBLE / (len(w) + 1)::DOUBLE as criteria_unique_ratio
  from counted)"""

SPLIT = f"""{FEAT},
ordered as (
  select *, row_number() over (partition by terminated order by md5(trial_id || ':42'), trial_id) as rn,
    count(*) over (partition by terminated) as n
  from feat where terminated is not null),
split as (
  select * exclude (rn, n), case when rn <= floor(n * 0.2 + 0.5) then 'test' else 'train' end as split
  from ordered)"""

SCALER = (
    SPLIT
    + ",\nscaler as (select "
    + ", ".join(
        f"avg({c}) as mean_{c}, case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end as std_{c}"
        for c in C.SCALED_FEATURES
    )
    + " from split where split = 'train')"
)


def sql_scaled(column: str) -> str:
    if column in C.SCALED_FEATURES:
        return f"(({column} - mean_{column}) / std_{column})"
    return f"{column}::DOUBLE"


def sql_margin() -> str:
    parts = [f"{INTERCEPT}::DOUBLE"]
    parts += [f"{w}::DOUBLE * {sql_scaled(c)}" for c, w in COEFFICIENTS.items()]
    return " + ".join(parts)


def sql_logistic(margin: str) -> str:
    return r(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin})))", 6)


SCORED = f"""{SCALER},
scored as (select feat.*, {sql_logistic(sql_margin())} as p from feat, scaler)"""


def sql_tier(p: str, threshold: float, mode: str = "additive") -> str:
    if mode == "additive":
        high, low = f"{threshold}::DOUBLE + 0.15::DOUBLE", f"{threshold}::DOUBLE - 0.15::DOUBLE"
    else:
        high, low = f"{threshold}::DOUBLE * 1.40::DOUBLE", f"{threshold}::DOUBLE * 0.65::DOUBLE"
    return f"case when {p} >= {high} then 'HIGH RISK' when {p} >= {low} then 'MEDIUM RISK' else 'LOW RISK' end"


def sql_shift(ratio: str) -> str:
    return (
        f"case when {ratio} < 0.15::DOUBLE then 0.20::DOUBLE when {ratio} < 0.40::DOUBLE then 0.13::DOUBLE "
        f"when {ratio} < 0.80::DOUBLE then 0.06::DOUBLE when {ratio} <= 1.50::DOUBLE then 0.0::DOUBLE "
        f"when {ratio} <= 3.00::DOUBLE then -0.08::DOUBLE else -0.14::DOUBLE end"
    )
