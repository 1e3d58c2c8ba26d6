"""Queries of the projection operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from riskloom import constants as C
from riskloom.catalog import fixtures as X
from riskloom.catalog.fixtures import T, r, sql_strip, sql_words, t
from riskloom.catalog.registry import registry
from riskloom.functions import coding, numbers, scoring, text
from riskloom.operators import prompts
from riskloom.operators.features import text_complexity as complexity
from riskloom.operators.joins import scenario_cross
from riskloom.operators.sections import section_texts
from riskloom.sources.tables import table

QUERIES, ORACLES, query = registry()

STATUS_NAMES = {"F": "Terminated", "O": "Completed", "P": "Withdrawn"}
MARKERS = {"eligibility": ["nicht", "under"], "endpoint": ["ing", "und"], "design": ["tion"]}
SECTION_CYCLE = ["Eligibility criteria", "Primary endpoints", "Study design", "(Full Protocol)"]


def named_status():
    return F.try_element_at(
        F.create_map(*[F.lit(x) for pair in STATUS_NAMES.items() for x in pair]), F.col("o_orderstatus")
    )


SQL_STATUS = "case o_orderstatus when 'F' then 'Terminated' when 'O' then 'Completed' when 'P' then 'Withdrawn' end"


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O')")
def status_filter(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@query(
    f"select o_orderkey, (upper({SQL_STATUS}) in ('TERMINATED','WITHDRAWN','SUSPENDED'))::INTEGER as terminated from orders"
)
def status_label(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", coding.status_label(named_status()).alias("terminated"))


@query("""
select o_orderkey, case when p like '%PHASE1%' or p like '%PHASE 1%' then 1 when p like '%PHASE2%' or p like '%PHASE 2%' then 2
  when p like '%PHASE3%' or p like '%PHASE 3%' then 3 when p like '%PHASE4%' or p like '%PHASE 4%' then 4 else 0 end::INTEGER as phase
from (select o_orderkey, 'PHASE' || substr(o_orderpriority, 1, 1) as p from orders)""")
def phase_encode(spark, sf):
    first = F.concat(F.lit("Phase"), F.substring("o_orderpriority", 1, 1))
    return table(spark, sf, "orders").select(
        "o_orderkey", coding.phase_encode(F.array(first, F.col("o_orderpriority"))).alias("phase")
    )


@query("""
select o_orderkey,
  case when contains(x, '4') then 'Phase 4' when contains(x, '3') then 'Phase 3' when contains(x, '2') then 'Phase 2'
       when contains(x, '1') then 'Phase 1' else 'Phase 2' end as last_phase,
  case when contains(x, '1') then 'Phase 1' when contains(x, '3') then 'Phase 3' when contains(x, '4') then 'Phase 4'
       else 'Phase 2' end as first_phase,
  case substr(x, 1, 1) when '1' then 1.0::DOUBLE when '3' then 3.0::DOUBLE when '4' then 4.0::DOUBLE else 2.0::DOUBLE end as code,
  case substr(x, 1, 1) when '1' then 'Phase 1' when '3' then 'Phase 3' when '4' then 'Phase 4' else 'Phase 2' end as name
from (select o_orderkey, o_orderpriority || ' ' || o_orderkey as x from orders)""")
def phase_parse(spark, sf):
    both = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    digit = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        coding.phase_parse(both, "last").alias("last_phase"),
        coding.phase_parse(both, "first").alias("first_phase"),
        coding.phase_code(F.concat(F.lit("Phase "), digit)).alias("code"),
        coding.phase_name(digit.cast("double")).alias("name"),
    )


@query(f"""with {T} select trial_id, concat_ws(chr(10), nullif(official_title, ''), nullif(eligibility_criteria, ''), study_type) as joined from t""")
def concat_nonempty(spark, sf):
    parts = [F.col("official_title"), F.col("eligibility_criteria"), F.col("study_type")]
    return t(spark, sf).select("trial_id", text.concat_nonempty(parts).alias("joined"))


@query("""
select conv_id, turn, role || ': ' || text || ' | turn: ' || turn || ' | ' || role || ': ' as outcomes from conversations""")
def outcomes_flatten(spark, sf):
    pair = lambda measure, description: F.struct(
        measure.alias("measure"), description.alias("description")
    )
    outcomes = F.array(
        pair(F.col("role"), F.col("text")),
        pair(F.lit("turn"), F.col("turn").cast("string")),
        pair(F.col("role"), F.lit(None).cast("string")),
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", coding.flatten_outcomes(outcomes).alias("outcomes")
    )


@query("""
select event_id, case when event_id % 2 = 0 then regexp_extract(props, '"k": (\\d+)', 1)::BIGINT else event_id end as size from events""")
def struct_or_scalar(spark, sf):
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", coding.struct_or_scalar(F.parse_json(mixed), "k", "bigint").alias("size")
    )


@query("""
select conv_id, turn, len(string_split(text, ' '))::INTEGER as listed, 1::INTEGER as scalar,
  (case when role = 'system' then 1 else 0 end)::INTEGER as missing from conversations""")
def array_size_or_one(spark, sf):
    listed = T_.ArrayType(T_.StringType())
    opening = F.when(F.col("role") == "system", F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        coding.size_or_one(F.split("text", " "), listed).alias("listed"),
        coding.size_or_one(F.col("turn"), T_.LongType()).alias("scalar"),
        coding.size_or_one(opening, T_.StringType()).alias("missing"),
    )


@query(f"""with {T} select trial_id, coalesce(nullif(eligibility_criteria, ''), official_title, '') as criteria, 'none' as absent from t""")
def coalesce_alias(spark, sf):
    rows = t(spark, sf).withColumn("eligibilityCriteria", F.nullif("eligibility_criteria", F.lit("")))
    names = ["eligibilityText", "eligibilityCriteria", "official_title"]
    return rows.select(
        "trial_id",
        coding.coalesce_alias(rows, names, "").alias("criteria"),
        coding.coalesce_alias(rows, ["nowhere"], "none").alias("absent"),
    )


@query(f"with {T} select trial_id, {r('ln(1 + enrollment_count)', 9)} as log_enrollment from t")
def log1p_scale(spark, sf):
    return t(spark, sf).select(
        "trial_id", numbers.half_up(numbers.log_size(F.col("enrollment_count")), 9).alias("log_enrollment")
    )


@query(f"with {T} select trial_id, len({sql_words('full_text')})::INTEGER as n_words from t")
def word_count(spark, sf):
    return t(spark, sf).select("trial_id", text.word_count(F.col("full_text")).alias("n_words"))


@query(f"""with {T} select trial_id,
  (length(full_text) - length(replace(full_text, ',', '')) + 1)::INTEGER as commas,
  ((length(full_text) - length(replace(full_text, 'the', ''))) // 3 + 1)::INTEGER as thes from t""")
def delimiter_count(spark, sf):
    body = F.col("full_text")
    return t(spark, sf).select(
        "trial_id", text.delimiter_count(body, ",").alias("commas"), text.delimiter_count(body, "the").alias("thes")
    )


@query(f"""with {T} select trial_id, {X.sql_flag('full_text', X.SPEC.age_words)} as age,
  {X.sql_flag('full_text', X.SPEC.placebo_words)} as placebo, {X.sql_flag('full_text', X.SPEC.randomized_words)} as randomized,
  {X.sql_flag('full_text', X.SPEC.multicenter_words)} as multicenter from t""")
def keyword_flags(spark, sf):
    lowered = t(spark, sf).select("trial_id", F.lower("full_text").alias("x"))
    lists = {
        "age": X.SPEC.age_words,
        "placebo": X.SPEC.placebo_words,
        "randomized": X.SPEC.randomized_words,
        "multicenter": X.SPEC.multicenter_words,
    }
    return lowered.select("trial_id", *[text.keyword_flag(F.col("x"), w, True).alias(n) for n, w in lists.items()])


@query(f"with {T} select trial_id, (upper(study_type) = 'INTERVENTIONAL')::INTEGER as is_interventional from t")
def equals_flag(spark, sf):
    return t(spark, sf).select(
        "trial_id", coding.equals_flag(F.col("study_type"), "INTERVENTIONAL").alias("is_interventional")
    )


@query(f"""with {T} select trial_id, (len({sql_words('eligibility_criteria')}) + len({sql_words('official_title')}))::DOUBLE
  / (length(full_text) - length(replace(full_text, ',', '')) + 2)::DOUBLE as complexity from t""")
def text_complexity(spark, sf):
    return t(spark, sf).select(
        "trial_id",
        complexity(
            text.word_count(F.col("eligibility_criteria")),
            text.word_count(F.col("official_title")),
            text.delimiter_count(F.col("full_text"), ","),
        ).alias("complexity"),
    )


@query(f"with {T} select trial_id, enrollment_count::DOUBLE / {X.sql_expected('phase_encoded')} as ratio from t")
def enrollment_ratio(spark, sf):
    return t(spark, sf).select(
        "trial_id", coding.enrollment_ratio(F.col("enrollment_count"), F.col("phase_encoded")).alias("ratio")
    )


@query(f"with {T} select trial_id, greatest(0.0::DOUBLE, {X.sql_expected('phase_encoded')} - enrollment_count::DOUBLE) as deficit from t")
def enrollment_deficit(spark, sf):
    return t(spark, sf).select(
        "trial_id", coding.enrollment_deficit(F.col("enrollment_count"), F.col("phase_encoded")).alias("deficit")
    )


@query(f"""with {T}, w as (select trial_id, {sql_words('full_text')} as w from t)
select trial_id, len(list_distinct(w))::DOUBLE / (len(w) + 1)::DOUBLE as ratio from w""")
def unique_word_ratio(spark, sf):
    return t(spark, sf).select("trial_id", text.unique_word_ratio(F.col("full_text")).alias("ratio"))


@query(f"""with {T} select trial_id, greatest(10, least(enrollment_count, 2000))::BIGINT as size,
  greatest(0.01::DOUBLE, least(enrollment_count::DOUBLE / 1000.0::DOUBLE, 0.99::DOUBLE)) as share from t""")
def clip_range(spark, sf):
    size = F.col("enrollment_count")
    return t(spark, sf).select(
        "trial_id",
        numbers.clip(size, *C.ENROLLMENT_RANGE).alias("size"),
        numbers.clip(size.cast("double") / 1000.0, *C.PROBABILITY_RANGE).alias("share"),
    )


@query("""
select o_orderkey, case when o_orderstatus = 'P' then 100 else trunc(o_totalprice)::INTEGER end as number from orders""")
def parse_number(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", "about 1,000").otherwise(F.format_number("o_totalprice", 2))
    return table(spark, sf, "orders").select("o_orderkey", numbers.parse_number(raw, 100).alias("number"))


@query(f"""with {T} select trial_id, case
  when instr(lower(full_text), 'nicht') > 0 then substr(full_text, instr(lower(full_text), 'nicht'))
  when instr(lower(full_text), 'tion') > 0 then substr(full_text, instr(lower(full_text), 'tion'))
  else full_text end as criteria from t""")
def criteria_from_marker(spark, sf):
    return t(spark, sf).select(
        "trial_id", text.from_marker(F.col("full_text"), ["nicht", "tion"]).alias("criteria")
    )


@query(f"""with {T} select trial_id, coalesce(
    case when trial_id % 3 = 0 then null when trial_id % 3 = 1 then null else 'Study ' || trial_id end,
    nullif(case when trial_id % 2 = 0 then '' else study_type end, ''),
    substr(split_part(full_text, chr(10), 1), 1, 200)) as title from t""")
def title_fallback(spark, sf):
    key = F.col("trial_id")
    given = F.when(key % 3 == 0, "").when(key % 3 == 1, "nan").otherwise(F.concat(F.lit("Study "), key.cast("string")))
    second = F.when(key % 2 == 0, "").otherwise(F.col("study_type"))
    return t(spark, sf).select("trial_id", text.title_fallback([given, second], F.col("full_text")).alias("title"))


BLOCKS = """'--- OFFICIAL TITLE ---' || chr(10) || official_title || chr(10) || chr(10)
  || '--- STUDY-DESIGN NOTES ---' || chr(10) || study_type || chr(10) || chr(10)
  || '--- ELIGIBILITY CRITERIA ---' || chr(10) || eligibility_criteria"""


def blocks():
    return text.section_blocks(
        {
            "official title": F.col("official_title"),
            "study-design notes": F.col("study_type"),
            "eligibility criteria": F.col("eligibility_criteria"),
        }
    )


@query(f"""with {T}, h as (select trial_id, {BLOCKS} as body from t),
named as (select trial_id, list_transform(regexp_extract_all(body, '(?m)^--- (.+?) ---$', 1),
    lambda n: array_to_string(list_transform(regexp_extract_all(lower({sql_strip('n')}), '(\\p{{L}}+|[^\\p{{L}}]+)'),
      lambda q: upper(q[1]) || q[2:]), '')) as names from h)
select trial_id, unnest(list_sort(list_distinct(list_concat(names, ['Study design', 'Official Title'])))) as section from named""")
def list_section_headers(spark, sf):
    extra = F.array(F.lit("Study design"), F.lit("Official Title"))
    return t(spark, sf).select("trial_id", F.explode(text.list_sections(blocks(), extra)).alias("section"))


def _sql_marker(body: str, section: str) -> str:
    arms = []
    for key, markers in MARKERS.items():
        for m in markers:
            at = f"instr(lower({body}), '{m}')"
            start = f"greatest({at} - 30, 1)"
            window = sql_strip(f"substr({body}, {start}, {at} + 2000 - {start})")
            arms.append(f"when contains(lower({section}), '{key}') and {at} > 0 then {window}")
    return " ".join(arms)


@query(f"""with {T}, s as (select trial_id, full_text,
  case trial_id % 4 when 0 then 'Eligibility criteria' when 1 then 'Primary endpoints' when 2 then 'Study design'
       else '(Full Protocol)' end as section from t)
select trial_id, section, case when length(full_text) = 0 then '' when section[1] = '(' then full_text
  {_sql_marker('full_text', 'section')} else {sql_strip('substr(full_text, 1, 2000)')} end as body from s""")
def extract_section(spark, sf):
    section = F.get(F.array(*[F.lit(s) for s in SECTION_CYCLE]), (F.col("trial_id") % 4).cast("int"))
    rows = t(spark, sf).select("trial_id", "full_text", section.alias("section"))
    body = text.extract_section(F.col("full_text"), F.col("section"), MARKERS)
    return rows.select("trial_id", "section", body.alias("body"))


@query(f"""with {T}, h as (select trial_id, {BLOCKS} as body,
  case when trial_id % 2 = 0 then 'STUDY-DESIGN NOTES' else 'ELIGIBILITY CRITERIA' end as name from t),
c as (select *, substr(body, instr(body, '--- ' || name || ' ---') + length('--- ' || name || ' ---')) as tail from h)
select trial_id, name, {sql_strip("'--- ' || name || ' ---' || string_split_regex(tail, chr(10) || '--- .+? ---')[1]")} as body from c""")
def extract_section_block(spark, sf):
    name = F.when(F.col("trial_id") % 2 == 0, "STUDY-DESIGN NOTES").otherwise("ELIGIBILITY CRITERIA")
    rows = t(spark, sf).select("trial_id", name.alias("name"), blocks().alias("whole"))
    return rows.select("trial_id", "name", text.extract_section(F.col("whole"), F.initcap("name")).alias("body"))


@query(f"""with {T} select trial_id, 'full_text' as section, full_text as text from t
union all select trial_id, 'eligibility_criteria', eligibility_criteria from t
union all select trial_id, 'primary_outcome', full_text from t""", "section_texts")
def section_texts_rows(spark, sf):
    return section_texts(t(spark, sf), "trial_id")


@query(f"""with {T} select trial_id, case when {sql_strip('eligibility_criteria')} = '' then '[UNK]' else eligibility_criteria end as body from t""")
def blank_to_token(spark, sf):
    return t(spark, sf).select("trial_id", text.blank_to_token(F.col("eligibility_criteria")).alias("body"))


SCORE = "((trial_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE"


def share_score():
    return (F.col("trial_id") * 37 % 1000).cast("double") / 1000.0


@query(f"""with {T}, s as (select *, {SCORE} as p from t),
l as (select *, {X.sql_tier('p', X.THRESHOLD)} as tier from s),
d as (select trial_id, '[' || case when contains(tier, 'HIGH') then 'HIGH' when contains(tier, 'MED') then 'MED' else 'LOW' end
  || '] ' || trial_id || ' — ' || substr(official_title, 1, 45) || ' · ' || substr(study_type, 1, 20)
  || case when length(official_title) > 45 then '…' else '' end || ' (' || {X.sql_percent('p')} || ')' as label from l)
select trial_id, label, trial_id::VARCHAR as parsed from d""")
def truncate_label(spark, sf):
    rows = t(spark, sf).withColumn("p", share_score())
    label = prompts.choice_label(
        F.col("trial_id"), F.col("official_title"), F.col("study_type"),
        scoring.risk_tier(F.col("p"), X.THRESHOLD), F.col("p"),
    )
    return rows.select("trial_id", label.alias("label")).withColumn("parsed", prompts.choice_key(F.col("label")))


SCENARIO_ROWS = ", ".join(
    f"({s['id']}, {s['enrollment']}, '{s['phase']}', {str(s['multicenter']).lower()}, {str(s['has_placebo']).lower()})"
    for s in X.SCENARIOS
)
SCENARIO_SQL = f"scenarios(scenario_id, enrollment, phase, multicenter, has_placebo) as (values {SCENARIO_ROWS})"


def parameter_maps(rows):
    """Old and new parameters of each record and scenario as text maps."""
    crossed = scenario_cross(rows, X.SCENARIOS)
    old = {
        "enrollment": F.col("enrollment_count").cast("string"),
        "phase": coding.phase_name(F.col("phase_encoded")),
        "expanded": F.col("has_expanded_access").cast("string"),
    }
    new = {
        "enrollment": F.col("scenario_enrollment").cast("string"),
        "phase": F.col("scenario_phase"),
        "multicenter": F.col("scenario_multicenter").cast("string"),
    }
    as_map = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return crossed.select("trial_id", "scenario_id", as_map(old).alias("before"), as_map(new).alias("after"))


SQL_PHASE_NAME = """case phase_encoded when 1 then 'Phase 1' when 2 then 'Phase 2' when 3 then 'Phase 3'
  when 4 then 'Phase 4' else 'Phase 2' end"""

CHANGES_SQL = f"""{T}, {SCENARIO_SQL},
pairs as (
  select trial_id, scenario_id, 'enrollment' as parameter, t.enrollment_count::VARCHAR as old_value, s.enrollment::VARCHAR as new_value from t, scenarios s
  union all select trial_id, scenario_id, 'phase', {SQL_PHASE_NAME}, s.phase from t, scenarios s
  union all select trial_id, scenario_id, 'expanded', has_expanded_access::VARCHAR, null from t, scenarios s
  union all select trial_id, scenario_id, 'multicenter', null, s.multicenter::VARCHAR from t, scenarios s),
changes as (select * from pairs where old_value is distinct from new_value)"""


@query(f"with {CHANGES_SQL} select trial_id, scenario_id, parameter, old_value, new_value from changes")
def describe_changes(spark, sf):
    changed = parameter_maps(t(spark, sf)).select(
        "trial_id", "scenario_id", F.explode(scoring.describe_changes(F.col("before"), F.col("after"))).alias("parameter", "v")
    )
    return changed.select(
        "trial_id", "scenario_id", "parameter", F.col("v.from").alias("old_value"), F.col("v.to").alias("new_value")
    )


@query(f"""with {T}, d as (select trial_id, ((trial_id * 37) % 1000 - (trial_id * 91) % 1000)::DOUBLE / 1000.0::DOUBLE as delta from t)
select trial_id, delta, case when delta > 0 then 'increased' when delta < 0 then 'decreased' else 'unchanged' end as direction from d""")
def delta_direction(spark, sf):
    key = F.col("trial_id")
    delta = (key * 37 % 1000 - key * 91 % 1000).cast("double") / 1000.0
    return t(spark, sf).select("trial_id", delta.alias("delta")).withColumn(
        "direction", numbers.delta_direction(F.col("delta"))
    )


PROMPT_SQL = f"""{T}, {SCENARIO_SQL}, s as (select *, {SCORE} as p,
  (trial_id % 7)::DOUBLE / 10.0 - 0.3 as c1, (trial_id % 5)::DOUBLE / 10.0 - 0.25 as c2,
  (trial_id % 3)::DOUBLE / 10.0 - 0.12 as c3, (trial_id % 11)::DOUBLE / 10.0 - 0.55 as c4 from t)"""
_PLUS = lambda e: X.sql_fixed(e, 3, True)


@query(f"""with {PROMPT_SQL},
factors as (select trial_id, unnest([{{'name': 'Criteria', 'shap': c1}}, {{'name': 'Endpoints', 'shap': c2}},
    {{'name': 'Design', 'shap': c3}}, {{'name': 'Scale', 'shap': c4}}]) as f from s),
ranked as (select trial_id, f.name as name, f.shap as shap,
    row_number() over (partition by trial_id order by abs(f.shap) desc, f.name) as k from factors),
top3 as (select trial_id, string_agg('  - ' || name || ': contribution = ' || {_PLUS('shap')}, chr(10) order by k) as lines
    from ranked where k <= 3 group by trial_id)
select trial_id, 'Trial: ' || official_title || chr(10) || 'Condition: ' || study_type || chr(10) || 'Risk tier: '
  || {X.sql_tier('p', X.THRESHOLD)} || chr(10) || 'Termination probability: ' || {X.sql_percent('p', 1)} || chr(10) || chr(10)
  || 'Top contributing factors:' || chr(10) || lines || chr(10) || chr(10)
  || 'Explain in 2-3 sentences why this trial carries this risk level.' as explain_prompt,
  'Protocol section: Eligibility criteria' || chr(10) || 'Trial phase: ' || {SQL_PHASE_NAME} || chr(10) || 'Condition: ' || study_type
  || chr(10) || 'Risk contribution score: ' || {_PLUS('c1')} || chr(10) || chr(10) || 'Section text:' || chr(10)
  || substr(eligibility_criteria, 1, 2000) || chr(10) || chr(10)
  || 'Suggest 2-3 specific, actionable edits to reduce termination risk.' || chr(10)
  || 'Respond in JSON: {{"rewrites": ["edit 1", "edit 2", "edit 3"]}}' as rewrite_prompt
from s join top3 using (trial_id)""")
def build_prompts(spark, sf):
    key = F.col("trial_id")
    share = lambda m, d: (key % m).cast("double") / 10.0 - F.lit(d)
    c1 = share(7, 0.3)
    named = {"Criteria": c1, "Endpoints": share(5, 0.25), "Design": share(3, 0.12), "Scale": share(11, 0.55)}
    factors = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("shap")) for n, v in named.items()])
    p = share_score()
    return t(spark, sf).select(
        "trial_id",
        prompts.explain_prompt(
            F.col("official_title"), F.col("study_type"), scoring.risk_tier(p, X.THRESHOLD), p, factors
        ).alias("explain_prompt"),
        prompts.rewrite_prompt(
            F.lit("Eligibility criteria"), coding.phase_name(F.col("phase_encoded")), F.col("study_type"),
            c1, F.col("eligibility_criteria"),
        ).alias("rewrite_prompt"),
    )


@query(f"""with {CHANGES_SQL},
lines as (select trial_id, scenario_id, string_agg('  "' || parameter || '": {{"from": ' || coalesce(old_value, 'null')
   || ', "to": ' || coalesce(new_value, 'null') || '}}', chr(10) order by parameter) as lines from changes group by all),
p as (select l.*, ((trial_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE as old_p, ((trial_id * 91 + scenario_id * 13) % 1000)::DOUBLE / 1000.0::DOUBLE as new_p from lines l)
select trial_id, scenario_id, 'Original termination probability: ' || {X.sql_percent('old_p', 1)} || chr(10)
  || 'New termination probability: ' || {X.sql_percent('new_p', 1)} || chr(10) || 'Risk '
  || case when new_p - old_p > 0 then 'increased' when new_p - old_p < 0 then 'decreased' else 'unchanged' end
  || ' by ' || {X.sql_percent('abs(new_p - old_p)', 1)} || chr(10) || chr(10) || 'Parameters changed:' || chr(10) || lines
  || chr(10) || chr(10) || 'Explain in 1-2 sentences why the risk changed (or didn''t).' as prompt from p""")
def build_change_prompts(spark, sf):
    maps = parameter_maps(t(spark, sf))
    new = (F.col("trial_id") * 91 + F.col("scenario_id") * 13).cast("bigint") % 1000
    return maps.select(
        "trial_id",
        "scenario_id",
        prompts.whatif_prompt(F.col("before"), F.col("after"), share_score(), new.cast("double") / 1000.0).alias("prompt"),
    )


REPLY_SQL = """replies as (select conv_id, turn, text, case (conv_id + turn) % 4
  when 0 then '```json' || chr(10) || '{"rewrites": ["First of ' || turn || ' ", "", "Second ' || conv_id || '"]}' || chr(10) || '```'
  when 1 then 'Edits:' || chr(10) || '1. ' || role || ' one' || chr(10) || ' 2) two' || chr(10) || '3: three' || chr(10) || '4. four'
  when 2 then text else '  ' end as reply from conversations)"""


def replies(spark, sf):
    key = (F.col("conv_id") + F.col("turn")) % 4
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    fenced = F.concat(
        F.lit('```json\n{"rewrites": ["First of '), turn, F.lit(' ", "", "Second '), conv, F.lit('"]}\n```')
    )
    listed = F.concat(F.lit("Edits:\n1. "), F.col("role"), F.lit(" one\n 2) two\n3: three\n4. four"))
    reply = F.when(key == 0, fenced).when(key == 1, listed).when(key == 2, F.col("text")).otherwise("  ")
    return table(spark, sf, "conversations").withColumn("reply", reply)


@query(f"""with {REPLY_SQL},
parts as (select conv_id, turn, reply, list_filter(list_transform(string_split_regex(reply, '\\n[{X.BLANK}]*\\p{{Nd}}+[.):][{X.BLANK}]+'),
   lambda x: {sql_strip('x')}), lambda x: x <> '') as parts from replies),
lists as (select conv_id, turn, case when starts_with(reply, '```json')
   then [trim(regexp_extract(reply, '"(First[^"]*)"', 1)), regexp_extract(reply, '"(Second[^"]*)"', 1)]
  when len(parts) >= 2 then parts[1:3] when {sql_strip('reply')} <> '' then [{sql_strip('reply')}]
  else ['{C.NO_SUGGESTIONS}'] end as items from parts)
select conv_id, turn, unnest(range(len(items)))::INTEGER as place, unnest(items) as item from lists""")
def parse_suggestions(spark, sf):
    parsed = replies(spark, sf).select("conv_id", "turn", text.replies_to_list(F.col("reply")).alias("items"))
    return parsed.select("conv_id", "turn", F.posexplode("items").alias("place", "item"))


@query(f"""with {REPLY_SQL},
numbered as (select conv_id, turn, text, list_filter(list_transform(string_split(reply, chr(10)), lambda x: {sql_strip('x')}),
  lambda x: length(x) > 2 and regexp_matches(x, '^\\p{{Nd}}') and contains(x, '. ')) as lines from replies)
select conv_id, turn, case when len(lines) > (turn % 2) then text || chr(10) || chr(10) || '{C.REVISION_MARK}: '
  || substr(lines[(turn % 2) + 1], instr(lines[(turn % 2) + 1], '. ') + 2) else text end as revised from numbered""")
def apply_suggestion(spark, sf):
    pick = (F.col("turn") % 2).cast("int")
    return replies(spark, sf).select(
        "conv_id", "turn", text.apply_suggestion(F.col("reply"), F.col("text"), pick).alias("revised")
    )


@query("""
select event_type, round(avg(value), 4) as mean_value, round(max(value) / 3.0::DOUBLE, 4) as third from events group by 1""")
def metric_rounding(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        numbers.metric_round(F.avg("value")).alias("mean_value"),
        numbers.metric_round(F.max("value") / 3.0).alias("third"),
    )


@query(f"with {T} select trial_id, (has_expanded_access and trial_id % 2 = 0)::INTEGER as flag, (enrollment_count <> 0)::INTEGER as sized from t")
def truthy_flag(spark, sf):
    partial = F.when(F.col("trial_id") % 2 == 0, F.col("has_expanded_access"))
    return t(spark, sf).select(
        "trial_id", coding.truthy(partial).alias("flag"), coding.truthy(F.col("enrollment_count")).alias("sized")
    )


@query(f"""with {T} select trial_id, coalesce(case when trial_id % 3 = 0 then null else has_expanded_access end,
  contains(lower(full_text), 'und') or contains(lower(full_text), 'www')) or contains(lower(full_text), 'www') as flag from t""")
def flag_or_text(spark, sf):
    flag = F.when(F.col("trial_id") % 3 == 0, None).otherwise(F.col("has_expanded_access"))
    return t(spark, sf).select(
        "trial_id", coding.flag_or_text(flag, F.col("full_text"), ["und", "www"], ["www"]).alias("flag")
    )

