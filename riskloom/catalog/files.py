"""Queries of sources and sinks: tables are written to a new shared folder and read back."""

from __future__ import annotations

import gc

from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.catalog import fixtures as X
from riskloom.catalog.fixtures import T, r, sql_strip, t
from riskloom.catalog.registry import registry
from riskloom.catalog.scalars import SQL_PHASE_NAME
from riskloom.functions import coding, numbers, scoring
from riskloom.session import shared_folder
from riskloom.sources import artifacts, records, samples
from riskloom.sources.tables import documents, table
from riskloom.sources.tables import parquet_scan as scan
from riskloom.sources.tables import parquet_sink as sink

QUERIES, ORACLES, query = registry()

#: Folders of text files that are read at a time.
FOLDERS = 200


@query("select page_id, url, md5(html) as html_md5 from pages")
def harvest_pages(spark, sf):
    """Two overlapping search terms return the same records; each counts once."""
    folder = shared_folder(spark)
    landed = table(spark, sf, "pages").select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("term"),
        F.col("page_id").cast("int").alias("page"),
        F.array(F.struct("page_id", "url", "html")).alias("studies"),
        F.concat(F.lit("p"), (F.col("page_id") + 1).cast("string")).alias("nextPageToken"),
    )
    landed.write.json(folder)
    found = records.harvest_pages(
        spark, folder, "struct<page_id: bigint, url: string, html: string>", key="page_id"
    )
    return found.select("page_id", "url", F.md5("html").alias("html_md5"))


@query("""select event_id, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT as k from events""")
def flatten_nested(spark, sf):
    parsed = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("v"))
    found = records.find_key(F.col("v"), records.variant_shape(parsed, "v"), "k")
    return parsed.select("event_id", F.try_variant_get(found, "$", "bigint").alias("k"))


STATUS = ["COMPLETED", "TERMINATED", "withdrawn", "Suspended", "UNKNOWN"]


@query(f"""with {T} select 'NCT' || trial_id as nct_id, (trial_id % 5 in (1, 2, 3))::INTEGER as terminated,
  concat_ws(chr(10), nullif(official_title, ''), study_type || ' study', nullif(eligibility_criteria, ''),
    'Measure ' || trial_id || ': first | Second: ') as full_text,
  enrollment_count, case when trial_id % 5 = 0 then 0 else trial_id % 5 end::INTEGER as phase_encoded, has_expanded_access,
  condition_count::INTEGER as condition_count, coalesce(official_title, '') as official_title, eligibility_criteria,
  'Measure ' || trial_id || ': first | Second: ' as primary_outcome_measure, study_type from t""")
def flatten_records(spark, sf):
    """Records are nested into JSON text first, then flattened without knowing their paths."""
    key = F.col("trial_id")
    status = F.get(F.array(*[F.lit(s) for s in STATUS]), (key % 5).cast("int"))
    outcome = lambda m, d: F.struct(m.alias("measure"), d.alias("description"))
    nested = F.struct(
        F.struct(
            F.struct(
                F.concat(F.lit("NCT"), key.cast("string")).alias("nctId"),
                F.col("official_title").alias("officialTitle"),
            ).alias("identification"),
            F.struct(status.alias("overallStatus")).alias("status"),
            F.struct(
                F.col("study_type").alias("studyType"),
                F.array(F.concat(F.lit("PHASE"), F.col("phase_encoded").cast("int").cast("string"))).alias("phases"),
                F.struct(F.struct(F.col("enrollment_count").alias("count")).alias("enrollmentCount")).alias("size"),
            ).alias("design"),
            F.array(
                F.struct(F.lit("arm").alias("kind"), F.lit(None).cast("string").alias("briefSummary")),
                F.struct(
                    F.lit("summary").alias("kind"),
                    F.concat("study_type", F.lit(" study")).alias("briefSummary"),
                ),
            ).alias("parts"),
            F.struct(
                F.struct(F.col("eligibility_criteria").alias("text")).alias("eligibilityCriteria")
            ).alias("eligibility"),
            F.array(
                outcome(F.concat(F.lit("Measure "), key.cast("string")), F.lit("first")),
                outcome(F.lit("Second"), F.lit(None).cast("string")),
            ).alias("primaryOutcomes"),
            F.array_repeat(F.lit("condition"), F.col("condition_count").cast("int")).alias("conditions"),
        ).alias("protocol"),
        F.col("has_expanded_access").alias("hasExpandedAccess"),
    )
    return records.flatten_records(t(spark, sf).select(F.to_json(nested).alias("record")), "record")


@query("""select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R'""")
def parquet_scan(spark, sf):
    rows = scan(spark, f"{sf}/lineitem.parquet").filter(F.col("l_returnflag") == "R")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def parquet_sink(spark, sf):
    folder = shared_folder(spark)
    sink(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), folder, ["o_orderstatus"])
    return scan(spark, folder).filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query(f"""with {T}, u as (select trial_id, case when trial_id % 4 = 0 then null else official_title end as title,
  concat_ws(chr(10) || chr(10), '--- DETAILED DESCRIPTION ---' || chr(10) || nullif(full_text, ''),
   '--- ELIGIBILITY CRITERIA ---' || chr(10) || nullif(eligibility_criteria, '')) as body,
  enrollment_count, phase_encoded::INTEGER::VARCHAR as phase from t)
select trial_id::VARCHAR as trial_id, coalesce(nullif(title, ''), substr(split_part({sql_strip('body')}, chr(10), 1), 1, 150)) as title,
  md5(body) as body_md5, enrollment_count::INTEGER as enrollment,
  case when contains(phase, '1') then 'Phase 1' when contains(phase, '3') then 'Phase 3' when contains(phase, '4') then 'Phase 4' else 'Phase 2' end as phase,
  contains(lower(body), 'multicenter') or contains(lower(body), 'multi-center') as multicenter, contains(lower(body), 'placebo') as has_placebo
from u""")
def csv_records_scan(spark, sf):
    folder = shared_folder(spark)
    upload = t(spark, sf).select(
        "trial_id",
        F.when(F.col("trial_id") % 4 != 0, F.col("official_title")).alias("Study Title"),
        F.col("full_text").alias("Detailed Description"),
        F.col("eligibility_criteria").alias("Eligibility Criteria"),
        F.format_number("enrollment_count", 0).alias("Enrollment"),
        F.concat(F.lit("PHASE"), F.col("phase_encoded").cast("int").cast("string")).alias("Phases"),
    )
    records.write_csv(upload, folder)
    found = records.csv_records(records.read_csv(spark, folder, line_breaks=True), keep=["trial_id"])
    return found.withColumn("body_md5", F.md5("text")).drop("text")


@query(f"""with {T} select 'S' || trial_id as id, case when trial_id % 3 = 0 then
    coalesce(nullif(substr(split_part({sql_strip('full_text')}, chr(10), 1), 1, 150), ''), '') else official_title end as title,
  full_text as text, (case when trial_id % 2 = 0 then enrollment_count else 100 end)::INTEGER as enrollment,
  case when phase_encoded in (1, 3, 4) then 'Phase ' || phase_encoded::INTEGER else 'Phase 2' end as phase,
  contains(lower(full_text), 'multicenter') or contains(lower(full_text), 'multi-center') as multicenter,
  contains(lower(full_text), 'placebo') as has_placebo from t""")
def bundle_scan(spark, sf):
    """Each record is a bundle: another resource first, then the study, then a second study."""
    folder = shared_folder(spark)
    key = F.col("trial_id")
    study = F.struct(
        F.lit("ResearchStudy").alias("resourceType"),
        F.concat(F.lit("S"), key.cast("string")).alias("id"),
        F.when(key % 3 != 0, F.col("official_title")).alias("title"),
        F.when(key % 5 == 0, "").otherwise(F.col("full_text")).alias("description"),
        F.col("full_text").alias("objective"),
        F.array(F.struct(F.when(key % 2 == 0, F.col("enrollment_count")).alias("actual"))).alias("enrollment"),
        F.concat(F.lit("phase-"), F.col("phase_encoded").cast("int").cast("string")).alias("phase"),
    )
    other = study.withField("resourceType", F.lit("Organization")).withField("id", F.lit("none"))
    second = study.withField("id", F.lit("second"))
    entries = F.array(*[F.struct(s.alias("resource")) for s in (other, study, second)])
    rows = t(spark, sf).select(F.lit("Bundle").alias("resourceType"), entries.alias("entry"))
    # Compressed files are read whole by one task, so each holds a bounded number of bundles.
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", 10_000).json(folder)
    return records.bundle_scan(spark, folder, multi_line=False)


@query(f"""select substr(split_part({sql_strip('text')}, chr(10), 1), 1, 150) as title, md5(text) as text_md5, length(text)::INTEGER as n_chars from documents""")
def text_scan(spark, sf):
    """One file per document is written, and read as one record each.

    The files are read some folders at a time, and the driver lists no others meanwhile.
    """
    folder, found = shared_folder(spark), shared_folder(spark)
    folders = records.write_texts(documents(spark, sf).select("text"), folder)
    spark.createDataFrame([], "title string, text_md5 string, n_chars int").write.parquet(found)
    for first in range(0, len(folders), FOLDERS):
        read = records.text_scan(spark, folders[first : first + FOLDERS])
        read = read.withColumn("body", F.expr("left(text, length(text) - 1)"))
        read = read.select("title", F.md5("body").alias("text_md5"), F.length("body").alias("n_chars"))
        read.write.mode("append").parquet(found)
        # The driver's handles on a listing stand in cycles, and hold it until these are collected.
        del read
        gc.collect()
    return scan(spark, found)


ENTRY = "trial_id bigint, title string, probability double, risk_tier string, sections array<struct<section: string, contribution: double>>"


def entries(spark, sf):
    p = (F.col("trial_id") * 37 % 1000).cast("double") / 1000.0
    section = lambda n, c: F.struct(F.lit(n).alias("section"), c.alias("contribution"))
    return t(spark, sf).select(
        "trial_id",
        F.col("official_title").alias("title"),
        p.alias("probability"),
        scoring.risk_tier(p, X.THRESHOLD).alias("risk_tier"),
        F.array(section("Eligibility criteria", p - 0.5), section("Study design", p * 0.25)).alias("sections"),
    )


ENTRY_SQL = f"""{T}, e as (select trial_id, official_title as title, ((trial_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE as probability from t)
select trial_id, title, probability, {X.sql_tier('probability', X.THRESHOLD)} as risk_tier, unnest(['Eligibility criteria', 'Study design']) as section,
  unnest([probability - 0.5::DOUBLE, probability * 0.25::DOUBLE]) as contribution from e"""


def exploded(rows):
    return rows.select("trial_id", "title", "probability", "risk_tier", F.explode("sections").alias("s")).select(
        "trial_id", "title", "probability", "risk_tier", "s.*"
    )


@query(f"with {ENTRY_SQL}")
def json_artifact_sink(spark, sf):
    folder = shared_folder(spark)
    artifacts.json_artifact_sink(entries(spark, sf), folder)
    return exploded(artifacts.json_artifact_scan(spark, folder, ENTRY))


@query(f"with {ENTRY_SQL}")
def json_artifact_scan(spark, sf):
    """Caches stored as objects keyed by record id, one object per line."""
    folder = shared_folder(spark)
    rows = entries(spark, sf)
    keyed = F.map_from_arrays(
        F.array(F.col("trial_id").cast("string")), F.array(F.struct(*[F.col(c) for c in rows.columns]))
    )
    rows.select(F.to_json(keyed).alias("value")).write.text(folder)
    return exploded(artifacts.keyed_cache_scan(spark, folder, ENTRY, whole_files=False).drop("key"))


BENCH_SQL = f"""b as (select event_type as device, (user_id % 4 * 8 + 8)::INTEGER as batch_size, {r('sum(value)', 3)} as total_seconds,
  count(*) as n from events group by all)"""


def bench_table(spark, sf):
    return table(spark, sf, "events").groupBy(
        F.col("event_type").alias("device"), (F.col("user_id") % 4 * 8 + 8).cast("int").alias("batch_size")
    ).agg(numbers.half_up(F.sum("value"), 3).alias("total_seconds"), F.count(F.lit(1)).alias("n"))


@query(f"with {BENCH_SQL} select * from b")
def csv_sink(spark, sf):
    folder = shared_folder(spark)
    records.write_csv(bench_table(spark, sf), folder)
    return records.read_csv(spark, folder, "device string, batch_size int, total_seconds double, n bigint")


@query(f"with {BENCH_SQL} select device, sum(n)::BIGINT as n, max(total_seconds) as longest from b group by 1")
def csv_scan(spark, sf):
    folder = shared_folder(spark)
    records.write_csv(bench_table(spark, sf), folder)
    rows = records.read_csv(spark, folder, "device string, batch_size int, total_seconds double, n bigint")
    return rows.groupBy("device").agg(F.sum("n").alias("n"), F.max("total_seconds").alias("longest"))


@query("select vec_id, unnest(range(64))::INTEGER as place, unnest(embedding) as value from embeddings")
def vector_sink(spark, sf):
    folder = shared_folder(spark)
    artifacts.vector_sink(table(spark, sf, "embeddings").select("vec_id", "embedding"), folder)
    return artifacts.vector_scan(spark, folder, "embedding").select("vec_id", F.posexplode("embedding").alias("place", "value"))


@query(f"select vec_id, label, {r('list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])', 6)} as squared_norm from embeddings")
def vector_scan(spark, sf):
    rows = artifacts.vector_scan(spark, f"{sf}/embeddings.parquet", "embedding")
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "label", numbers.half_up(squared, 6).alias("squared_norm"))


def _sql_number(name, low, high):
    return f"({low} + ('0x' || substr(md5(k || ':{name}:42'), 1, 8))::BIGINT % {high - low})::VARCHAR"


def _sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


#: Notes of a warehouse, for rows of orders.
NOTES = [
    "Pallet {pallet} of {good} waits at gate {gate} for the {carrier}.",
    "{carrier} took {boxes} boxes of {good}; the seals were whole.",
    "Count of {good} differs by {boxes}: see the list of gate {gate}.",
]
NOTE_WORDS = {"good": ["salt", "oak boards", "baker's yeast", "lamp oil"], "carrier": ["night train", "barge", "ox cart", "post coach", "mule"]}
NOTE_RANGES = {"pallet": (100, 1000), "gate": (1, 9), "boxes": (2, 60)}


def _sql_notes():
    filled = f"{_sql_list(NOTES)}[(k % {len(NOTES)} + 1)::INTEGER]"
    values = {n: f"{_sql_list(w)}[(k % {len(w)} + 1)::INTEGER]" for n, w in NOTE_WORDS.items()}
    values |= {n: _sql_number(n, *ends) for n, ends in NOTE_RANGES.items()}
    for name, value in values.items():
        filled = f"replace({filled}, '{{{name}}}', {value})"
    return filled


@query(f"with k as (select o_orderkey, o_orderkey as k from orders) select o_orderkey, {_sql_notes()} as text from k")
def synth_texts(spark, sf):
    return samples.synth_texts(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", NOTES, NOTE_WORDS, NOTE_RANGES)
