"""Landed record files: result pages, nested records, CSV, bundles and plain text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as C
from riskloom.functions import coding, numbers, text
from riskloom.plans.ranges import range_cuts, running_totals
from riskloom.plans.spread import gathered


# --- result pages ----------------------------------------------------------


def harvest_pages(
    spark: SparkSession,
    path: str,
    study_schema: str,
    target_count: int | None = None,
    key: str | None = None,
) -> DataFrame:
    """Records of landed result pages ``{term, page, studies, nextPageToken}``.

    ``target_count`` stops between pages, in term and page order, once enough
    records came before; only page sizes are ordered for that, range by range.
    With a ``key``, a record that several terms returned counts once, as the
    first of them in term, page and list order gives it.
    """
    schema = f"term int, page int, studies array<{study_schema}>, nextPageToken string"
    pages = spark.read.schema(schema).json(path)
    if target_count is not None:
        place = F.col("term") * 1_000_000_000.0 + F.col("page")
        sizes = pages.select("term", "page", place.alias("_place"), F.size("studies").cast("bigint").alias("n"))
        counted = running_totals(sizes, "_place", ["n"], cuts=range_cuts(sizes, "_place"))
        kept = counted.filter(F.col("n_before") < target_count).select("term", "page")
        pages = pages.join(kept, ["term", "page"], "left_semi")
    studies = pages.select("term", "page", F.posexplode("studies").alias("_place", "_s"))
    if key:
        first = F.min_by("_s", F.struct("term", "page", "_place")).alias("_s")
        studies = studies.groupBy(F.col("_s").getField(key).alias("_key")).agg(first)
    return studies.select("_s.*")


# --- nested records --------------------------------------------------------


@dataclass
class Shape:
    """What a VARIANT column holds: fields of its objects, elements of its lists."""

    fields: dict[str, Shape] = field(default_factory=dict)
    element: Shape | None = None


def variant_shape(rows: DataFrame, column: str) -> Shape:
    """Merged shape of all values of a VARIANT column, from one aggregate.

    Where values differ in kind (text here, an object there), the objects and
    the lists of that one place are merged apart, in one more aggregate.
    """
    values = rows.select(F.col(column).alias("v"))
    return _shape_of(values, _merged(values.agg(F.schema_of_variant_agg("v")).first()[0]))


def _merged(schema: str | None) -> T.DataType:
    # Names of fields stand in back-ticks and stay as they are.
    named = r"(`(?:[^`]|``)*`)|OBJECT<"
    return T.DataType.fromDDL(re.sub(named, lambda m: m[1] or "STRUCT<", schema or "VOID"))


def _shape_of(values: DataFrame, kind: T.DataType) -> Shape:
    shape = Shape()
    if isinstance(kind, T.VariantType):
        of = lambda start: F.schema_of_variant_agg(
            F.when(F.startswith(F.schema_of_variant("v"), F.lit(start)), F.col("v"))
        )
        objects, lists = values.agg(of("OBJECT").alias("o"), of("ARRAY").alias("a")).first()
        shape = _shape_of(values, _merged(objects))
        shape.element = _shape_of(values, _merged(lists)).element
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            inside = values.select(F.try_variant_get(*_below(F.col("v"), "$", f.name), "variant").alias("v"))
            shape.fields[f.name] = _shape_of(inside, f.dataType)
    elif isinstance(kind, T.ArrayType):
        inside = values.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
        shape.element = _shape_of(inside, kind.elementType)
    return shape


def _below(root: Column, path: str, name: str) -> tuple[Column, str]:
    """Where a field lies; a name that no path can spell is looked up in a map of the fields."""
    if name and not set("'?") & set(name):
        return root, f"{path}['{name}']"
    fields = F.try_variant_get(root, path, "map<string, variant>")
    return F.try_element_at(fields, F.lit(name)), "$"


def find_key(value: Column, shape: Shape, key: str) -> Column:
    """First value of a key anywhere in a VARIANT, as VARIANT.

    A hit at a level wins over deeper ones; siblings follow in key order, and a
    null hit hands over to the next sibling. The paths come from the merged
    shape, so every record runs the same compiled expression.
    """
    return F.coalesce(*_hits(value, "$", shape, key), F.lit(None).cast("variant"))


def _hits(root: Column, path: str, shape: Shape, key: str) -> list[Column]:
    """Places of a key under a path, in search order."""
    hits = []
    if key in shape.fields:
        hits.append(F.try_variant_get(*_below(root, path, key), "variant"))
    for name, inner in sorted(shape.fields.items()):
        if name == key:
            continue
        base, below = _below(root, path, name)
        deeper = _hits(base, below, inner, key)
        if deeper:
            hits.append(_known(F.coalesce(*deeper)))
        if inner.element and _hits(root, "$", inner.element, key):
            items = F.try_variant_get(base, below, "array<variant>")
            found = F.transform(items, _in_element(inner.element, key))
            hits.append(F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0)))
    return hits


def _in_element(shape: Shape, key: str):
    return lambda value: _known(F.coalesce(*_hits(value, "$", shape, key)))


def _known(value: Column) -> Column:
    """A VARIANT null as an SQL null."""
    return F.when(~F.is_variant_null(value), value)


RECORD_SCHEMA = """
    nctId string, overallStatus string,
    eligibilityCriteria variant, briefSummary variant, officialTitle string,
    primaryOutcomes array<struct<measure: string, description: string>>,
    enrollmentCount variant, phases array<string>, studyType string,
    hasExpandedAccess boolean, conditions array<string>
"""


def flatten_records(rows: DataFrame, column: str) -> DataFrame:
    """Flat record table from nested JSON text of unknown depth.

    The sections stay in columns of their own beside the joined text.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(column))
    shape = variant_shape(parsed, "_v")

    def get(key: str, target: str) -> Column:
        found = find_key(F.col("_v"), shape, key)
        return found if target == "variant" else F.try_variant_get(found, "$", target)

    wanted = T.DataType.fromDDL(RECORD_SCHEMA)
    fields = parsed.select(
        *[get(f.name, f.dataType.simpleString()).alias(f.name) for f in wanted.fields]
    )
    return flat_record_table(fields)


def flat_record_table(fields: DataFrame) -> DataFrame:
    """The record table from its raw fields."""
    criteria = F.coalesce(coding.struct_or_scalar(F.col("eligibilityCriteria"), "text", "string"), F.lit(""))
    summary = F.coalesce(coding.struct_or_scalar(F.col("briefSummary"), "text", "string"), F.lit(""))
    outcomes = coding.flatten_outcomes(F.col("primaryOutcomes"))
    title = F.coalesce("officialTitle", F.lit(""))
    size = F.coalesce(coding.struct_or_scalar(F.col("enrollmentCount"), "count", "bigint"), F.lit(0))
    return fields.select(
        F.coalesce("nctId", F.lit("")).alias("nct_id"),
        coding.status_label(F.col("overallStatus")).alias("terminated"),
        text.concat_nonempty([title, summary, criteria, outcomes]).alias("full_text"),
        size.cast("bigint").alias("enrollment_count"),
        coding.phase_encode(F.col("phases")).alias("phase_encoded"),
        F.coalesce("hasExpandedAccess", F.lit(False)).alias("has_expanded_access"),
        coding.size_or_one(F.col("conditions"), T.ArrayType(T.StringType())).alias("condition_count"),
        title.alias("official_title"),
        criteria.alias("eligibility_criteria"),
        outcomes.alias("primary_outcome_measure"),
        F.coalesce("studyType", F.lit("")).alias("study_type"),
    )


# --- uploads ---------------------------------------------------------------


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header, every value as text unless a schema is given.

    Files are split among tasks. ``line_breaks`` allows quoted line breaks; a
    file is then read by one task, since no task can tell where a line ends.
    """
    reader = spark.read.options(
        header=True,
        multiLine=line_breaks,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        nullValue="",
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        nullValue="",
        emptyValue='""',
    ).csv(path)


def csv_records(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Title, text, size, phase and flags of uploaded rows, from candidate columns."""
    present = [c for c in C.UPLOAD_TEXT_COLUMNS if c in rows.columns]

    def value(name: str) -> Column:
        known = F.col(f"`{name}`")
        return F.when(F.lower(text.strip(known)) != "nan", known)

    blocks = text.section_blocks({c: value(c) for c in present})
    whole_row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    body = F.coalesce(F.nullif(blocks, F.lit("")), whole_row) if present else whole_row
    title = coding.coalesce_alias(rows, C.UPLOAD_TITLE_COLUMNS, "")
    staged = rows.select(
        *keep,
        body.alias("text"),
        F.nullif(title, F.lit("")).alias("_title"),
        coding.coalesce_alias(rows, C.UPLOAD_ENROLLMENT_COLUMNS, str(C.DEFAULT_ENROLLMENT)).alias("_size"),
        coding.coalesce_alias(rows, C.UPLOAD_PHASE_COLUMNS, "2").alias("_phase"),
        *[
            coding.coalesce_alias(rows, [f"has_{flag}", flag], None).try_cast("boolean").alias(f"_{flag}")
            for flag in ("multicenter", "placebo")
        ],
    )
    return staged.select(
        *keep,
        F.coalesce("_title", first_line(F.col("text"))).alias("title"),
        "text",
        numbers.parse_number(F.col("_size"), C.DEFAULT_ENROLLMENT).alias("enrollment"),
        coding.phase_parse(F.col("_phase"), "first").alias("phase"),
        coding.flag_or_text(
            F.col("_multicenter"), F.lower("text"), ["multicenter", "multi-center"], ["multicenter"]
        ).alias("multicenter"),
        coding.flag_or_text(F.col("_placebo"), F.lower("text"), ["placebo"], ["placebo"]).alias("has_placebo"),
    )


def first_line(body: Column, width: int = 150) -> Column:
    """First line of the stripped text; what follows the line is looked at as far as its first word."""
    blank = text.BLANK
    # White space at the line's end stays where the text goes on behind it.
    line = rf"(?U)\A[{blank}]*+([^\n]*+(?=\n[{blank}]*+[^{blank}])|[^\n]*[^{blank}]|)"
    return F.substring(F.regexp_extract(body, line, 1), 1, width)


BUNDLE_SCHEMA = """
    resourceType string, title string, description string, objective string,
    enrollment array<struct<actual: bigint>>, enrollment_count bigint, phase string,
    entry array<struct<resource: struct<
        resourceType: string, id: string, title: string, description: string, objective: string,
        enrollment: array<struct<actual: bigint>>, enrollment_count: bigint, phase: string>>>,
    id string
"""


def bundle_records(documents: DataFrame, wanted: str = "ResearchStudy") -> DataFrame:
    """Study fields of JSON documents; of a bundle, its first study resource.

    Picking the first matching array element is a projection, so a large bundle
    is never exploded.
    """
    study = F.get(
        F.filter(F.col("entry"), lambda e: e["resource"]["resourceType"] == wanted), F.lit(0)
    )["resource"]
    names = ["id", "title", "description", "objective", "enrollment", "enrollment_count", "phase"]
    is_bundle = (F.col("resourceType") == "Bundle") & study.isNotNull()
    own = F.struct(*names)
    picked = documents.select(
        F.when(is_bundle, F.struct(*[study[n].alias(n) for n in names])).otherwise(own).alias("_s")
    ).select("_s.*")
    body = F.coalesce(F.nullif("description", F.lit("")), "objective", F.lit(""))
    # A listed enrollment without an actual number leaves the default; the plain
    # count stands only where nothing is listed.
    listed = F.get("enrollment", F.lit(0))
    size = F.when(
        F.coalesce(F.size("enrollment"), F.lit(0)) > 0,
        F.coalesce(listed["actual"], F.lit(C.DEFAULT_ENROLLMENT)),
    ).otherwise(F.coalesce("enrollment_count", F.lit(C.DEFAULT_ENROLLMENT)))
    return picked.select(
        "id",
        F.coalesce(F.nullif("title", F.lit("")), first_line(body)).alias("title"),
        body.alias("text"),
        size.cast("int").alias("enrollment"),
        coding.phase_parse(F.col("phase"), "last").alias("phase"),
        text.has_any(body, ["multicenter", "multi-center"]).alias("multicenter"),
        text.has_any(body, ["placebo"]).alias("has_placebo"),
    )


def bundle_scan(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return bundle_records(spark.read.schema(BUNDLE_SCHEMA).json(path, multiLine=multi_line))


#: Files that one folder of ``write_texts`` holds at most.
FOLDER_FILES = 1_000


def write_texts(rows: DataFrame, path: str, most: int = FOLDER_FILES) -> list[str]:
    """Each row's only column as a text file of its own, ended by a line feed; returns the folders of the files.

    On a file system of the operating system the tasks make the files: Spark's
    writer would start up to four processes and make a second file for each. A
    task writes to folders of its own, and those of the tasks that counted are
    returned, so lost or repeated tasks do no harm. Elsewhere Spark writes.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = store.makeQualified(at)
    if store.exists(at):
        raise FileExistsError(path)
    value = F.col(f"`{rows.columns[0]}`")
    if store.getUri().getScheme() == "file":
        made = rows.select(value.cast("binary")).mapInArrow(_text_files(at.toUri().getPath(), most), "folder string")
        return [f"{at.toString()}/{r.folder}" for r in made.collect()]
    numbered = rows.select(value.alias("value"), F.expr(f"monotonically_increasing_id() div {most}").alias("folder"))
    numbered.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    return [s.getPath().toString() for s in store.listStatus(at) if s.isDirectory()]


def _text_files(root: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for value in (v for batch in batches for v in batch.column(0)):
            if n % most == 0:
                folder = f"{task.partitionId()}-{task.taskAttemptId()}-{n // most}"
                os.makedirs(f"{root}/{folder}")
                yield pa.RecordBatch.from_pydict({"folder": [folder]})
            with open(f"{root}/{folder}/{n}.txt", "wb") as file:
                file.write((value.as_py() or b"") + b"\n")
            n += 1

    return write


def _packed(spark: SparkSession) -> Column:
    """Whether Spark's text reader decompresses a file, by its ending in either case."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    kinds = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    found = F.lit(False)
    for ending in sorted({kind.newInstance().getDefaultExtension().lower() for kind in kinds}):
        found |= F.endswith(F.lower("_metadata.file_name"), F.lit(ending))
    return found


def text_scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every text file as one record, titled by its first line; a task reads many small files.

    Spark's text reader sets up its codecs anew for each file, so it gets only
    the files that it decompresses; which they are is told from the listing.
    """
    paths = [path] if isinstance(path, str) else list(path)
    packed, file = _packed(spark), F.col("_metadata.file_path").alias("path")
    plain, texts = spark.read.format("binaryFile").load(paths), None
    if plain.filter(packed).rdd.getNumPartitions():
        texts = gathered(spark.read.text(paths, wholetext=True).filter(packed).select(file, "value"))
        plain = plain.filter(~packed)
    files = gathered(plain.select(file, F.col("content").cast("string").alias("value")))
    return (files if texts is None else files.unionByName(texts)).select(
        "path",
        first_line(F.col("value")).alias("title"),
        F.col("value").alias("text"),
        text.has_any(F.col("value"), ["multicenter"]).alias("multicenter"),
        text.has_any(F.col("value"), ["placebo"]).alias("has_placebo"),
    )
