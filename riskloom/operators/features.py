"""The feature table, its scaler and the term vectors."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from riskloom import constants as C
from riskloom.functions import coding, numbers, text
from riskloom.operators.aggregates import (
    default_medians,
    impute_group_median,
    median_by_group,
    standard_scaler_fit,
)
from riskloom.plans.lookup import fitted_table


@dataclass(frozen=True)
class FeatureSpec:
    """Words, delimiter and column names the features are made from."""

    key: str = "trial_id"
    label: str = C.LABEL
    outcome: Sequence[str] = ("primaryOutcomeMeasure", "primary_outcome_measure")
    outcome_delimiter: str = ";"
    age_words: Sequence[str] = field(default_factory=lambda: list(C.AGE_WORDS))
    placebo_words: Sequence[str] = field(default_factory=lambda: list(C.PLACEBO_WORDS))
    randomized_words: Sequence[str] = field(default_factory=lambda: list(C.RANDOMIZED_WORDS))
    multicenter_words: Sequence[str] = field(default_factory=lambda: list(C.MULTICENTER_WORDS))


def standard_inputs(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The columns features need, from whichever alias the table has, without nulls."""

    def pick(names, default):
        return coding.coalesce_alias(rows, list(names), default)

    return rows.select(
        spec.key,
        *([F.col(spec.label).cast("int").alias(spec.label)] if spec.label in rows.columns else []),
        pick(["phase_encoded"], C.DEFAULT_PHASE_CODE).cast("double").alias("phase_encoded"),
        pick(["enrollment_count"], 0).cast("double").alias("enrollment_count"),
        pick(["has_expanded_access"], False).cast("int").alias("has_expanded_access"),
        pick(["condition_count"], 0).cast("double").alias("condition_count"),
        pick(C.SECTION_ALIASES["official_title"], "").alias("_title"),
        pick(C.SECTION_ALIASES["eligibility_criteria"], "").alias("_criteria"),
        pick(spec.outcome, "").alias("_outcome"),
        pick(C.SECTION_ALIASES["study_type"], "").alias("_study_type"),
        F.lower(pick(["full_text"], "")).alias("_text"),
    )


def fit_medians(rows: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Fitted median size per phase, reused as it is when scoring."""
    sizes = rows.select(
        coding.coalesce_alias(rows, ["phase_encoded"], C.DEFAULT_PHASE_CODE)
        .cast("double")
        .alias("phase_encoded"),
        coding.coalesce_alias(rows, ["enrollment_count"], 0).cast("double").alias("enrollment_count"),
    )
    medians = fitted_table(median_by_group(sizes, "phase_encoded", "enrollment_count"))
    return default_medians(rows, "phase_encoded") if medians.isEmpty() else medians


def engineer_features(
    rows: DataFrame, medians: DataFrame | None = None, spec: FeatureSpec = FeatureSpec()
) -> DataFrame:
    """All 15 features of every record in one narrow pass.

    The only other pass is the median fit; pass fitted ``medians`` to skip it.
    Training and scoring call this same function.
    """
    if medians is None:
        medians = fit_medians(rows, spec)
    inputs = standard_inputs(rows, spec).withColumn("_words", text.words(F.col("_criteria")))
    sized = impute_group_median(inputs, medians, "phase_encoded", "enrollment_count", "_size")
    counted = sized.select(
        "*",
        text.word_count(F.col("_title")).cast("double").alias("title_length"),
        F.size("_words").cast("double").alias("criteria_length"),
        text.delimiter_count(F.col("_outcome"), spec.outcome_delimiter)
        .cast("double")
        .alias("outcome_count"),
    )
    kept = [c for c in (spec.key, spec.label) if c in counted.columns]
    return counted.select(
        *kept,
        "phase_encoded",
        numbers.log_size(F.col("_size")).alias("log_enrollment"),
        "has_expanded_access",
        "condition_count",
        "title_length",
        "criteria_length",
        "outcome_count",
        text.keyword_flag(F.col("_criteria"), spec.age_words).alias("has_age_restriction"),
        coding.equals_flag(F.col("_study_type"), "INTERVENTIONAL").alias("is_interventional"),
        text.keyword_flag(F.col("_text"), spec.placebo_words, True).alias("has_placebo"),
        text.keyword_flag(F.col("_text"), spec.randomized_words, True).alias("has_randomized"),
        text.keyword_flag(F.col("_text"), spec.multicenter_words, True).alias("has_multicenter"),
        text_complexity(
            F.col("criteria_length"), F.col("title_length"), F.col("outcome_count")
        ).alias("text_complexity"),
        coding.enrollment_ratio(F.col("_size"), F.col("phase_encoded")).alias("enrollment_ratio"),
        text.unique_ratio_of(F.col("_words")).alias("criteria_unique_ratio"),
    )


def text_complexity(criteria: Column, title: Column, outcomes: Column) -> Column:
    return (criteria + title).cast("double") / (outcomes + 1).cast("double")


Scaler = Mapping[str, tuple[float, float]]


def fit_scaler(features: DataFrame, columns: Sequence[str] = tuple(C.SCALED_FEATURES)) -> Scaler:
    """Mean and deviation of each scaled column: one row per column of the schema."""
    fitted = standard_scaler_fit(features, columns).collect()
    return {r["column"]: (r["mean"] or 0.0, r["std"] or 1.0) for r in fitted}


def scaled_column(name: str, scaler: Scaler, value: Column | None = None) -> Column:
    value = F.col(name) if value is None else value
    if name not in scaler:
        return value.cast("double")
    mean, std = scaler[name]
    return (value.cast("double") - F.lit(mean)) / F.lit(std)


def scale_features(
    features: DataFrame,
    scaler: Scaler,
    columns: Sequence[str] = tuple(C.FEATURES),
    keep: Sequence[str] = ("trial_id", C.LABEL),
) -> DataFrame:
    """Feature columns in model order, scaled where fitted; an absent one is 0."""
    present = set(features.columns)
    return features.select(
        *[c for c in keep if c in present],
        *[
            (scaled_column(c, scaler) if c in present else scaled_column(c, scaler, F.lit(0.0))).alias(c)
            for c in columns
        ],
    )


def feature_matrix(
    features: DataFrame,
    label: str = C.LABEL,
    keep: Sequence[str] = ("trial_id",),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Split a feature table into a vector column and a label column."""
    names = list(columns or [c for c in features.columns if c != label and c not in keep])
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(features)
    labels = [F.col(label).cast("double").alias("label")] if label in features.columns else []
    return assembled.select(*[c for c in keep if c in features.columns], *labels, "features")


def scaled_vector(
    features: DataFrame, scaler: Scaler, columns: Sequence[str] = tuple(C.FEATURES), output: str = "features"
) -> DataFrame:
    """Add the scaled feature vector beside the unscaled columns."""
    values = F.array(*[scaled_column(c, scaler) for c in columns])
    return features.withColumn(output, array_to_vector(values))


# --- term vectors ----------------------------------------------------------

#: Lists and terms that a task counts at a time; their codes, with the list, must fit 63 bits.
HELD_TERMS = 2_000_000


def document_terms(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Key, the ``singles`` of a text, and the list of these and neighbouring pairs as ``terms``."""
    singles = rows.select(key, body).withColumn("singles", text.terms(F.col(body)))
    return _with_pairs(singles, "singles").drop(body)


def with_terms(rows: DataFrame, body: str) -> DataFrame:
    """Add the single terms and neighbouring pairs of a text as ``terms``."""
    return _with_pairs(rows.withColumn("_t", text.terms(F.col(body))), "_t").drop("_t")


def _with_pairs(rows: DataFrame, singles: str) -> DataFrame:
    pairs = NGram(n=2, inputCol=singles, outputCol="_pairs").transform(rows)
    return pairs.withColumn("terms", F.concat(singles, "_pairs")).drop("_pairs")


def doc_frequency(documents: DataFrame, among: Collection[str] | None = None) -> DataFrame:
    """Documents and occurrences per term; if ``among`` is given, only of its terms and of pairs of two of them.

    A task counts the terms of some documents at a time, as numbers, and sends
    one row per distinct term of theirs, so no row is made per occurrence and no
    (document, term) pair is shuffled. Where ``singles`` stand beside ``terms``,
    neighbouring pairs are counted from them, and no list of pairs is made.
    """
    pairs = "singles" in documents.columns
    wanted = None if among is None else pa.array(list(among), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in _some_lists(batch.column(0)):
                for counts in _counted_terms(lists, pairs, wanted):
                    yield from counts.to_batches(max_chunksize=1 << 16)

    lists = documents.select(F.col("singles" if pairs else "terms").cast("array<string>"))
    # Dealt first: few rows of a task are alike by now, so adding them up before would not pay.
    counts = lists.mapInArrow(count, "term string, df long, total long").repartition("term")
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _some_lists(lists: pa.ListArray, most: int = HELD_TERMS) -> Iterator[pa.ListArray]:
    """The same lists, some at a time: ``most`` of lists and entries, one list at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(lists):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lists.slice(first, last - first)
        first = last


def _counted_terms(lists: pa.ListArray, pairs: bool, among: pa.Array | None = None) -> Iterator[pa.Table]:
    """(term, df, total) of the entries of some lists, and of their neighbouring pairs; if given, ``among`` some only."""
    coded = lists.flatten().dictionary_encode("encode")
    names, size, many = coded.dictionary, len(coded.dictionary), len(lists)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    named = np.ones(size, bool) if among is None else pc.is_in(names, among).to_numpy(zero_copy_only=False)
    named = named[codes]
    found, df, total = _counted_codes(codes[named], owner[named], many)
    yield pa.table({"term": names.take(pa.array(found)), "df": df, "total": total})
    if pairs:
        # A pair is one number: that of its first term, then that of its second.
        inside = (owner[1:] == owner[:-1]) & named[1:] & named[:-1]
        found, df, total = _counted_codes((codes[:-1] * size + codes[1:])[inside], owner[1:][inside], many)
        left, right = (names.take(pa.array(side)) for side in np.divmod(found, max(1, size)))
        yield pa.table({"term": pc.binary_join_element_wise(left, right, " "), "df": df, "total": total})


def _counted_codes(codes: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, with the owners and the occurrences of each; there are ``many`` owners."""
    held = np.sort(codes * many + owner)
    codes = held // max(1, many)
    bounds = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(held))
    owners = np.append(0, np.cumsum(np.diff(held, prepend=-1) != 0))
    return codes[bounds[:-1]], np.diff(owners[bounds]), np.diff(bounds)


def vocab_topk(frequencies: DataFrame, size: int = C.MAX_TERMS, min_df: int = C.MIN_DOC_FREQ) -> DataFrame:
    """The most frequent terms that enough documents hold."""
    common = frequencies.filter(F.col("df") >= min_df)
    return common.orderBy(F.desc("total"), F.asc("term")).limit(size)


def _candidates(documents: DataFrame, size: int, min_df: int) -> list[str] | None:
    """Single terms of which the vocabulary and its pairs are made; None where that cannot be told.

    A pair occurs no more often, and in no more documents, than either of its
    terms. With ``size`` single terms in enough documents, no term whose total is
    below the last of theirs is in the vocabulary, so the terms of a pair that is
    have at least that total, too. Where more terms share it than are fetched, all
    are counted.
    """
    if "singles" not in documents.columns:
        return None
    alone = documents.select(F.col("singles").alias("terms"))
    most = vocab_topk(doc_frequency(alone), 2 * size, min_df).collect()
    if len(most) < size:
        return None
    known = [r["term"] for r in most if r["total"] >= most[size - 1]["total"]]
    return known if len(known) < 2 * size else None


def fit_tfidf(
    documents: DataFrame, size: int = C.MAX_TERMS, min_df: int = C.MIN_DOC_FREQ
) -> PipelineModel:
    """Vocabulary, smoothed inverse document frequency and row norm, as ML stages.

    Only the vocabulary (at most ``size`` rows), and twice as many single terms,
    reach the driver. Applying the model is a projection: it never shuffles.
    """
    total = documents.count()
    chosen = vocab_topk(doc_frequency(documents, _candidates(documents, size, min_df)), size, min_df)
    weighted = chosen.withColumn("idf", F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0)
    rows = weighted.orderBy("term").select("term", "idf").collect()
    if not rows:
        raise ValueError("no term reaches the document frequency")
    counts = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows],
        inputCol="terms",
        outputCol="_counts",
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_counts", outputCol="_weighted"
    )
    norm = Normalizer(p=2.0, inputCol="_weighted", outputCol="tfidf")
    tidy = SQLTransformer(statement="SELECT * EXCEPT (_counts, _weighted, terms) FROM __THIS__")
    return Pipeline(stages=[counts, weigh, norm, tidy]).fit(documents)


def vocabulary_terms(documents: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Documents with, as ``terms``, only those of a vocabulary: all that its vectors count.

    They are looked up in ``singles``, so no list of all pairs is made.
    """
    kept = [f for f in documents.schema.fields if f.name not in ("singles", "terms")]
    names = pa.array(list(vocabulary), pa.string())
    words = sorted({word for term in vocabulary for word in term.split(" ")})
    # A single term is its word's number, a pair that of its first word after all of them, times the words, and its second's.
    number = {word: i for i, word in enumerate(words)}
    parts = [[number[word] for word in term.split(" ")] for term in vocabulary]
    codes = np.array([own[0] if len(own) == 1 else (own[0] + 1) * len(words) + own[1] for own in parts], np.int64)
    order = np.argsort(codes)
    codes = codes[order]

    def listed(lists: pa.ListArray) -> pa.ListArray:
        found = pc.fill_null(pc.index_in(lists.flatten(), pa.array(words, pa.string())), -1)
        word = found.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        pair = np.flatnonzero((owner[1:] == owner[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
        known = np.flatnonzero(word >= 0)
        held = np.concatenate([word[known], (word[pair] + 1) * len(words) + word[pair + 1]])
        owner = np.concatenate([owner[known], owner[pair]])
        at = np.minimum(np.searchsorted(codes, held), len(codes) - 1)
        there = codes[at] == held
        at, owner = order[at[there]], owner[there]
        ends = np.cumsum(np.bincount(owner, minlength=len(lists)))
        terms = names.take(pa.array(at[np.argsort(owner, kind="stable")]))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), terms)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for lists in _some_lists(batch.column(len(kept))):
                own = batch.slice(first, len(lists)).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*own, listed(lists)], [*(f.name for f in kept), "terms"])
                first += len(lists)

    schema = StructType([*kept, StructField("terms", ArrayType(StringType()))])
    return documents.select(*(f"`{f.name}`" for f in kept), "singles").mapInArrow(look_up, schema)


def tfidf_long(vectors: DataFrame, vocabulary: Sequence[str], key: str, vector: str = "tfidf") -> DataFrame:
    """Non-zero weights as rows (key, term, weight), straight from the sparse vectors."""
    raw = F.unwrap_udt(F.col(vector))
    names = F.array(*[F.lit(t) for t in vocabulary])
    entries = F.arrays_zip(
        F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1)).alias("i"),
        raw["values"].alias("w"),
    )
    return (
        vectors.select(key, F.explode(entries).alias("_e"))
        .filter("_e.w <> 0")
        .select(key, F.get(names, F.col("_e.i")).alias("term"), F.col("_e.w").alias("tfidf"))
    )


def vocabulary_of(model: PipelineModel) -> list[str]:
    return model.stages[0].vocabulary
