"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Texts are cut into batches. A batch asks for the counts of its distinct
n-grams, one row of 64-bit hashes per hash bucket. A bucket sums the counts of
equal n-grams over all batches, which makes the count table of that hash
range, and answers every row in its own order. The answers are joined with
the batch's exploded n-grams and summed per document. A very frequent n-gram
is one number per batch, so no bucket is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskloom.llm.common import as_bytes, partitions, sliced

ORDER = 2
#: n-grams of two words and more that are rarer are not in the model.
LEAST_COUNT = 2
BACKOFF = 0.4
BATCH_BYTES = 8 << 20
START, TOTAL = np.uint64(0x5354415254), np.uint64(0x544F54414C)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its beginning and its last word."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the place of each word in the vocabulary, hashes of the vocabulary.

    Words are lower-cased in A-Z.
    """
    words = [text.lower().split() for text in texts]
    coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    vocabulary = np.array(coded.dictionary.to_pylist(), object)
    hashes = pd.util.hash_array(vocabulary, categorize=False) if len(vocabulary) else np.zeros(0, np.uint64)
    return np.array(list(map(len, words)), np.int64), coded.indices.to_numpy(zero_copy_only=False), hashes


def grams(lengths: np.ndarray, words: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order: hash of the n-gram that ends at each word, and whether there is one.

    The start of a text counts as one word before the first.
    """
    n = len(words)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found = [(words, np.ones(n, bool))]
    for size in range(2, order + 1):
        previous = np.full(n, START, np.uint64)
        previous[1:] = found[-1][0][:-1]
        if size == 2:
            previous[place == 0] = START
        found.append((mixed(previous, words), place >= size - 2))
    return found


def asked(lengths: np.ndarray, words: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a batch in ascending order, and how often each occurs."""
    parts = [hashes[there] for hashes, there in grams(lengths, words, order)]
    starts = np.full(np.count_nonzero(lengths), START, np.uint64)
    hashes, counts = np.unique(np.concatenate([*parts, starts, np.array([TOTAL])]), return_counts=True)
    counts[np.searchsorted(hashes, TOTAL)] = len(words)
    return hashes, counts


def batch_scores(
    lengths: np.ndarray, words: np.ndarray, hashes: np.ndarray, totals: np.ndarray, order: int, least: int, backoff: float
) -> np.ndarray:
    """Log score of every text, from the corpus counts of the batch's n-grams."""
    count = lambda wanted: totals[np.searchsorted(hashes, wanted)]
    all_words = float(count(TOTAL))
    found = grams(lengths, words, order)
    score = np.log(count(words) / all_words) if len(words) else np.zeros(0)
    context = np.full(len(words), START, np.uint64)
    for size in range(2, order + 1):
        gram, there = found[size - 1]
        context = np.roll(found[size - 2][0], 1) if len(words) else context
        if size == 2:
            context[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
        seen = np.zeros(len(words), bool)
        seen[there] = count(gram[there]) >= least
        score = np.where(there & ~seen, score + math.log(backoff), score)
        score[seen] = np.log(count(gram[seen]) / count(context[seen]))
    ends = np.cumsum(np.concatenate([[0], lengths]))
    return np.array([score[a:b].sum() for a, b in zip(ends, ends[1:], strict=False)])


def score(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    least: int = LEAST_COUNT,
    backoff: float = BACKOFF,
) -> DataFrame:
    """(key, n_words, log_score) of every row; null and empty texts have no words and score 0.

    The score of a word is the natural logarithm of the relative frequency of
    the longest n-gram that ends with it and occurs ``least`` times in the
    corpus, less for every shorter step. Every row counts and is scored,
    repeated or not. The rows are read twice and must come in the same
    batches, as rows of files do.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    buckets = 2 * partitions(docs.sparkSession)

    def numbered(batches: Iterator[pa.RecordBatch]):
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(sliced(batches, text, BATCH_BYTES)):
            yield first + k, batch, *word_numbers(as_bytes(batch, text))

    def shares(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (hashes >> np.uint64(20)) % np.uint64(buckets)
        order_ = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order_], np.arange(buckets + 1, dtype=np.uint64))
        return ((b, order_[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, lengths, places, vocabulary in numbered(batches):
            hashes, counts = asked(lengths, vocabulary[places], order)
            out = [(number, b, hashes[own].tobytes(), counts[own].astype("<u4").tobytes()) for b, own in shares(hashes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, type_) for column, type_ in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["batch", "bucket", "grams", "counts"],
            )

    def answer(asked_: pa.Table) -> pa.Table:
        parts = [np.frombuffer(g, "<u8") for g in asked_["grams"].to_pylist()]
        counts = [np.frombuffer(c, "<u4") for c in asked_["counts"].to_pylist()]
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts)).astype("<u8")[inverse]
        ends = np.cumsum([0, *map(len, parts)])
        found = [totals[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"batch": asked_["batch"], "bucket": asked_["bucket"], "totals": pa.array(found, pa.binary())})

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, lengths, places, vocabulary in numbered(batches):
            keys = pa.ListArray.from_arrays([0, batch.num_rows], batch.column(key))
            blobs = [pa.array([v.tobytes()], pa.binary()) for v in (lengths.astype("<u4"), places.astype("<u4"), vocabulary)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), keys, *blobs], ["batch", "keys", "lengths", "places", "vocabulary"])

    def combine(held: pa.Table, answers: pa.Table) -> pa.Table:
        lengths = np.frombuffer(held["lengths"][0].as_py(), "<u4").astype(np.int64)
        vocabulary = np.frombuffer(held["vocabulary"][0].as_py(), "<u8")
        words = vocabulary[np.frombuffer(held["places"][0].as_py(), "<u4")]
        hashes, _ = asked(lengths, words, order)
        totals = np.zeros(len(hashes), np.float64)
        replies = dict(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), strict=True))
        for b, own in shares(hashes):
            totals[own] = np.frombuffer(replies[b], "<u8")
        scores = batch_scores(lengths, words, hashes, totals, order, least, backoff)
        return pa.table({key: held["keys"].combine_chunks().flatten(), "n_words": lengths, "log_score": scores})

    questions = rows.mapInArrow(ask, "batch long, bucket int, grams binary, counts binary")
    answers = questions.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, totals binary")
    kept = rows.mapInArrow(hold, f"batch long, keys array<{kind}>, lengths binary, places binary, vocabulary binary")
    return kept.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        combine, f"`{key}` {kind}, n_words long, log_score double"
    )
