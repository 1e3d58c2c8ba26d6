"""Quality rules: counts of a text, and its distance from its language.

The distances are Jensen-Shannon distances (base 2, 0 to 1) between a
document's histogram and the language's histogram over all documents: one over
classes of characters, one over the language's common words. Short documents
say too little about either and are not judged by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, settle

# Common words of each language, and classes of characters.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "des", "auf", "in"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "point": r".,;:!?'\"()\-",
    "space": r"\x20\x09-\x0D",
    "letter": r"\x{C0}-\x{24F}",
}
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
#: Guards: fewer characters in words, or fewer words, are not judged by distance.
MIN_CHARS_JUDGED = 300
MIN_WORDS_JUDGED = 100
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.28


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common).

    ``classes`` counts the characters of each class and all others last,
    ``common`` the common words of the language and all other words last.
    Windows of three words are compared by 64-bit hashes.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(text, F.lit("")).alias("text")
    )
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0)).withColumn(
        "lines", F.filter(F.split("text", "\n", -1), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))
    )
    size = lambda mark: F.char_length(F.regexp_replace("text", f"[^{mark}]+", ""))
    at = lambda i: F.element_at("words", i.cast("int"))
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    every = sorted({w for words in COMMON.values() for w in words})
    rows = rows.select(
        "key",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("words", lambda w: F.lower(w).isin(every)).alias("known"),
        F.array(*[size(mark).cast("long") for mark in CLASSES.values()], F.char_length("text").cast("long")).alias("sizes"),
        windows.alias("windows"),
    )
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("known", F.transform("known", lambda w: F.lower(w))).withColumn(
        "sorted", F.when(repeated, F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )
    near = lambda i: F.try_element_at("sorted", i)["h"]
    again = F.filter(
        "sorted",
        lambda x, k: ((k > 0) & (near(F.when(k > 0, k).otherwise(1)) == x["h"]))
        | ((k < F.size("sorted") - 1) & (near(k + 2) == x["h"])),
    )
    rows = rows.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform(
        "starts",
        lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.element_at("starts", F.when(k > 0, k).otherwise(1)))),
    )
    listed = F.lit(None).cast("array<string>")
    for language, words in COMMON.items():
        listed = F.when(F.col("lang") == language, F.array(*map(F.lit, words))).otherwise(listed)
    common = F.transform(listed, lambda w: (F.size("known") - F.size(F.array_remove("known", w))).cast("long"))
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    rows = rows.withColumn("common", common)
    n = len(CLASSES)
    others = F.element_at("sizes", n + 1) - add(F.slice("sizes", 1, n))
    return rows.select(
        "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(covered, F.lit(0), lambda a, v: a + v).cast("long").alias("n_repeat_words"),
        F.concat(F.slice("sizes", 1, n), F.array(others)).alias("classes"),
        F.concat("common", F.array(F.col("n_words") - add("common"))).alias("common"),
    )


def references(counts: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): the histograms of every language over all documents."""
    total = lambda name, n: F.array(*[F.sum(F.element_at(name, k + 1)) for k in range(n)])
    common = max(map(len, COMMON.values())) + 1
    return counts.groupBy("lang").agg(
        total("classes", len(CLASSES) + 1).alias("ref_classes"), total("common", common).alias("ref_common")
    )


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one has no counts."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    share = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def parts(a: Column, b: Column) -> Column:
        p, q = a / total(left), b / total(right)
        return share(p, (p + q) / 2) + share(q, (p + q) / 2)

    divergence = total(F.zip_with(left, right, parts)) / 2
    return F.when((total(left) > 0) & (total(right) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Counts, distances and verdict of every row.

    Null and empty texts have no words and fail the base rules. A null
    language is a language of its own, and one without a list of common words
    is judged by characters alone. Repeated rows are judged each.
    """
    counts = settle(base_counts(docs, key, text, lang))
    known = settle(references(counts))
    far = counts.join(known, "lang").withColumns(
        {
            "class_distance": F.when(F.col("word_chars") >= MIN_CHARS_JUDGED, distance(F.col("classes"), F.col("ref_classes"))),
            "word_distance": F.when(F.col("n_words") >= MIN_WORDS_JUDGED, distance(F.col("common"), F.col("ref_common"))),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return far.select(
        "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~odd).alias("kept"),
        "class_distance", "word_distance",
    )


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass; rows alike in key, text and language share their verdict.

    Rows with a null key are judged by text and language like any other.
    """
    # The row as one struct: no column of it can clash with the tie.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = [F.col(text).alias("text"), F.col(lang).alias("lang")]
    tied = docs.select(F.xxhash64(key, text, lang).alias("tie"), whole, *named)
    verdicts = judge(tied.drop("row"), "tie", "text", "lang").filter("kept")
    passed = verdicts.select(F.col("key").alias("tie")).distinct()
    return tied.join(passed, "tie", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
