"""Audit of how far the sources of a language are apart in their words.

Copies are collapsed first: the texts of a language that are alike become one
row with the number of its copies in each source, and are cut into terms once;
their counts and document frequencies are weighted by those numbers. From then
on only cells (lang, source, term) that occur are held. The difference of two
sources is that of their empty cells for every kept term, which is one number
per pair, put right for the terms that either of them has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import SLICE_BYTES, as_bytes, settle

LEAST_DOCS = 30
PRIOR = 5
TERMS = 50
#: Parts that the unit is cut into, as two factors: what they are multiplied with stays a long.
UNIT = (31_250, 32_000)
#: Distinct texts of which a task remembers that it has sent them.
SENT = 200_000
#: ASCII letters in lower case and all bytes above ASCII; any other byte is a gap.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def copies(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, digest, text, source, n) with equal rows of a batch added up.

    A task sends each text once and its later copies with a null text, so many
    copies of a text are few bytes. Null fields are empty.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = docs.select(*named, F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("digest"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, bytes]] = set()
        for batch in batches:
            held = pa.table([*batch.columns[:2], batch.column("digest"), np.arange(batch.num_rows)], ["lang", "source", "digest", "row"])
            groups = held.group_by(["lang", "source", "digest"]).aggregate([("row", "min"), ([], "count_all")])
            first = []
            for known in zip(groups["lang"].to_pylist(), groups["digest"].to_pylist(), strict=True):
                first.append(known not in sent)
                sent.add(known)
            if len(sent) > SENT:
                sent.clear()
            texts = pc.if_else(pa.array(first, pa.bool_()), batch.column("text").take(groups["row_min"].combine_chunks()), None)
            yield pa.RecordBatch.from_arrays(
                [*(groups[c].combine_chunks() for c in ("lang", "digest")), texts, groups["source"].combine_chunks(), groups["count_all"].combine_chunks()],
                ["lang", "digest", "text", "source", "n"],
            )

    return rows.mapInArrow(collapse, "lang string, digest binary, text string, source string, n long")


def counted(groups: list[tuple[str, bytes, dict[str, int]]]) -> pa.Table:
    """(lang, source, term, n, docs) of distinct texts, each with its copies by source."""
    words = [text.translate(LETTERS).split() for _, text, _ in groups]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    size = max(1, len(coded.dictionary))
    # Terms of each text, then a row for each of these and each source that has the text.
    pairs, times = np.unique(np.repeat(np.arange(len(groups)), lengths) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    owner = pairs // size
    held = [(lang, source, n) for lang, _, sources in groups for source, n in sources.items()]
    many = np.fromiter((len(sources) for _, _, sources in groups), np.int64, len(groups))
    begins = np.cumsum(many) - many
    spread = many[owner]
    at = np.repeat(begins[owner] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
    copies_there = np.array([n for _, _, n in held], np.int64)[at]
    of_lang, of_source = (pa.array([h[k] for h in held], pa.string()).dictionary_encode() for k in (0, 1))
    table = pa.table(
        {
            "lang": of_lang.indices.take(pa.array(at)),
            "source": of_source.indices.take(pa.array(at)),
            "term": pa.array(np.repeat(pairs % size, spread)),
            "n": pa.array(np.repeat(times, spread) * copies_there),
            "docs": pa.array(copies_there),
        }
    )
    cells = table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    named = zip(("lang", "source", "term"), (of_lang.dictionary, of_source.dictionary, coded.dictionary.cast(pa.string())), strict=True)
    return pa.table(
        {c: names.take(cells[c].combine_chunks()) for c, names in named} | {"n": cells["n_sum"], "docs": cells["docs_sum"]}
    )


def term_cells(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term that occurs."""
    dealt = copies(docs, text, lang, source).repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    # The most cells that a task holds before it sends them.
    most = 500_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[str, bytes, dict[str, int]]] = []
        cells: list[pa.Table] = []
        known, held = None, 0

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal cells
            if cells and (last or sum(c.num_rows for c in cells) > most):
                whole = pa.concat_tables(cells).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
                yield from whole.rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks().to_batches(max_chunksize=1 << 16)
                cells = []

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "digest", "source", "n")), as_bytes(batch, "text"), strict=True)
            for language, digest, from_source, n, value in rows:
                if (language, digest) != known:
                    if held > SLICE_BYTES:
                        cells.append(counted(groups))
                        groups, held = [], 0
                        yield from ready(False)
                    known = (language, digest)
                    groups.append((language, b"", {}))
                of, own, sources = groups[-1]
                if value and not own:
                    groups[-1] = (of, value, sources)
                    held += len(value)
                sources[from_source] = sources.get(from_source, 0) + n
        if groups:
            cells.append(counted(groups))
        yield from ready(True)

    # Dealt by what the sums over a term's sources need too; a task has added up its own cells before.
    found = dealt.mapInArrow(count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + PRIOR) / (total + PRIOR terms)), exact: the unit is multiplied in two steps."""
    first, second = map(F.lit, UNIT)
    whole, scaled = total + PRIOR * terms, (n + PRIOR) * first
    div = lambda a, b: F.call_function("div", a, b)
    return 1 + div(scaled, whole) * second + div(scaled % whole * second, whole)


def kept_cells(cells: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_count, head) of terms in at least ``least`` documents of their language.

    ``lang_count`` counts the term in the language; ``head`` marks one cell per term.
    """
    term = Window.partitionBy("lang", "term")
    rows = cells.select(
        "*",
        F.sum("n").over(term).alias("lang_count"),
        F.sum("docs").over(term).alias("lang_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("head"),
    )
    return rows.filter(F.col("lang_docs") >= least).drop("docs", "lang_docs")


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCS,
    terms: int = TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents of one lang and source.

    Part ``pair``: the sum of the differences of two sources' term shares, for
    each other source of the language. Part ``term``: the ``terms`` terms whose
    share is furthest above the language's. Shares are whole numbers, so all
    sums are exact. Null texts, languages and sources are empty; repeated rows
    count each; a language without kept terms has pairs of 0 and no terms; an
    empty table gives no rows. Other columns are not read. Ranks follow the
    value descending, then the item in the order of its bytes.
    """
    cells = settle(kept_cells(term_cells(docs, text, lang, source), least))
    languages = cells.filter("head").groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_count").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))))
    groups = named.distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.na.fill(0, ["total", "size", "lang_total"])
    # Without terms there is no share, and no difference.
    empty = F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("size"))).otherwise(0)
    groups = settle(groups.withColumn("z", empty))
    shares = settle(
        cells.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "z",
            share(F.col("n"), F.col("total"), F.col("size")).alias("p"),
            share(F.col("lang_count"), F.col("lang_total"), F.col("size")).alias("q"),
        )
    )
    return pair_part(groups, shares).unionByName(term_part(shares, terms))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return found.filter(F.col("rank") <= most) if most else found


def term_part(shares: DataFrame, most: int) -> DataFrame:
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(above, "term", most)


def pair_part(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Both directions of every pair of groups of a language.

    With z the share of an empty cell, a pair's sum is V |z_a - z_b|, plus for
    the terms of a, and likewise of b, |p_a - z_b| - |z_a - z_b|, plus for the
    terms of both |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|. Terms
    of one group that occur equally often are one row of the middle sum.
    """
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"))
    sides = groups.select("lang", "source", "z", "size").join(other, "lang").filter("source != other")
    pair = ["lang", F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")]
    bare = sides.filter("source < other").select(*pair, (F.col("size") * gap("z", "other_z")).alias("value"))
    alike = shares.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("terms"))
    one = alike.join(other, "lang").filter("source != other")
    one = one.select(*pair, (F.col("terms") * (gap("p", "other_z") - gap("z", "other_z"))).alias("value"))
    left = shares.select("lang", "term", "source", "p", "z")
    right = shares.select("lang", "term", *(F.col(c).alias(a) for c, a in (("source", "other"), ("p", "other_p"), ("z", "other_z"))))
    both = left.join(right, ["lang", "term"]).filter("source < other")
    apart = gap("p", "other_p") - gap("p", "other_z") - gap("z", "other_p") + gap("z", "other_z")
    both = both.groupBy(*pair).agg(F.sum(apart).alias("value"))
    summed = bare.unionByName(one).unionByName(both).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    return ranked(settle(summed).select("lang", ways.alias("way"), "value").select("lang", "way.*", "value"), "pair")
