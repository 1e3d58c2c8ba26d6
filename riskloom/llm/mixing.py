"""Mixing sources to target weights from fixed-length blocks of words.

Words of each source are packed into blocks. Every output shard draws how many
of its slots go to each source; the slots of a source are numbered over all
shards, sent through a pseudorandom permutation of its blocks, and joined with
the blocks by index. Everything is DataFrame work; only the table of sources
(one row each) is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, let, partitions, settle, word_count

BLOCK_WORDS = 32
SHARD_SLOTS = 1 << 16
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 20
ROUNDS = 12
#: A mixture is a list of named sources; more than this is an error.
MAX_SOURCES = 10_000


def document_sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, tie) of every row; null texts have size 0."""
    return docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("tie"),
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """(source, rank, source_size, target), ranks from 1 by code point, null last.

    The words asked for are ``share`` of all words, dealt by repeating
    ``weights``. A source stops at ``most`` times its size and hands its excess
    to the others by weight. Ordered by size over weight, the level of all
    open sources rises until the first one that stays open and then falls, so
    its largest value is the final level.
    """
    totals = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(dealt, F.pmod(F.col("rank") - 1, len(weights)) + 1)
    )
    limit = (F.lit(float(most)) * F.col("source_size")).alias("limit")
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    asked = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (asked - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("limit", limit).withColumn("level", level)
    return leveled.select(
        "source",
        "rank",
        "source_size",
        F.least("limit", F.max("level").over(everything) * F.col("weight")).alias("target"),
    )


def place_documents(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with its source's rank and the number of its first word there.

    Rows of a source stand in the order of a hash of key and text; rows alike
    in both stand next to each other. A source is cut into equal ranges of
    that hash, so no task handles a whole source.
    """
    bits = max(1, (4 * partitions(sizes.sparkSession) - 1).bit_length())
    known = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    placed = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("turn", F.xxhash64("key", "tie")).withColumn(
        "range", F.shiftright("turn", 64 - bits)
    )
    ranges = placed.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("rank", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("rank", "range").orderBy("turn", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    within = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(offsets, ["rank", "range"]).select(
        "key", "source", "size", "tie", "rank", "source_size", "target",
        (F.col("start") + F.col("offset")).alias("start"),
    )


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def shard_counts(targets: DataFrame, block: int, slots: int, seed: int) -> DataFrame:
    """(rank, blocks, shard, count): the slots of every shard drawn for each source.

    The draw is multinomial with the certain part taken out first: a source
    gets the whole part of its expectation, and the slots left are drawn one
    by one from the fractions.
    """
    sources = targets.filter("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    sources = sources.withColumn("asked", F.col("target") / F.col("source_size") * F.col("blocks"))
    # One row: the list of sources, at most MAX_SOURCES long.
    listed = sources.agg(
        F.array_sort(F.collect_list(F.struct("rank", "blocks", "asked"))).alias("sources"),
        F.sum("asked").alias("asked"),
    ).filter("asked > 0")
    shards = listed.withColumn("all", F.round("asked").cast("long")).select(
        "sources", "asked", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / slots))).alias("shard")
    )
    own = F.least(F.lit(slots), F.col("all") - F.col("shard") * slots)
    expected = F.transform("sources", lambda s: s["asked"] / F.col("asked") * F.col("slots"))
    shards = shards.withColumn("slots", own).withColumn("expected", expected)
    shards = shards.withColumn("left", F.col("slots") - F.aggregate("expected", F.lit(0).cast("long"), lambda a, e: a + F.floor(e)))
    # Running sums of the fractions; a draw takes the first source that reaches it.
    sums = F.aggregate(
        "expected",
        F.array(F.lit(0.0)),
        lambda a, e: F.concat(a, F.array(F.element_at(a, -1) + e - F.floor(e))),
    )
    shards = shards.withColumn("sums", sums)
    drawn = shards.filter("left > 0").select(
        "shard", "sums", F.explode(F.sequence(F.lit(1).cast("long"), "left")).alias("draw")
    )
    point = uniform(F.lit(seed), "shard", "draw") * F.element_at("sums", -1)
    hit = F.size(F.filter("sums", lambda s: s <= F.col("point")))
    extra = drawn.withColumn("point", point).select("shard", hit.alias("place")).groupBy("shard", "place").agg(
        F.count(F.lit(1)).alias("extra")
    )
    certain = shards.select("shard", F.posexplode(F.arrays_zip("sources", "expected")).alias("place", "s")).select(
        "shard",
        (F.col("place") + 1).alias("place"),
        F.col("s.sources.rank").alias("rank"),
        F.col("s.sources.blocks").alias("blocks"),
        F.floor("s.expected").alias("certain"),
    )
    return certain.join(extra, ["shard", "place"], "left").select(
        "rank", "blocks", "shard", (F.col("certain") + F.coalesce("extra", F.lit(0))).alias("count")
    )


def permuted(rows: DataFrame, number: str, size: str, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """``number`` sent through a permutation of 0 .. ``size`` - 1 that is the source's own.

    In each round a number and its mirror around a keyed centre change places
    or stay, as a hash of the larger one says. Works for every size.
    """
    for turn in range(rounds):
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "rank"), F.col(size)) - F.col(number), F.col(size))
        rows = rows.withColumn("_mirror", mirror)
        flip = F.xxhash64(F.lit(seed), F.lit(turn), "rank", F.greatest(number, "_mirror")) < 0
        rows = rows.withColumn(number, F.when(flip, F.col("_mirror")).otherwise(F.col(number)))
    return rows.drop("_mirror")


def mixed_slots(
    targets: DataFrame, block: int = BLOCK_WORDS, slots: int = SHARD_SLOTS, seed: int = SEED, most: int = MOST_REPEATS
) -> DataFrame:
    """(shard, rank, round, block): what every slot of the mix takes.

    A source's slots are numbered over all shards. Each full pass through its
    blocks is one round, and no block is taken in more than ``most`` rounds.
    """
    counts = settle(shard_counts(targets, block, slots, seed))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    numbered = counts.withColumn("first", first).filter("count > 0").repartition(partitions(targets.sparkSession), "shard", "rank")
    taken = numbered.select(
        "shard", "rank", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("number")
    ).filter(F.col("number") < most * F.col("blocks"))
    taken = taken.withColumn("round", F.floor(F.col("number") / F.col("blocks")).cast("int")).withColumn(
        "block", F.pmod("number", F.col("blocks"))
    )
    # Written, since the optimizer would unfold the rounds wherever they are joined.
    return settle(permuted(taken, "block", "blocks", seed).select("shard", "rank", "round", "block"))


def block_pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(rank, block, start, first, words): the words of each document in each block of its source."""
    held = placed.filter("size > 0").withColumn("stop", F.col("start") + F.col("size"))
    at = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    cut = held.select("rank", "start", "stop", F.explode(at).alias("block"))
    first = F.greatest("start", F.col("block") * block)
    last = F.least("stop", (F.col("block") + 1) * block)
    return cut.select(
        "rank", "block", "start", (first - F.col("start")).alias("first"), (last - first).alias("words")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how):
    """(placed documents, taken pieces): the mix of all documents.

    Pieces name their document by rank and start, which no two documents with
    words share. Null texts have no words, a null source is a source of its
    own, null keys are keys like others, repeated rows are documents each.
    An empty table gives no rows.
    """
    sizes = settle(document_sizes(docs, key, source, text))
    targets = settle(source_targets(sizes, **how))
    placed = settle(place_documents(sizes, targets))
    pieces = mixed_slots(targets).join(block_pieces(placed), ["rank", "block"])
    return placed, pieces


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Every placed document with the words the mix takes of it."""
    sums = pieces.groupBy("rank", "start").agg(F.sum("words").alias("_taken"))
    some = placed.filter("size > 0").join(sums, ["rank", "start"], "left")
    none = placed.filter("size = 0").withColumn("_taken", F.lit(None).cast("long"))
    return some.unionByName(none).withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_taken")


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", length: str = "n_chars"
) -> DataFrame:
    """The mix as documents: for each round, what it takes of each document.

    A document taken whole keeps its text; else the taken words are joined by
    spaces in their order. Other columns are kept. Rows alike in key, source
    and text are one document that is packed as often as it occurs.
    """
    placed, pieces = mix(docs, key, source, text)
    parts = pieces.groupBy("rank", "start", "round").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("_parts"), F.sum("words").alias("_words")
    )
    # One struct names a document on both sides: nulls in it are equal, and the texts are shuffled once.
    named = placed.filter("size > 0").join(parts, ["rank", "start"]).select(
        F.struct("key", "source", "tie").alias("_placed"), (F.col("size") == F.col("_words")).alias("_whole"), "_parts"
    )
    name = F.struct(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("tie"))
    # The row as one struct: no column of it can clash with those of the mix.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(name.alias("_name"), whole, F.col(text).alias("text")).dropDuplicates(["_name"])
    joined = rows.join(named, F.col("_name") == F.col("_placed"))

    def taken(words):
        piece = lambda p: F.slice(words, p["first"].cast("int") + 1, p["words"].cast("int"))
        return F.array_join(F.flatten(F.transform("_parts", piece)), " ")

    cut = let(F.regexp_extract_all("text", F.lit(WORD), 0), taken)
    kept = joined.withColumn("mixed", F.when(F.col("_whole"), F.col("text")).otherwise(cut))
    new = {text: F.col("mixed")}
    if length in docs.columns:
        new[length] = F.char_length("mixed").cast(docs.schema[length].dataType)
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
