"""Secret scans: rules, and character Markov models for what the rules do not name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import let, settle

# The rules, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short takes no other run with it, so the least lengths may stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least length of a candidate, and of a labelled ordinary string.
CANDIDATE = 20
ORDINARY = 6
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
#: Documents (about) whose strings train the models, a bound on fitting alone.
SAMPLE = 20_000
#: Log-likelihood ratio per pair of characters above which a candidate is a secret.
RATIO = 0.5


def found_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern, leftmost first and non-overlapping, as (start, kind, end).

    Matches whose ``group`` has fewer than ``least`` characters still take
    their place in the text and are then dropped.
    """
    rule = F.lit(pattern)
    kinds = "array<struct<start:int,kind:int,end:int>>"

    def walk(found):
        def step(state, i):
            start = state["at"] + F.char_length(F.element_at(found["gaps"], i))
            end = start + F.char_length(F.element_at(found["all"], i))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            kept = F.char_length(F.element_at(found["part"], i)) >= least
            out = F.when(kept, F.concat(state["out"], F.array(span))).otherwise(state["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(found["all"])), empty, step, lambda s: s["out"])

    matches = F.struct(
        F.regexp_extract_all(text, rule, 0).alias("all"),
        F.regexp_extract_all(text, rule, group).alias("part"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    return F.when(F.rlike(text, rule), let(matches, walk)).otherwise(F.array().cast(kinds))


def base_spans(text: Column) -> Column:
    """Spans of the three rules, sorted by start, then kind."""
    return F.sort_array(
        F.concat(
            found_spans(text, ASSIGN, 0, 2, ASSIGN_LENGTH),
            found_spans(text, ACCESS, 1),
            found_spans(text, HEX, 2),
        )
    )


def labelled_strings(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(value, random): labelled strings of about ``sample`` documents.

    Random strings are the values the rules find, and digests in hexadecimal
    and base 64. Ordinary ones are runs of letters, digits and marks that
    overlap no rule.
    """
    rows = docs.select(F.coalesce(text, F.lit("")).alias("text")).filter("text <> ''")
    every = max(1, -(-rows.count() // sample))
    rows = rows.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(every)) == 0)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), ACCESS, " ")
    ordinary = rows.select(F.explode(F.regexp_extract_all(bare, F.lit(RUN % ORDINARY), 0)).alias("value"))
    digest = F.sha2("text", 256)
    made = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.substring(digest, 1, 40)))
    ruled = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), 2), lambda v: F.char_length(v) >= ASSIGN_LENGTH),
        F.regexp_extract_all("text", F.lit(ACCESS), 0),
        F.regexp_extract_all("text", F.lit(HEX), 0),
    )
    random = rows.select(F.explode(F.concat(made, ruled)).alias("value"))
    return ordinary.select("value", F.lit(False).alias("random")).unionByName(
        random.select("value", F.lit(True).alias("random"))
    )


def train(strings: DataFrame) -> list[float]:
    """Log ratio of the two models' probabilities for every pair of characters.

    Counts with one added, so empty samples give even ratios. At most one row
    per label and pair (two times 67 by 67) comes to the driver.
    """
    letters = F.filter(F.split("value", ""), lambda c: c != "")
    pairs = strings.select("random", letters.alias("letters")).select(
        "random",
        F.explode(F.zip_with(F.slice("letters", 1, 1 << 30), F.slice("letters", 2, 1 << 30), lambda a, b: F.concat(a, b))).alias("pair"),
    )
    counts = {False: {}, True: {}}
    for row in pairs.filter(F.char_length("pair") == 2).groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] = row["count"]
    ratios = []
    for first in ALPHABET:
        totals = {r: sum(counts[r].get(first + c, 0) + 1 for c in ALPHABET) for r in counts}
        for second in ALPHABET:
            random, plain = ((counts[r].get(first + second, 0) + 1) / totals[r] for r in (True, False))
            ratios.append(math.log(random / plain))
    return ratios


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the neighbouring characters of a string."""
    table = F.array(*[F.lit(r) for r in ratios])
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    width = len(ALPHABET)

    def total(at):
        pair = lambda i: (F.element_at(at, i) - 1) * width + F.element_at(at, i + 1)
        steps = F.sequence(F.lit(1), F.size(at) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.element_at(table, pair(i))) / (F.size(at) - 1)

    places = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), place)
    return let(places, total)


def scan(docs: DataFrame, ratios: list[float] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans`` (of the rules) and ``_more`` (of the models).

    Both are arrays of (start, kind, end) in code points, sorted, ends not
    included. A model span covers a whole run of at least 20 characters that
    overlaps no rule's span. Null texts count as empty and have none. Every
    row is kept as it is, repeated or not.
    """
    if ratios is None:
        ratios = train(labelled_strings(docs, text))
    held = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_spans", base_spans(held)).withColumn("_runs", found_spans(held, RUN % CANDIDATE, 3))

    def odd(run):
        apart = ~F.exists("_spans", lambda s: (s["start"] < run["end"]) & (s["end"] > run["start"]))
        value = F.substring(held, run["start"] + 1, run["end"] - run["start"])
        return apart & (mean_ratio(value, ratios) > RATIO)

    return rows.withColumn("_more", F.filter("_runs", odd)).drop("_runs")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    name = lambda s: F.element_at(names, s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found secret put out of the text; all rows are kept."""
    # The row as one struct: no column of it can clash with those of the scan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = scan(rows).withColumn("spans", F.sort_array(F.concat("_spans", "_more")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, span):
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        fresh = F.struct(span["end"].alias("at"), F.concat(state["out"], gap, F.lit(mask)).alias("out"))
        within = F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out"))
        return F.when(span["start"] >= state["at"], fresh).otherwise(within)

    finish = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.char_length("text")))
    masked = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(F.col("text"))
    kept = found.withColumn("masked", masked)
    new = {text: F.col("masked")}
    if length in docs.columns:
        new[length] = F.char_length("masked").cast(docs.schema[length].dataType)
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
