"""Key joins, audits and name lookups."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C
from riskloom.plans.lookup import fitted_table, lookup_join, map_default
from riskloom.session import shared_folder
from riskloom.sources.artifacts import json_artifact_scan, json_artifact_sink


def exclude_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not selected."""
    return rows.join(fitted_table(selected.select(key).distinct()), key, "left_anti")


def split_membership(rows: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Flag the rows whose key is among the members."""
    marks = members.select(key).distinct().withColumn("_in", F.lit(True))
    flagged = rows.join(marks, key, "left")
    return flagged.withColumn(name, F.col("_in").isNotNull()).drop("_in")


def first_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest by ``order``, picked by a map-side combined aggregate."""
    kept = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(
        F.min_by(F.struct(*kept), F.struct(*order)).alias("_row")
    )
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in kept])


def cache_lookup(
    rows: DataFrame,
    cache: DataFrame,
    key: str,
    generate: Callable[[DataFrame], DataFrame],
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Cached results for known keys, generated ones for the rest.

    ``generate`` maps the missed rows, one per key (of copies the one whose
    other columns are smallest), to the columns of ``cache``. The cache counts
    once per key (the smallest entry by ``order``); ``cached`` tells
    which side a result came from.
    """
    values = [c for c in cache.columns if c != key]
    known = first_per_key(cache, key, order or [F.col(c) for c in values])
    wanted = rows.select(key).distinct()
    hits = wanted.join(known, key, "inner").withColumn("cached", F.lit(True))
    others = [F.col(c) for c in rows.columns if c != key]
    missed = rows.join(known.select(key), key, "left_anti")
    misses = first_per_key(missed, key, others) if others else missed.distinct()
    made = first_per_key(
        generate(misses).select(key, *values), key, order or [F.col(c) for c in values]
    ).withColumn("cached", F.lit(False))
    return hits.unionByName(made)


def cached_or_generated(
    rows: DataFrame, path: str, schema: str, key: str, generate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """:func:`cache_lookup` in the JSON cache at ``path``; what was generated is added to the cache.

    The results are stored before the cache grows, so each missed key is
    generated once. A missing cache is empty; ``schema`` declares its columns.
    """
    spark = rows.sparkSession
    found = cache_lookup(rows, json_artifact_scan(spark, path, schema), key, generate)
    folder = shared_folder(spark)
    found.write.parquet(folder)
    stored = spark.read.schema(found.schema).parquet(folder)
    fresh = stored.filter("not cached").drop("cached")
    if not fresh.isEmpty():
        json_artifact_sink(fresh, path, "append")
    return stored


def combine_features(vectors: DataFrame, vector: str, table: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Append structured columns to a vector, joined on the key.

    A key has one vector, so copies of a key in the table do not multiply.
    """
    once = first_per_key(vectors.select(key, vector), key, [F.col(vector)])
    wide = table.select(key, F.array(*[F.col(c).cast("float") for c in columns]).alias("_extra"))
    joined = once.join(wide, key)
    return joined.select(key, F.concat(F.col(vector), F.col("_extra")).alias("combined"))


def alignment_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys (and rows) stand on one side only, and whether both align.

    Both sides are counted per key before the shuffle, so copies of a hot key
    collapse on the map side.
    """
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    counted = per_key.agg(
        F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("matched_keys"),
        F.count_if(F.col("_r") == 0).alias("left_only_keys"),
        F.count_if(F.col("_l") == 0).alias("right_only_keys"),
        F.coalesce(F.sum("_l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("right_rows"),
    )
    aligned = (
        (F.col("left_only_keys") == 0)
        & (F.col("right_only_keys") == 0)
        & (F.col("left_rows") == F.col("right_rows"))
    )
    return counted.withColumn("aligned", aligned)


def dimension_default_lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str, default) -> DataFrame:
    """Attach a dimension value by key, with a default for unknown keys."""
    joined = lookup_join(rows, dimension.select(key, value), key)
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def measure_pairing(
    measures: DataFrame, side: str, base: str, other: str, keys: Sequence[str], value: str
) -> DataFrame:
    """Ratio of two sides' measures on the keys both have; 0 unless both are positive.

    One conditional aggregate pairs the sides, in place of a self join.
    """
    paired = (
        measures.filter(F.col(side).isin(base, other))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col(side) == base, F.col(value))).alias("base_value"),
            F.max(F.when(F.col(side) == other, F.col(value))).alias("other_value"),
        )
        .filter(F.col("base_value").isNotNull() & F.col("other_value").isNotNull())
    )
    both = (F.col("base_value") > 0) & (F.col("other_value") > 0)
    ratio = F.when(both, F.col("other_value") / F.col("base_value")).otherwise(0.0)
    return paired.withColumn("speedup", ratio)


def match_patterns(
    names: Sequence[str], sections: Mapping[str, Sequence[str]] = C.SECTION_FEATURES
) -> dict[str, list[str]]:
    """Known column names per section, by exact name or glob, in pattern order."""
    resolved = {}
    for section, patterns in sections.items():
        hits = [n for p in patterns for n in names if fnmatch.fnmatchcase(n, p)]
        resolved[section] = list(dict.fromkeys(hits))
    return resolved


def pattern_map_join(
    rows: DataFrame,
    name: str,
    sections: Mapping[str, Sequence[str]] = C.SECTION_FEATURES,
    output: str = "section",
) -> DataFrame:
    """Add the section of a name column; null where no pattern matches.

    The map is part of the plan, so this is one projection: no join and no
    nested loop. Exact names are looked up; globs are tested in order.
    """
    exact, globs = {}, []
    for section, patterns in sections.items():
        for pattern in patterns:
            if "*" in pattern or "?" in pattern:
                globs.append((fnmatch.translate(pattern), section))
            else:
                exact.setdefault(pattern, section)
    found = F.lit(None).cast("string")
    for pattern, section in reversed(globs):
        found = F.when(F.col(name).rlike(pattern), section).otherwise(found)
    if exact:
        listed = map_default(exact, F.col(name), None, "string", "string")
        found = F.coalesce(listed, found)
    return rows.withColumn(output, found)


def unassigned_rest(rows: DataFrame, name: str, sections: Mapping[str, Sequence[str]] = C.SECTION_FEATURES) -> DataFrame:
    """Rows whose name belongs to no section."""
    return pattern_map_join(rows, name, sections, "_section").filter("_section is null").drop("_section")


def label_lookup(rows: DataFrame, name: str, labels: Mapping[str, str] = C.FEATURE_LABELS, output: str = "label") -> DataFrame:
    """Readable label of a name, the name itself when it has none."""
    found = map_default(dict(labels), F.col(name), None, "string", "string")
    return rows.withColumn(output, F.coalesce(found, F.col(name)))


def scenario_cross(rows: DataFrame, scenarios: Sequence[Mapping]) -> DataFrame:
    """Every row under every scenario of a literal grid.

    Scenarios are arguments, so the grid is an exploded literal array: each task
    widens its own rows and nothing is shuffled or broadcast.
    """
    grid = F.array(
        *[F.struct(*[F.lit(v).alias(f"scenario_{k}") for k, v in s.items()]) for s in scenarios]
    )
    return rows.withColumn("_s", F.explode(grid)).select(*rows.columns, "_s.*")
