"""Deterministic sample texts, one per row of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import constants as C


def hash_number(key: Column, name: str, low: int, high: int, seed: int = C.SEED) -> Column:
    """A number in [low, high) from the md5 of key, name and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{name}:{seed}")))
    return F.lit(low) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(high - low)


def synth_texts(
    rows: DataFrame,
    key: str,
    templates: Sequence[str],
    words: Mapping[str, Sequence[str]],
    ranges: Mapping[str, tuple[int, int]],
    seed: int = C.SEED,
) -> DataFrame:
    """A text per row: its template and ``words`` cycle with the key, numbers come from ``ranges`` by hash.

    A template names what is put in as ``{name}``.
    """
    number = F.col(key)
    cycle = lambda items: F.get(
        F.array(*[F.lit(i) for i in items]), F.pmod(number, F.lit(len(items))).cast("int")
    )
    values = {name: cycle(items) for name, items in words.items()}
    values |= {name: hash_number(number, name, low, high, seed).cast("string") for name, (low, high) in ranges.items()}
    filled = cycle(templates)
    for name, value in values.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return rows.select(key, filled.alias("text"))
