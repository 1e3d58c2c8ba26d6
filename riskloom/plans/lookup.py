"""Joins against fitted tables, and literal maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import shared_folder


def fitted_table(table: DataFrame) -> DataFrame:
    """A fitted table as written to the shared folder and read back.

    It is computed once, however often it is joined, and the optimizer knows its
    size from its files: it broadcasts a small one, and shuffles and splits hot
    keys where it is not.
    """
    folder = shared_folder(table.sparkSession)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)


def lookup_join(rows: DataFrame, table: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join ``rows`` to a fitted table with unique keys."""
    return rows.join(fitted_table(table), [on] if isinstance(on, str) else list(on), "left")


def literal_map(values: dict, key_type: str = "double", value_type: str = "double"):
    """A code-sized dictionary as a map column."""
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key).cast(key_type), F.lit(value).cast(value_type)]
    return F.create_map(*pairs)


def map_default(values: dict, key, default, key_type: str = "double", value_type: str = "double"):
    """Dictionary lookup with a default for absent and null keys."""
    found = F.try_element_at(literal_map(values, key_type, value_type), key)
    return F.coalesce(found, F.lit(default).cast(value_type))
