"""What the operators of this subpackage share: tables, settled intermediates, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import shared_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handed to one step of a Python worker at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the cluster's shared folder and read them back.

    Cuts the lineage of iterative work and keeps dear columns from being
    computed twice; survives the loss of executors.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
        first, held = 0, 0
        for row, size in enumerate(lengths):
            if held and held + size > most:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += int(size)
        yield batch.slice(first)


def as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 bytes of every text, empty for null."""
    column = batch.column(text).cast(pa.binary())
    return [value or b"" for value in column.to_pylist()]
