"""Scoring of arriving record files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_score(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    cached: DataFrame | None = None,
    key: str = "trial_id",
    files_per_batch: int = 1000,
    time: str | None = None,
    bound: str = "30 days",
) -> StreamingQuery:
    """Score the files that arrived in ``source``, append the results to ``target``; the finished query.

    Fitted medians and scaler are part of ``score``. Records whose key is
    already cached are skipped by a stream-static anti join, and a key that
    arrives again, in the same or a later file, is stored once: the state
    holds the keys stored so far, and only narrow results are shuffled for it.
    With ``time``, a timestamp column that ``score`` keeps, the state forgets
    keys older than ``bound`` before the latest one seen, so it stops growing,
    and a key is stored once within that bound. Records without a key are all
    stored and pass by the state. A backlog is worked off in batches of
    ``files_per_batch`` files. The checkpoint makes every file count once, also
    after a restart.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if cached is not None:
        arriving = arriving.join(cached.select(key), key, "left_anti")
    scored = score(arriving)
    if time:
        scored = scored.withWatermark(time, bound)
    keyed = scored.filter(F.col(key).isNotNull())
    once = keyed.dropDuplicatesWithinWatermark([key]) if time else keyed.dropDuplicates([key])
    query = (
        once.unionByName(scored.filter(F.col(key).isNull()))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return query
