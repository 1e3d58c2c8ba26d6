"""Use of all cores on inputs of few splits, and few tasks on inputs of many small files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, key: str, factor: int = 2) -> DataFrame:
    """Hash a scan over all cores when its files give fewer splits than there are.

    Text work is bound by CPU, and one small file is one split. An input that
    already fills the cluster is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores * factor, key)


def gathered(scan: DataFrame, factor: int = 4) -> DataFrame:
    """A scan of many small files in tasks of about ``spark.sql.files.maxPartitionBytes`` of content.

    Spark counts some MB for the opening of each file, so files of a few KB
    make a task for every few of them. No row is shuffled; a scan whose splits
    are full is returned as it is.
    """
    spark = scan.sparkSession
    size = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(spark.sparkContext.defaultParallelism * factor, -(-size // split))
    return scan.coalesce(tasks) if scan.rdd.getNumPartitions() > tasks else scan
