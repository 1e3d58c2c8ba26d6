"""Parquet tables and the record view the operators are bound to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.spread import spread


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_sink(rows: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a table; partition columns let later reads skip files."""
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return parquet_scan(spark, f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("trial_id"), (1 - F.col("quality")).alias("terminated")
    )


def trials(spark: SparkSession, folder: str, labelled: bool = True, texts: bool = True) -> DataFrame:
    """Documents as study records; the label join is left out where no label is needed.

    Without ``texts`` the scan is not spread, for work on the short columns only.
    """
    docs = documents(spark, folder) if texts else table(spark, folder, "documents")
    first_break = F.instr("text", "\n")
    records = docs.select(
        F.col("doc_id").alias("trial_id"),
        F.col("text").alias("full_text"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("official_title"),
        F.when(first_break > 0, F.substring(F.col("text"), first_break + 1, F.length("text")))
        .otherwise("")
        .alias("eligibility_criteria"),
        F.when(F.col("lang") == "en", "INTERVENTIONAL").otherwise("OBSERVATIONAL").alias("study_type"),
        F.when(F.col("doc_id") % 10 == 0, F.lit(0)).otherwise(F.col("n_chars") % 1500).alias("enrollment_count"),
        (F.col("doc_id") % 5).cast("double").alias("phase_encoded"),
        (F.col("doc_id") % 7 == 0).alias("has_expanded_access"),
        (1 + F.col("doc_id") % 4).alias("condition_count"),
    )
    if not labelled:
        return records
    return records.join(labels(spark, folder), "trial_id", "left")
