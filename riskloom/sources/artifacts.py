"""Written results: JSON artifacts, result tables, vectors and fitted models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.ensembles import FACTS, GbtModel
from riskloom.session import shared_folder


def json_artifact_sink(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_artifact_scan(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON records under a declared schema; a missing path is an empty table."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keyed_cache_scan(
    spark: SparkSession, path: str, entry_schema: str, whole_files: bool = True
) -> DataFrame:
    """Entries of caches stored as JSON objects keyed by record id.

    An object fills a file, or a line when ``whole_files`` is off.
    """
    objects = spark.read.text(path, wholetext=whole_files)
    keyed = F.from_json("value", f"map<string, struct<{entry_schema}>>")
    return objects.select(F.explode(keyed).alias("key", "entry")).select("key", "entry.*")


def vector_sink(vectors: DataFrame, path: str) -> None:
    vectors.write.parquet(path)


def vector_scan(spark: SparkSession, path: str, vector: str) -> DataFrame:
    """Stored vectors as float arrays."""
    rows = spark.read.parquet(path)
    return rows.withColumn(vector, F.col(vector).cast("array<float>"))


def model_sink(model: PipelineModel | GbtModel, path: str) -> None:
    if isinstance(model, GbtModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().save(path)


def model_scan(path: str) -> PipelineModel | GbtModel:
    """What was stored at ``path``: a model of boosted trees, which has its facts there, or a Spark pipeline."""
    spark = SparkSession.active()
    if json_artifact_scan(spark, f"{path}/facts", FACTS).first():
        return GbtModel.load(spark, path)
    return PipelineModel.load(path)


STORED = "kind string, rows bigint, mark string, threshold double, path string"


def stored_model(
    train: DataFrame, kind: str, fit: Callable[[], tuple[PipelineModel | GbtModel, float]]
) -> tuple[PipelineModel | GbtModel, float]:
    """The model stored for ``kind`` and these train rows, with its threshold; fitted and stored if there is none.

    Models are listed as JSON records in the application's part of the shared
    folder. A record holds the number and the hash sum of the train rows, so
    that other rows never meet an old fit, and is written after its model.
    """
    spark = train.sparkSession
    index = f"{shared_folder(spark).rpartition('/')[0]}/riskloom-models-{spark.sparkContext.applicationId}"
    values = [vector_to_array(f.name) if isinstance(f.dataType, VectorUDT) else F.col(f.name) for f in train.schema]
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("mark")).first()
    known = json_artifact_scan(spark, index, STORED).filter(
        (F.col("kind") == kind) & (F.col("rows") == seen["n"]) & (F.col("mark") == str(seen["mark"]))
    )
    found = known.orderBy("path").first()
    if found:
        return model_scan(found["path"]), found["threshold"]
    model, threshold = fit()
    path = shared_folder(spark)
    model_sink(model, path)
    record = [(kind, seen["n"], str(seen["mark"]), float(threshold), path)]
    spark.createDataFrame(record, STORED).write.mode("append").json(index)
    return model, threshold
