"""Text to fixed-size vectors, in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import text
from riskloom.operators.sections import section_texts

DIMENSION = 768


def embed_texts(
    rows: DataFrame,
    body: str,
    output: str = "embedding",
    dimension: int = DIMENSION,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Add a unit vector per text; blank text is embedded as a placeholder token.

    Without an encoder, terms are hashed inside the JVM. ``make_encoder`` is
    called once per task and returns a function from a batch of texts to a
    (batch, dimension) array, for a model of one's own.
    """
    filled = rows.withColumn("_body", text.blank_to_token(F.col(body)))
    if make_encoder is not None:
        encode = predict_batch_udf(
            make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
        )
        return filled.withColumn(output, encode("_body")).drop("_body")
    tokens = filled.withColumn("_terms", text.terms(F.col("_body")))
    hashed = HashingTF(numFeatures=dimension, inputCol="_terms", outputCol="_counts").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(hashed)
    vector = vector_to_array("_unit", "float32")
    return unit.withColumn(output, vector).drop("_body", "_terms", "_counts", "_unit")


def embed_sections(
    rows: DataFrame, key: str, sections: Mapping | None = None, **options
) -> DataFrame:
    """(key, section, embedding) for every section of every record, in one job."""
    long = section_texts(rows, key, sections) if sections else section_texts(rows, key)
    return embed_texts(long, "text", **options).drop("text")


def shape_audit(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """Vectors in all, and vectors of another length."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.size(column), F.lit(0)) != dimension).alias("wrong_size"),
    )
