"""Vectors: position/value pairs and the step from long rows to Spark ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def vector_pairs(df: DataFrame, key: str = "doc_id", vector: str = "vec") -> DataFrame:
    """One row per position of a dense vector, counted from 1."""
    return (
        df.select(key, F.posexplode_outer(vector).alias("pos", "component"))
        .filter(F.col("pos").isNotNull())
        .select(key, (F.col("pos") + 1).alias("position"), F.col("component").cast("double").alias("value"))
    )


def sparse_vector(pairs: Column, size: int) -> Column:
    """Sparse ML vector from ``array<struct<idx, value>>``.

    Ordering and splitting of the pairs run in the JVM; the function itself
    only puts whole Arrow columns into the layout of the vector type.
    """

    @arrow_udf(VectorUDT())
    def assemble(indices: pa.Array, values: pa.Array) -> pa.Array:
        rows = len(indices)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(rows, dtype=np.int8)),
                pa.array(np.full(rows, size, dtype=np.int32)),
                indices,
                values,
            ],
            ["type", "size", "indices", "values"],
        )

    ordered = F.sort_array(pairs)
    return assemble(
        F.transform(ordered, lambda p: p["idx"].cast("int")),
        F.transform(ordered, lambda p: p["value"].cast("double")),
    )
