"""Moments of a vector column and application of a d×d matrix.

Only matrices whose size depends on the number of features (d×d) reach the driver; ``MAX_DIM``
bounds them. Means and variances are JVM aggregates with map-side partial sums; products are
centred first, so large offsets cost no precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 4096
DIRECT = 1 << 20


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, out: str = "mean", count: str | None = None) -> DataFrame:
    """Element-wise mean per group. The partial state is one vector per group and task."""
    aggs = [Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("__m")]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    return df.groupBy(*keys).agg(*aggs).withColumn(out, vector_to_array("__m")).drop("__m")


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population variance) of the whole table."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    row = df.select(Summarizer.metrics("count", "mean", "variance").summary(v).alias("s")).select("s.*").first()
    n = int(row["count"])
    mean, var = row["mean"].toArray(), row["variance"].toArray()
    return n, mean, var * (n - 1) / n if n > 1 else np.zeros_like(var)


def table_sums(df: DataFrame, cols: Sequence[str], fn: Callable[[pd.DataFrame], np.ndarray], length: int) -> np.ndarray:
    """Sum over all rows of ``fn(batch) -> 1-d array`` of fixed length.

    Each task adds up its batches and emits one array. Tasks are merged down to twice the core count
    first, so the number of partial arrays follows the cluster, not the data. Arrays of at most
    ``DIRECT`` numbers in all are added on the driver, larger ones in two levels in the JVM.
    """

    def partial(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                v = fn(pdf)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    def packed(batches):
        for out in partial(batches):
            yield pd.DataFrame({"v": [v.tobytes() for v in out["v"]]})

    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    if tasks * length <= DIRECT:
        some = df.select(*cols).coalesce(tasks).mapInPandas(packed, "v binary").collect()  # at most one array a task
        return sum((np.frombuffer(bytes(r.v)) for r in some), np.zeros(length))
    parts = df.select(*cols).coalesce(tasks).mapInPandas(partial, "v array<double>")
    spread = max(1, math.isqrt(tasks))
    mid = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(spread)).alias("g")).agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    row = mid.agg(Summarizer.sum(F.col("v")).alias("v")).first()
    return np.zeros(length) if row is None or row.v is None else row.v.toArray()


def gram(df: DataFrame, left: str, right: str, left_mean: np.ndarray, right_mean: np.ndarray) -> np.ndarray:
    """Σ (l - mean)ᵀ(r - mean), as one matrix product per Arrow batch."""
    shape = (len(left_mean), len(right_mean))
    if max(shape) > MAX_DIM:
        raise ValueError(f"{max(shape)} features exceed the bound of {MAX_DIM}")
    bc = df.sparkSession.sparkContext.broadcast((left_mean, right_mean))

    def product(pdf: pd.DataFrame) -> np.ndarray:
        lm, rm = bc.value
        a = np.stack(pdf["l"].to_numpy()).astype(np.float64) - lm
        b = a if left == right else np.stack(pdf["r"].to_numpy()).astype(np.float64) - rm
        return (a.T @ b).ravel()

    cols = [F.col(left).cast("array<double>").alias("l")] + ([] if left == right else [F.col(right).cast("array<double>").alias("r")])
    return table_sums(df.select(*cols), ["*"], product, shape[0] * shape[1]).reshape(shape)


def covariance(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population covariance)."""
    n, mean, _ = moments(df, vec)
    return n, mean, gram(df, vec, vec, mean, mean) / n


def correlation(df: DataFrame, vec: str) -> np.ndarray:
    """Pearson matrix; a constant feature correlates 0 with all others and 1 with itself."""
    _, _, cov = covariance(df, vec)
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    safe = np.where(std > 0, std, 1.0)
    r = cov / np.outer(safe, safe)
    np.fill_diagonal(r, 1.0)
    return r


def apply_affine(df: DataFrame, vec: str, weight: np.ndarray, center: np.ndarray, out: str, offset: np.ndarray | None = None) -> DataFrame:
    """``out = (vec - center) @ weight + offset``, one matrix product per Arrow batch."""
    bc = df.sparkSession.sparkContext.broadcast((weight, center, offset))

    def product(v: pd.Series) -> pd.Series:
        w, c, o = bc.value
        if len(v) == 0:
            return pd.Series([], dtype=object)
        x = (np.stack(v.to_numpy()).astype(np.float64) - c) @ w
        return pd.Series(list(x if o is None else x + o))

    return df.withColumn(out, F.pandas_udf(product, "array<double>")(F.col(vec).cast("array<double>")))
