"""Feature prediction from embeddings: ridge fit, per-feature scores, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FAMILIES
from ..plans.linalg import gram
from ..plans.quantiles import exact_quantiles

ALPHA = 1.0  # fixed values
MIN_VAR = 1e-8


@dataclass(frozen=True)
class RidgeModel:
    mean: np.ndarray
    std: np.ndarray
    coef: np.ndarray  # standardised inputs × kept outputs
    intercept: np.ndarray
    kept: np.ndarray  # output positions with enough training variance

    def predict(self, df: DataFrame, x: str, out: str = "pred") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast(self)

        def apply(v: pd.Series) -> pd.Series:
            m = bc.value
            if len(v) == 0:
                return pd.Series([], dtype=object)
            z = (np.stack(v.to_numpy()).astype(np.float64) - m.mean) / m.std
            return pd.Series(list(z @ m.coef + m.intercept))

        return df.withColumn(out, F.pandas_udf(apply, "array<double>")(F.col(x).cast("array<double>")))


def ridge_fit(train: DataFrame, x: str, y: str, alpha: float = ALPHA, min_var: float = MIN_VAR) -> RidgeModel:
    """Multi-output ridge on standardised inputs with an unpenalised intercept.

    One job for the moments of inputs and outputs, one for the centred products XᵀX and XᵀY.
    The driver solves a system of the input dimension; no row leaves the executors.
    """
    both = F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"))
    n, mean, var, d = _joint_moments(train.select(both.alias("xy"), F.size(x).alias("d")))
    kept = np.nonzero(var[d:] > min_var)[0]
    std = np.sqrt(np.maximum(var[:d], 0.0))
    scale = np.where(std > 0, std, 1.0)
    stacked = train.select(F.col(x).alias("l"), both.alias("r"))
    products = gram(stacked, "l", "r", mean[:d], mean) / scale[:, None]
    coef = np.linalg.solve(products[:, :d] / scale + alpha * np.eye(d), products[:, d:][:, kept])
    return RidgeModel(mean[:d], scale, coef, mean[d:][kept], kept)


def _joint_moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray, int]:
    row = df.agg(
        Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("xy")).alias("s"), F.max("d").alias("d")
    ).select("s.*", "d").first()
    n = int(row["count"])
    return n, row["mean"].toArray(), row["variance"].toArray() * max(n - 1, 0) / max(n, 1), int(row["d"])


def ridge_scores(df: DataFrame, x: str, y: str, train: Column, test: Column, alpha: float = ALPHA) -> DataFrame:
    """Fit on ``train`` rows, predict ``test`` rows: ``feature, n, pearson, r2`` per kept output."""
    model = ridge_fit(df.where(train), x, y, alpha)
    scored = model.predict(df.where(test).select(x, y), x)
    kept = [int(i) for i in model.kept]
    picked = F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.get(F.col(y), i).cast("double"))
    pairs = scored.select(F.posexplode(F.arrays_zip(picked.alias("t"), F.col("pred").alias("p"))).alias("i", "v"))
    rows = pairs.select(F.get(F.array(*[F.lit(i) for i in kept]), F.col("i")).alias("feature"), F.col("v.t").alias("truth"), F.col("v.p").alias("pred"))
    return feature_scores(rows, "feature", "truth", "pred")


def feature_scores(rows: DataFrame, feature: str, truth: str, pred: str) -> DataFrame:
    """Pearson r (null when either side is constant) and R² per feature, one aggregate."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    sse = F.sum((t - p) * (t - p))
    sst = F.var_pop(t) * F.count(t)
    return rows.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop(t, p), F.stddev_pop(t) * F.stddev_pop(p)).alias("pearson"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"),
    )


def metric_summary(df: DataFrame, metric: str, family: str, prefix: str, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """One row: n, median, quartiles, shares above 0 / 0.1 / 0.3 and the median per family."""
    x = F.col(metric).cast("double")
    ok = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(x.alias("x"), F.col(family).alias("fam"))
    q = exact_quantiles(ok, [], "x", [0.25, 0.5, 0.75]).scalar()
    share = lambda t: F.avg((F.col("x") > t).cast("double"))
    counts = ok.agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), share(0).alias(f"{prefix}_frac_gt_0"),
        share(0.1).alias(f"{prefix}_frac_gt_0p1"), share(0.3).alias(f"{prefix}_frac_gt_0p3"),
    )
    per = exact_quantiles(ok, ["fam"], "x", [0.5])
    medians = per.agg(*[F.max(F.when(F.col("fam") == f, F.col("q")[0])).alias(f) for f in families])
    row = medians.select(F.struct(*families)).scalar()
    family = {f: row[f].alias(f"{prefix}_{f.lower()}") for f in families}
    return counts.select(
        f"{prefix}_n", q[1].alias(f"{prefix}_median"), q[0].alias(f"{prefix}_iqr_lo"), q[2].alias(f"{prefix}_iqr_hi"),
        f"{prefix}_frac_gt_0", f"{prefix}_frac_gt_0p1", f"{prefix}_frac_gt_0p3", *family.values(),
    )


def family_counts(features: DataFrame, family: str) -> DataFrame:
    return features.groupBy(family).agg(F.count(F.lit(1)).alias("n_features"))
