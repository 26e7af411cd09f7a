"""Array-column arithmetic, in double precision, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def to_double(v: str | Column) -> Column:
    return _c(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(to_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(df, vec: str, out: str = "unit"):
    """Adds ``out``; the zero vector stays zero. The norm is bound once per row, not per element."""
    pair = F.struct(to_double(vec).alias("v"), norm(vec).alias("n"))
    unit = F.transform(F.array(pair), lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x)))
    return df.withColumn(out, F.get(unit, F.lit(0)))


def all_finite(v: str | Column) -> Column:
    big = float("inf")
    return F.forall(to_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != big))


def log1p(v: str | Column) -> Column:
    return F.transform(to_double(v), lambda x: F.log1p(x))


def finite_or_null(x: Column) -> Column:
    """±inf and NaN become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def finite_or_null_array(v: str | Column) -> Column:
    return F.transform(to_double(v), finite_or_null)
