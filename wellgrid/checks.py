"""Plan-time schema checks, argument rules and data assertions.

``require_columns`` and the argument rules start no job. Functions that must look at
rows say so; they aggregate on the executors and bring back a bounded report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE_IDENTIFIER = r"^[A-Za-z0-9._-]+$"  # fixed value: characters allowed in an id part


def require_columns(df: DataFrame, columns: Sequence[str], select: bool = False) -> DataFrame:
    """Raise if columns are missing; with ``select`` also fix the column order."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}; have {df.columns}")
    return df.select(*columns) if select else df


def non_binary_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.BinaryType)]


def unsafe_identifiers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(column_name, value)`` that are null or break the identifier pattern."""
    require_columns(df, columns)
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ])
    )
    bad = F.col("value").isNull() | ~F.col("value").rlike(SAFE_IDENTIFIER)
    return df.select(pairs.alias("p")).select("p.*").where(bad).distinct()


def assert_safe_identifiers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Runs a job; the error names at most five offenders."""
    offenders = unsafe_identifiers(df, columns).limit(5).collect()
    if offenders:
        raise ValueError(f"unsafe identifiers: {[(r.column_name, r.value) for r in offenders]}")
    return df


def guard(df: DataFrame, condition: Column, message: str, on: str) -> DataFrame:
    """Fail the job at the first row breaking ``condition``, without another pass.

    The check rides on column ``on`` so the optimizer cannot prune it away.
    """
    checked = F.when(F.coalesce(condition, F.lit(False)), F.col(on)).otherwise(
        F.raise_error(F.lit(message)).cast(df.schema[on].dataType)
    )
    return df.withColumn(on, checked)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs a job."""
    dup = duplicate_keys(df, keys).limit(5).collect()
    if dup:
        raise ValueError(f"duplicate keys {[tuple(r)[:-1] for r in dup]}")
    return df


def assert_not_empty(df: DataFrame, what: str = "selection") -> DataFrame:
    """Runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(f"empty {what}")
    return df


def request_violations(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Rows of a work request that must not be processed: null required field or repeated id."""
    require_columns(df, [key, *required])
    nulls = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    missing = df.select(
        F.col(key).cast("string").alias("id"), F.array_compact(F.array(*nulls)).alias("m")
    ).where(F.size("m") > 0).select("id", F.concat(F.lit("missing:"), F.array_join("m", ",")).alias("problem"))
    repeated = duplicate_keys(df, [key]).select(
        F.col(key).cast("string").alias("id"), F.lit("repeated").alias("problem")
    )
    return missing.unionByName(repeated)


def blob_size_violations(df: DataFrame, blob: str, shape: Sequence[int], key: str) -> DataFrame:
    """Rows whose blob does not hold exactly ``prod(shape)`` bytes."""
    expected = 1
    for s in shape:
        expected *= int(s)
    return df.select(
        F.col(key), F.octet_length(blob).cast("long").alias("n_bytes"), F.lit(expected).cast("long").alias("expected")
    ).where(F.col("n_bytes").isNull() | (F.col("n_bytes") != expected))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row counter that rides on the job consuming ``df`` (no extra pass)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def batch_cardinality(df: DataFrame, batch: str, expected: int | None, group: str | None = None) -> DataFrame:
    """Distinct batches per group against the expected number.

    status: ``error`` above, ``warn`` below, ``ok`` equal, ``skip`` when unknown.
    """
    n = F.countDistinct(batch).alias("n_batches")
    got = df.groupBy(group).agg(n) if group else df.agg(n)
    exp = F.lit(expected).cast("long")
    return got.select(
        *([group] if group else []),
        "n_batches",
        exp.alias("expected"),
        F.when(exp.isNull(), "skip").when(F.col("n_batches") > exp, "error")
        .when(F.col("n_batches") < exp, "warn").otherwise("ok").alias("status"),
    )


def assert_batch_cardinality(df: DataFrame, batch: str, expected: int | None) -> DataFrame:
    """Runs a job; raises when more batches exist than expected."""
    row = batch_cardinality(df, batch, expected).first()
    if row.status == "error":
        raise ValueError(f"{row.n_batches} batches in column {batch!r}, expected at most {expected}")
    return df


# -- argument rules ---------------------------------------------------------------

STRATEGIES = {  # fixed values: strategy name -> the size argument it needs, if any
    "uniform_per_well": "n_per_well",
    "uniform_per_compound_source": "n_per_group",
    "uniform_total": "n_total",
    "all": None,
}


def check_sampling(strategy: str, **args) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    size = args.get(STRATEGIES[strategy]) if STRATEGIES[strategy] else 1
    if size is None or int(size) <= 0:
        raise ValueError(f"{strategy} needs a positive {STRATEGIES[strategy]}")
    if args.get("control_labels") and strategy != "uniform_per_compound_source":
        raise ValueError("control_labels only goes with uniform_per_compound_source")


def check_quantiles(fields: Sequence[str], low: float, high: float) -> None:
    if not fields:
        raise ValueError("no fields given")
    if not (0.0 <= low < high <= 1.0):
        raise ValueError(f"need 0 <= low < high <= 1, got {low}, {high}")


def check_positive(**sizes: int) -> None:
    for name, value in sizes.items():
        if value is None or int(value) <= 0:
            raise ValueError(f"{name} must be positive, got {value}")


def check_fractions(test: float, val: float) -> None:
    if not (0 <= test < 1 and 0 <= val < 1 and test + val < 1):
        raise ValueError(f"need test, val in [0,1) with test + val < 1, got {test}, {val}")
