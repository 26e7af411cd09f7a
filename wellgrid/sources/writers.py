"""Sinks. Every write goes through Spark's commit protocol; nothing is staged by hand."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import check_positive
from ..operators.sampling import file_plan
from ..plans.joins import skew_safe_semi
from .readers import LOG, versions


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace(df: DataFrame, path: str) -> str:
    """Put ``df`` in the place of the table at ``path`` in one step; returns the folder of the new version.

    The rows are written to a folder of their own. Only when all are there, a line in the table's log names that
    folder, and readers (``readers.current``) follow the last line. A write that fails leaves no line, so
    the old rows stay; readers of the old version are not disturbed. Of two writers at once, the one with the greater version
    and folder name wins. Folders of older versions stay until someone clears them.
    """
    spark = df.sparkSession
    folder = f"version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{folder}")
    last = versions(spark, path).agg(F.max("version")).first()[0]
    line = spark.range(1).select(F.lit((last or 0) + 1).cast("bigint").alias("version"), F.lit(folder).alias("folder"))
    line.write.mode("append").parquet(f"{path}/{LOG}")
    return folder


def by_plate(df: DataFrame, path: str, keys: Sequence[str] = ("source", "batch", "plate"), salts: int = 1, mode: str = "overwrite") -> None:
    """One folder per plate, zstd. ``salts`` > 1 spreads a very large plate over several files."""
    check_positive(salts=salts)
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys][:1]), F.lit(salts))
    df.repartition(*keys, spread).write.mode(mode).option("compression", "zstd").partitionBy(*keys).parquet(path)


def resharded(df: DataFrame, path: str, order: Sequence[str], rows_per_file: int = 25_000, max_files: int | None = None) -> None:
    """Contiguous equal files of about ``rows_per_file`` rows in the given order; at most ``max_files`` if given."""
    plan = file_plan(df, order, rows_per_file, max_files)
    n = (plan.agg(F.max("file")).first()[0] or 0) + 1  # an empty table is one empty file
    # a partition is a file by its number; ranges by sampled bounds may put two files into one
    plan.repartitionById(n, F.col("file").cast("int")).sortWithinPartitions("file", *order).drop("file").write.mode("overwrite").option("compression", "zstd").parquet(path)


def metric_csv(df: DataFrame, path: str) -> None:
    """A report table (one row per metric and group) as a single CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: Sequence[str], partition_by: Sequence[str] = (), max_listed: int = 10_000) -> None:
    """Append rows whose key is not stored yet; repeated keys inside ``df`` are written once.

    A schema that differs from the stored one is refused. With ``partition_by`` (e.g. plate) only
    the stored partitions that ``df`` touches are read for the comparison.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(key))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = None
    if stored is not None:
        fixed = [f for f in df.schema.fields if f.name not in partition_by]  # folder names carry no type
        have = {f.name: f.dataType for f in stored.schema.fields if f.name not in partition_by}
        new = {f.name: f.dataType for f in fixed}
        if have != new or not set(partition_by) <= set(stored.columns):
            raise ValueError(f"schema changed: stored {have}, new {new}")
        stored = stored.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in partition_by})
        for c in partition_by:
            touched = [r[0] for r in df.select(c).distinct().limit(max_listed + 1).collect()]
            if len(touched) <= max_listed:  # else read every partition
                stored = stored.where(F.col(c).isin(touched))
        fresh = skew_safe_semi(fresh, stored, key, anti=True)
    writer = fresh.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_parts(df: DataFrame, path: str, plate_key: str) -> None:
    """Per-batch parts of a plate become one partition of files per plate."""
    df.repartition(plate_key).write.mode("overwrite").partitionBy(plate_key).parquet(path)
