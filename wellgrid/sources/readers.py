"""Scans of the inbound file kinds. Schemas are given, never inferred, for text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metadata import sequence_records


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def csv_table(spark: SparkSession, path: str | list[str], schema: T.StructType, with_file: bool = False) -> DataFrame:
    """CSV (plain or gz by suffix), one file or many, with header."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.withColumn("file_path", F.col("_metadata.file_path")) if with_file else df


def commented_tsv(spark: SparkSession, path: str, schema: T.StructType, comment: str = "!", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).options(header=True, sep="\t", comment=comment, encoding=encoding).csv(path)


def parquet_scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, equals: dict | None = None) -> DataFrame:
    """Equality filters and the column subset reach the scan."""
    df = spark.read.parquet(path)
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == v)
    return df.select(*columns) if columns else df


def parquet_tree(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All files below a folder; a missing or empty folder is an error."""
    try:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no {pattern} files under {path}") from e


def shard_index(spark: SparkSession, path: str, key: str = "__key__", prefix: str = r"^(.*)_[^_]*$", shard: str = r"(\d+)[^/]*$") -> DataFrame:
    """``prefix, shard`` from the key column and file names only; image columns are not read."""
    df = spark.read.parquet(path).select(F.regexp_extract(key, prefix, 1).alias("prefix"), F.col("_metadata.file_name").alias("f"))
    return df.select("prefix", F.regexp_extract("f", shard, 1).cast("int").alias("shard")).distinct()


def text_list(spark: SparkSession, path: str, out: str = "value") -> DataFrame:
    """Distinct non-empty trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias(out)).where(F.col(out) != "").distinct()


def image_blobs(spark: SparkSession, path: str, key: str, image: str) -> DataFrame:
    """``key, bytes`` from shards holding raw bytes or struct{bytes, path}."""
    df = spark.read.parquet(path)
    nested = isinstance(df.schema[image].dataType, T.StructType)
    return df.select(key, F.col(f"{image}.bytes" if nested else image).alias("bytes"))


def fasta(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """``gene, sequence``; records without a gene tag are dropped. Splits on '>' so files stay splittable.

    Of several records of a gene the last in its file counts, of several files the last by name.
    """
    raw = spark.read.option("lineSep", ">").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )
    out = sequence_records(raw.where(F.length(F.trim("value")) > 0), "value", ["file", "block", "place"])
    return out if genes is None else out.join(genes.select("gene").distinct(), "gene", "left_semi")


def whitelist(spark: SparkSession, entries: list[dict], fields: Sequence[str]) -> DataFrame:
    """Whitelist entries from a config; an absent field is a wildcard, an unknown one an error."""
    if not entries:
        raise ValueError("empty sample list")
    unknown = {k for e in entries for k in e} - set(fields)
    if unknown:
        raise ValueError(f"unknown whitelist fields {sorted(unknown)}")
    rows = [tuple(None if e.get(f) is None else str(e[f]) for f in fields) for e in entries]
    return spark.createDataFrame(rows, strings(fields))


def whitelist_yaml(spark: SparkSession, path: str, fields: Sequence[str], key: str = "samples") -> DataFrame:
    import yaml

    with open(path) as f:
        return whitelist(spark, yaml.safe_load(f)[key], fields)


LOG = "log"  # folder with one row per version of a replaceable table


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, folder`` of a table written by ``writers.replace``; none if there is no such table yet."""
    try:
        return spark.read.schema("version bigint, folder string").parquet(f"{path}/{LOG}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version bigint, folder string")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table written by ``writers.replace``."""
    last = versions(spark, path).agg(F.max(F.struct("version", "folder")).alias("at")).first()["at"]
    if last is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path}/{last['folder']}")
