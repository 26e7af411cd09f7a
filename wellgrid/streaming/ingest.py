"""Resumable ingest: each landed file is processed once, keys are never stored twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def _schema(spark: SparkSession, path: str) -> dict | None:
    """Stored column types, None where nothing is stored."""
    try:
        return {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
    except AnalysisException:
        return None


def _begun(spark: SparkSession, state: str) -> bool:
    try:
        return not spark.read.text(f"{state}/metadata").isEmpty()
    except AnalysisException:
        return False


def ingest_once(stream: DataFrame, out: str, state: str, key: Sequence[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process everything that has landed, then stop. Run again to pick up new files.

    ``state`` remembers finished files and every key stored so far, as an index on disk that is dealt out by
    the hash of the key: a micro-batch looks up its own keys and writes the new ones, whatever the size of
    the table. Of rows with one key the first to land stays, nulls being equal. ``out`` carries the log of its finished
    batches, so a batch that is run again after a failure replaces what it left; read ``out`` as one
    table. ``transform`` is a stateless map such as ``blobs.embed``; it sees new keys only.

    Refused before anything is read: a result whose columns or types differ from the stored ones, and a table
    without its ``state``, whose keys nobody knows. The number of shuffle partitions of the first run
    deals out the keys for good.
    """
    spark = stream.sparkSession
    fresh = stream.dropDuplicates(list(key))
    rows = transform(fresh) if transform else fresh
    have, new = _schema(spark, out), {f.name: f.dataType for f in rows.schema.fields}
    if have is not None and have != new:
        raise ValueError(f"schema changed: stored {have}, new {new}")
    if have is not None and not _begun(spark, state):
        raise ValueError(f"{out} holds rows, but {state} does not know their keys")
    with _setting(spark, PROVIDER, ROCKS):
        query = (
            rows.writeStream.format("parquet").outputMode("append").option("path", out).option("compression", "zstd")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
    query.awaitTermination()
