"""Lineage cuts that survive executor loss (reliable checkpoints only)."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a private one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and continue from it.

    Compressed and columnar, so it suits wide arrays better than ``checkpoint``. The table stays until the
    folder is cleared.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Empty a table of ``materialise`` that nothing reads any more, as the rounds of a loop would fill the folder."""
    files = df.inputFiles()
    if files:
        df.sparkSession.range(0).write.mode("overwrite").parquet(unquote(files[0]).rsplit("/", 1)[0])
