"""Session factory for local runs, tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "wellgrid") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.driver.memory", os.environ.get("WELLGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context, so that their Python workers can import it.

    The archive is made in the driver's temporary folder and served by the driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_wellgrid_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "wellgrid"), "zip", root, os.path.basename(os.path.dirname(os.path.abspath(__file__))))
    sc.addPyFile(archive)
    sc._wellgrid_sent = True
