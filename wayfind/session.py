"""Session defaults shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "wayfind") -> SparkSession:
    """A local session; on a cluster the caller's own session is used as it is."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WAYFIND_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` in as many parts as shuffles have.

    For small rows that much is made of: a table of few megabytes is read by one or two tasks,
    whatever is done with each row, and adaptive plans would join small parts again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they start.

    Nothing is done if PYTHONPATH leads to it already. Workers of a local session are given
    the folder; to those of a cluster Spark sends the package as an archive, once.
    """
    root, sc = str(Path(__file__).resolve().parents[1]), spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "").split(os.pathsep) + os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in (os.path.realpath(p) for p in known if p) or getattr(sc, "_wayfind_sent", False):
        return
    if sc.master == "local" or sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *(p for p in known if p)])
        return
    with tempfile.TemporaryDirectory() as folder:
        sc.addPyFile(shutil.make_archive(f"{folder}/wayfind", "zip", root, "wayfind"))
    sc._wayfind_sent = True
