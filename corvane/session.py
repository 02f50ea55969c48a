"""Session helpers: local sessions for tests, table reading and shared checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench. Clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # Only a session of one machine (tests) gets a folder of its own.
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "corvane-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: its rows go to the checkpoint folder all executors share."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context; they need no installation of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "corvane.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for place, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(place, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._corvane_shipped = True
