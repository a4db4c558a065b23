"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "marketloom", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the operators are written for (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARKETLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _use_shared_folder(context) -> None:
    """Have the context know its checkpoint folder: the one the cluster names, or on one machine a folder of its own."""
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir names no shared folder; on a cluster a folder of one machine would be lost with it")
    if not named:
        named = tempfile.mkdtemp(prefix="marketloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``. Where none is named, a local master (tests, a laptop) gets a
    folder of its own, which goes with the process; any other master is an error. Never a local checkpoint: a
    lost executor must not lose it. ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes what no plan refers to.
    """
    _use_shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the cluster's shared checkpoint folder, for a table or a stream's progress."""
    context = spark.sparkContext
    _use_shared_folder(context)
    return f"{context._jsc.sc().getCheckpointDir().get()}/{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context: they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_marketloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="marketloom-package-")  # the driver hands the archive out as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._marketloom_shipped = True
