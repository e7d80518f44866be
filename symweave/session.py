"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "12g", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the given session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def cut(df: DataFrame, bounded: bool = False) -> DataFrame:
    """Computes df once and cuts its lineage, in the shared folder, so that lost executors lose nothing.

    bounded keeps to the session's shuffle partitions, for unions that would gain partitions in every round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if bounded:
        df = df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, condition: Column, bounded: bool = False) -> tuple[DataFrame, int]:
    """As cut, with the number of rows that meet the condition, counted over what was written.

    Loops end by this number, so it doesn't rest on metrics that a busy driver may drop.
    """
    kept = cut(df, bounded)
    return kept, kept.where(condition).count()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they see it where it lies."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    seen = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _SHIPPED or root in seen or context.master.startswith("local[") and Path.cwd() == root:
        return
    _SHIPPED.add(context.applicationId)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "symweave"), "zip", root, "symweave")
    path = list(sys.path)
    context.addPyFile(archive)
    sys.path[:] = path
