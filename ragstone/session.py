"""Session factory used by the bench and by applications; queries themselves take any session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "ragstone", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; the master comes from spark-submit unless `cpus` asks for local mode."""
    builder = SparkSession.builder.appName(app)
    if cpus:
        # In local mode the driver's heap is all there is; on a cluster spark-submit sets it.
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("RAGSTONE_LOCAL_MEMORY", "8g"))
    partitions = shuffle_partitions or int(os.environ.get("RAGSTONE_SHUFFLE_PARTITIONS", 0)) or None
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share, set on the context.

    A cluster names it in spark.checkpoint.dir; a temporary one is made in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named:
            context.setCheckpointDir(named)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="ragstone-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or context.getCheckpointDir()).rstrip("/")
