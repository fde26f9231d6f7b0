"""Resumable work: append-only results by key, with the same rules in batch and in micro-batches.

There is no unbounded source in the batch pipelines; a stream of keyed rows can still be taken in by append_stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.operators.governance import conflicting


class StaleError(ValueError):
    """Raised when kept results belong to another configuration or contradict each other."""


def kept(spark: SparkSession, path: str, key: list[str], config_sha256: str) -> DataFrame | None:
    """The rows kept so far, one per key, or None. Rows of another configuration and keys with unequal rows are errors."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    if not rows.filter(F.col("config_sha256") != config_sha256).isEmpty():
        raise StaleError("kept rows belong to another configuration")
    if not conflicting(rows, key).isEmpty():
        raise StaleError("kept rows contradict each other")
    return rows.dropDuplicates(key)


def remaining(expected: DataFrame, done: DataFrame | None, key: list[str]) -> DataFrame:
    return expected if done is None else expected.join(done.select(*key), key, "left_anti")


def append(rows: DataFrame, path: str, key: list[str], config_sha256: str) -> int:
    """Appends the rows whose keys aren't there yet; returns how many. Running it again appends nothing."""
    fresh = remaining(rows.dropDuplicates(key), kept(rows.sparkSession, path, key, config_sha256), key).withColumn(
        "config_sha256", F.lit(config_sha256)
    )
    # Counted after the write, from the files: the rows may be costly to make.
    before = _count(rows.sparkSession, path)
    fresh.write.mode("append").parquet(path)
    return _count(rows.sparkSession, path) - before


def _count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return 0


def append_stream(stream: DataFrame, path: str, key: list[str], config_sha256: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Starts a query that does the work on each micro-batch's new keys and appends it; replays append nothing twice."""

    def take(batch: DataFrame, _: int) -> None:
        todo = remaining(batch.dropDuplicates(key), kept(batch.sparkSession, path, key, config_sha256), key)
        append(work(todo), path, key, config_sha256)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
