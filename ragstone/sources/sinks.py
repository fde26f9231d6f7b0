"""Sinks: canonical Parquet and CSV, immutable writes, and figure data."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.operators.governance import table_hash


class ImmutableError(ValueError):
    """Raised when a written result would be replaced by another."""


def _hash(df: DataFrame) -> tuple[int, str]:
    row = table_hash(df).first()
    return row["rows"], row["sha256"]


def write_parquet(df: DataFrame, path: str, fields: list[str], key: list[str], files: int | None = None) -> dict:
    """Fixed columns, total order by key, zstd; returns rows and the hash of the rows, which says whether two results
    are the same however they're laid out. The order is by ranges, so files follow each other; no task holds all rows."""
    ordered = df.select(*fields)
    ordered = ordered.repartitionByRange(files, *key) if files else ordered.repartitionByRange(*key)
    ordered.sortWithinPartitions(*key).write.option("compression", "zstd").mode("errorifexists").parquet(path)
    rows, sha256 = _hash(df.sparkSession.read.parquet(path))
    return {"rows": rows, "semantic_sha256": sha256}


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, booleans as true and false, so that any table fits CSV."""
    nested = lambda kind: kind.startswith(("array", "struct", "map"))
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if nested(t) else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, fields: list[str], key: list[str]) -> None:
    """LF line ends, null as the empty field, header, ordered by key; a column outside `fields` is an error."""
    extra = [c for c in df.columns if c not in fields]
    if extra:
        raise ValueError(f"columns without a place: {extra}")
    ordered = flattened(df.select(*fields)).repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.write.option("header", True).option("nullValue", "").option("emptyValue", '""').option("lineSep", "\n").mode("errorifexists").csv(path)


def write_immutable(df: DataFrame, path: str) -> str:
    """Writes once; a second write is allowed only if the rows are the same, and then does nothing. `written` or `same`."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return "written"
    if sorted(there.dtypes) != sorted(df.dtypes) or _hash(there) != _hash(df):
        raise ImmutableError(f"{path} holds another result")
    return "same"


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file (a JSON artifact, Markdown, SVG) on any file system Spark knows, atomically: written aside, then
    renamed. A file that is there must have the same content. `written` or `same`."""
    jvm = spark._jvm.org.apache.hadoop.fs
    place, aside = jvm.Path(path), jvm.Path(path + ".tmp")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place):
        there = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        if there != text:
            raise ImmutableError(f"{path} holds another result")
        return "same"
    stream = system.create(aside, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if not system.rename(aside, place):
        raise OSError(f"can't rename to {path}")
    return "written"


def write_json(spark: SparkSession, path: str, value: object) -> str:
    """A JSON artifact: sorted keys, UTF-8, two spaces, a line end; numbers that JSON lacks are errors."""
    return write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n")
