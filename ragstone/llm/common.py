"""What the corpus operators share: word rules, let-bindings, binary search and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.session import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def whole(columns: list[str]) -> Column:
    """A struct of these columns: what is computed next to it can't clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_at_most(ordered: Column, x: Column, bits: int = 31) -> Column:
    """How many elements of the ascending array are <= x, by binary search (array_position and filter are linear)."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= F.size(ordered)) & (F.get(ordered, found + step - 1) <= x), found + step
        ).otherwise(found),
    )


#: Paths of staged tables, by application.
_STAGED: dict[str, list[str]] = {}


def drop_staged(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Deletes this application's staged tables, once no result that reads them is needed; returns how many.

    first and last select among them in the order in which they were written."""
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    gone = paths[first:last]
    del paths[first:last]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """build() as a staged table; the tables that it staged on the way are dropped."""
    before = len(_STAGED.get(spark.sparkContext.applicationId, []))
    out = staged(build(), name)
    drop_staged(spark, before, -1)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends there, and lost executors cost nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about `most` bytes, or less if the session has it so, for what runs inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if before else most
    spark.conf.set(name, str(min(given, most) if given > 0 else most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def each(column: pa.Array) -> Iterator:
    """The values of an Arrow column, one at a time: a list of them would hold all texts of a batch once more."""
    return (x.as_py() for x in column)


def longs(values: list[int]) -> Column:
    """A literal array<bigint>; parsed from one string, so that long arrays stay one small expression."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")
