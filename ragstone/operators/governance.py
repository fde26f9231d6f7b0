"""Integrity checks, hashes of tables, column classes, blinding, and the seal on test rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("identifier", "feature", "outcome", "governance")


class SealedError(PermissionError):
    """Raised when sealed rows would be read."""


def checks(df: DataFrame, expected: dict[str, tuple[Column, object]]) -> DataFrame:
    """check_id, expected, observed, status (pass or fail), severity: one aggregation over df, one row per check."""
    observed = df.agg(*[c.cast("string").alias(k) for k, (c, _) in expected.items()])
    wanted = F.create_map(*[F.lit(x) for k, (_, v) in expected.items() for x in (k, str(v))])
    rows = observed.unpivot([], list(expected), "check_id", "observed").withColumn("expected", wanted[F.col("check_id")])
    status = F.when(F.col("observed") == F.col("expected"), "pass").otherwise("fail")
    return rows.select("check_id", "expected", "observed", status.alias("status"), F.lit("error").alias("severity"))


def leaking_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with their number of splits."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def unmatched(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """side, keys: keys of either side without a row on the other."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("keys")).withColumn("side", F.lit(name))
    return only(first, second, "first").unionByName(only(second, first, "second")).select("side", "keys")


def exactly_one(rows: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """rows with `matches`, how many target rows have their key; callers refuse any number but 1."""
    counted = target.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))
    return rows.join(counted, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def conflicting(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows aren't all equal."""
    rest = F.xxhash64(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.countDistinct(rest).alias("versions")).filter("versions > 1")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def symmetric_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    left = first.exceptAll(second).withColumn("side", F.lit("first"))
    return left.unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def canonical_line(df: DataFrame) -> Column:
    """A row as JSON with fields in alphabetical order and nulls kept; floats are left out of such hashes."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def table_hash(df: DataFrame) -> DataFrame:
    """rows, sha256: a hash of the multiset of rows that doesn't hang on order or partitions.

    Rows are hashed and 240 bits of their hashes are added up as four numbers, combined in every task before the shuffle:
    one row comes out of each, however large the table. Such a sum tells tables apart that differ by chance or mistake; it
    isn't made to withstand rows that someone constructs to collide."""
    line = F.sha2(canonical_line(df), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    summed = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)])
    return summed.select("rows", F.sha2(text, 256).alias("sha256"))


def null_manifest(df: DataFrame) -> DataFrame:
    """feature, nulls, rows for every column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns], F.count(F.lit(1)).alias("__rows"))
    return counted.unpivot(["__rows"], df.columns, "feature", "nulls").select("feature", "nulls", F.col("__rows").alias("rows"))


@dataclass(frozen=True)
class Registry:
    """Which class each column has; only features may reach a model."""

    classes: dict[str, str]

    def __post_init__(self) -> None:
        odd = sorted(set(self.classes.values()) - set(CLASSES))
        if odd:
            raise ValueError(f"unknown column classes: {odd}")

    def validate(self, columns: Iterable[str]) -> list[str]:
        columns = list(columns)
        bad = [c for c in columns if self.classes.get(c) != "feature"]
        if bad:
            raise ValueError(f"not features: {bad}")
        return columns

    def annotated(self, df: DataFrame) -> DataFrame:
        """df whose columns carry their class as metadata."""
        return df.select(*[F.col(f"`{c}`").alias(c, metadata={"class": self.classes.get(c, "governance")}) for c in df.columns])


def open_splits(df: DataFrame, allowed: Iterable[str], split: str = "split") -> DataFrame:
    """Rows of the allowed splits; asking for the sealed test split is an error, whoever asks."""
    allowed = list(allowed)
    if "test" in allowed:
        raise SealedError("the test split is sealed")
    return df.filter(F.col(split).isin(allowed))


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def cache_key(kind: str, inputs: dict) -> str:
    """The name under which a result of these inputs is kept."""
    return config_hash({"kind": kind, "inputs": inputs})


def blinded_pack(sample: DataFrame, key: str, shown: list[str], hidden: list[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """(what annotators see, the answer key), for a sample of bounded size: ids are hashes, and `place` numbers the rows in
    the order of another hash, which says nothing of the strata."""
    digest = lambda *parts: F.sha2(F.concat_ws("|", F.lit(seed), *parts, F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.orderBy(digest(F.lit("order")))).cast("long")
    tagged = sample.withColumns({"sample_id": digest(), "place": place})
    return tagged.select("sample_id", "place", *shown), tagged.select("sample_id", key, *hidden)


def scalar_reject(columns: Iterable[str], forbidden: Iterable[str]) -> None:
    bad = sorted(set(columns) & set(forbidden))
    if bad:
        raise ValueError(f"forbidden fields: {bad}")
