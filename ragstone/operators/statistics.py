"""Resampling, rank tests, exact tests and multiple comparisons, from windows and aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ragstone.functions.vectors import draw, normal_tail, ratio

from .metrics import average_rank
from .ordering import numbered


def complete_pairs(df: DataFrame, first: str, second: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows where both are known, one row with the excluded and the repeated keys, which the caller refuses)."""
    known = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    excluded = df.agg(F.count_if(F.col(first).isNull() | F.col(second).isNull()).alias("excluded"), (F.count(key) - F.countDistinct(key)).alias("repeated"))
    return known, excluded


def draws(clusters: DataFrame, cluster: str, replicates: int, seed: str) -> DataFrame:
    """replicate, cluster, times: how often each replicate draws each cluster, with replacement.

    Draw i of a replicate is a hash of (seed, replicate, i) modulo the number of clusters, so any engine draws alike.
    Counting first keeps one row per replicate and drawn cluster; the rows of a cluster are weighted, never copied."""
    placed = numbered(clusters.select(cluster).distinct(), "place", cluster)
    n = clusters.select(cluster).distinct().agg(F.count(F.lit(1)).alias("n"))
    spark = clusters.sparkSession
    tries = (
        spark.range(replicates)
        .select(F.col("id").alias("replicate"))
        .crossJoin(F.broadcast(n))
        .select("replicate", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
        .select("replicate", draw(F.lit(seed), [F.col("replicate"), F.col("i")], F.col("n")).alias("place"))
    )
    return tries.groupBy("replicate", "place").agg(F.count(F.lit(1)).alias("times")).join(placed, "place").select("replicate", cluster, "times")


def bootstrap_means(df: DataFrame, cluster: str, values: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """replicate and the mean of each value, all statistics on the same draws. Clusters are summed before they meet the
    draws, so the join carries a row per replicate and cluster, whatever the rows of a cluster."""
    sums = [F.sum(v).alias(f"{v}_sum") for v in values] + [F.count(v).alias(f"{v}_n") for v in values]
    per = df.groupBy(cluster).agg(*sums)
    drawn = draws(df, cluster, replicates, seed).join(per, cluster)
    mean = lambda v: ratio(F.sum(F.col("times") * F.col(f"{v}_sum")), F.sum(F.col("times") * F.col(f"{v}_n")))
    return drawn.groupBy("replicate").agg(*[mean(v).alias(v) for v in values])


def interval(replicated: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """value, lower, upper, replicates, dropped: exact linear percentiles; undefined replicates are dropped and counted."""
    tail = (1 - level) / 2
    return replicated.agg(
        F.lit(value).alias("statistic"),
        F.percentile(value, F.lit(tail)).alias("lower"),
        F.percentile(value, F.lit(1 - tail)).alias("upper"),
        F.count(value).alias("replicates"),
        (F.count(F.lit(1)) - F.count(value)).alias("dropped"),
    )


def holm(tests: DataFrame, family: str, p: str, key: str) -> DataFrame:
    """Step-down adjusted p-values within a family, with rank: a running maximum of (m - i + 1) * p, at most 1."""
    order = Window.partitionBy(family).orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    rank = F.row_number().over(order)
    return tests.withColumn("rank", rank).withColumn("raised", (m - F.col("rank") + 1) * F.col(p)).withColumn(
        "p_holm", F.least(F.lit(1.0), F.max("raised").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ).drop("raised")


def _two_groups(df: DataFrame, group: Column, value: str, by: list[str]) -> DataFrame:
    """Per by: n1, n0, the rank sum of group 1, and the sum of t^3 - t over ties."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(
        F.count_if(group).alias("__in"), F.count_if(~group).alias("__out")
    )
    inside, n = F.col("__in"), F.col("__in") + F.col("__out")
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        counted.withColumn("__rank", before + (n + 1) / 2.0)
        .groupBy(*by)
        .agg(
            F.sum("__in").alias("n1"),
            F.sum("__out").alias("n0"),
            F.sum(inside * F.col("__rank")).alias("rank_sum"),
            F.sum(n.cast("double") * n * n - n).alias("ties"),
        )
    )


def mann_whitney(df: DataFrame, group: Column, value: str, by: list[str]) -> DataFrame:
    """u (of group 1), p (two-sided normal approximation with tie and continuity correction), cliffs_delta."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / spread
    return _two_groups(df, group, value, by).select(
        *by, "n1", "n0", u.alias("u"),
        F.when(spread > 0, F.least(F.lit(1.0), 2 * normal_tail(z))).alias("p"),
        ratio(2 * u - n1 * n0, n1 * n0).alias("cliffs_delta"),
    )


def wilcoxon_pratt(df: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """w (the smaller signed rank sum), p, rank_biserial: zeros are ranked and then dropped; all zeros give (0, 1, 0)."""
    known = df.filter(F.col(difference).isNotNull()).withColumn("size", F.abs(difference))
    rank = average_rank("size", by)
    d, r = F.col(difference), F.col("r")
    summed = (
        known.withColumn("r", rank)
        .groupBy(*by)
        .agg(
            F.sum(F.when(d > 0, r).otherwise(0.0)).alias("plus"),
            F.sum(F.when(d < 0, r).otherwise(0.0)).alias("minus"),
            F.count(F.lit(1)).cast("double").alias("n"),
            F.count_if(d == 0).cast("double").alias("zeros"),
        )
    )
    tied = known.filter(d != 0).groupBy(*by, "size").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*by).agg(
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties")
    )
    n, z0 = F.col("n"), F.col("zeros")
    mean = (n * (n + 1) - z0 * (z0 + 1)) / 4
    variance = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - F.coalesce("ties", F.lit(0.0)) / 48
    w = F.least("plus", "minus")
    p = F.when(n == z0, 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(F.abs(w - mean) / F.sqrt(variance))))
    return summed.join(tied, by, "left").select(
        *by, w.alias("w"), p.alias("p"), F.coalesce(ratio(F.col("plus") - F.col("minus"), F.col("plus") + F.col("minus")), F.lit(0.0)).alias("rank_biserial")
    )


def transitions(df: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """Paired 2x2 counts and how many pairs were left out for a null."""
    a, b = F.col(first), F.col(second)
    return df.groupBy(*by).agg(
        F.count_if((a == 0) & (b == 0)).alias("n00"),
        F.count_if((a == 0) & (b == 1)).alias("n01"),
        F.count_if((a == 1) & (b == 0)).alias("n10"),
        F.count_if((a == 1) & (b == 1)).alias("n11"),
        F.count_if(a.isNull() | b.isNull()).alias("excluded"),
    )


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided binomial p of discordant counts; 1 without any."""

    def p(b: int, c: int) -> float:
        n, k = int(b + c), int(min(b, c))
        if n == 0:
            return 1.0
        log_half = n * math.log(0.5)
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + log_half) for i in range(k + 1))
        return min(1.0, 2 * tail)

    return pd.Series([p(x, y) for x, y in zip(b, c)])


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p of a 2x2 table: tables with the same margins that are no likelier than this one."""

    def p(a: int, b: int, c: int, d: int) -> float:
        row, column, n = a + b, a + c, a + b + c + d
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        each = [
            choose(row, x) + choose(n - row, column - x) - choose(n, column)
            for x in range(max(0, row + column - n), min(row, column) + 1)
        ]
        here = each[a - max(0, row + column - n)]
        return min(1.0, sum(math.exp(x) for x in each if x <= here + 1e-7))

    return pd.Series([p(*map(int, t)) for t in zip(a, b, c, d)])


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Only if all cells are positive."""
    return F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), (a.cast("double") * d) / (b.cast("double") * c))


def guarded(point: Column, lower: Column, upper: Column, n: Column, least: int) -> list[Column]:
    """A point with bounds only from `least` rows on."""
    return [point.alias("point"), F.when(n >= least, lower).alias("lower"), F.when(n >= least, upper).alias("upper")]
