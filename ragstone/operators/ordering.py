"""Sums and places along a global order, without a task that sees all rows.

The order is cut into buckets by a function that never falls along it. Sums of buckets, a small table, give where each
bucket starts; inside buckets, windows go on from there. The cut depends on the value alone, so that every evaluation of
a plan cuts alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def bucket(value: Column, kind: str) -> Column:
    """A long that doesn't fall as the value rises; null for null.

    Numbers are cut by their logarithm, so fractions and large numbers alike get many buckets, and no more than some
    millions exist for any data; texts are cut by their first two characters."""
    if kind.startswith("decimal") or kind in NUMBERS:
        x = value.cast("double")
        return (F.signum(x) * F.floor(1024 * F.log2(1 + F.abs(x) * float(1 << 20)))).cast("long")
    first, second = (F.ascii(F.substring(value, i, 1)).cast("long") for i in (1, 2))
    return first * F.lit(1 << 21) + second


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def running(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False, ties: list[str] = ()) -> DataFrame:
    """df with before_<sum> for each of the columns: their total over the group's rows that come earlier in the order
    (nulls last), rows of equal order by `ties`."""
    kind = dict(df.dtypes)[order]
    cut = df.withColumn("__cut", bucket(F.col(order), kind))
    way = (lambda c: F.desc_nulls_last(c)) if descending else (lambda c: F.asc_nulls_last(c))
    keys = [*by, "__cut"]
    totals = cut.groupBy(*keys).agg(*[F.sum(s).alias(f"__all_{s}") for s in sums])
    ahead = Window.partitionBy(*by).orderBy(way("__cut")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"__all_{s}").over(ahead), F.lit(0)).alias(f"__from_{s}") for s in sums])
    inside = Window.partitionBy(*keys).orderBy(way(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"__in_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    joined = local.alias("l").join(starts.alias("s"), _same(keys, "l", "s"))
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], *[(F.col(f"__in_{s}") + F.col(f"__from_{s}")).alias(f"before_{s}") for s in sums])


def numbered(df: DataFrame, name: str, order: str, descending: bool = False, ties: list[str] = ()) -> DataFrame:
    """df with `name`, the place of each row from 0 on."""
    counted = running(df.withColumn("__one", F.lit(1).cast("long")), [], order, ["__one"], descending, ties)
    return counted.drop("__one").withColumnRenamed("before___one", name)
