"""Vector and scalar numerics as columns, in doubles throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound, cut to [0, 1]; null without trials."""
    n = trials.cast("double")
    p = ratio(successes, trials)
    wide = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / wide
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / wide
    seen = trials > 0
    return F.when(seen, F.greatest(F.lit(0.0), centre - half)), F.when(seen, F.least(F.lit(1.0), centre + half))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the continued expansion of Abramowitz and Stegun 26.2.17 (7.5e-8)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def draw(seed: Column, parts: list[Column], n: Column) -> Column:
    """A whole number in [0, n) from a hash of seed and parts, the same in any engine that has SHA-256."""
    digest = F.sha2(F.concat_ws("|", seed, *[p.cast("string") for p in parts]), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), n.cast("long"))


def rounded_as_sql(x: Column, digits: int = 6) -> Column:
    """x rounded as DuckDB does it, by the scaled double; F.round() goes by the shortest decimal, which may be a tie that
    the double isn't."""
    return F.round(x * float(10**digits)) / float(10**digits)
