"""Mixing sources to target weights: a repetition rate per source, whole copies plus one hash-seeded Bernoulli copy.

Sources are ordered by code point, null last, and take the weights in turn. A source's target is its weighted share of
all sizes; a target stops at `max_repeats` times its source's size and the excess is shared again by weight among the
others until none is above. That fixed point is a water level: sources whose limit is at most their weight times the level
are full, the others share what is left. The level is found by sharing again until no further source is full, one sum
over the sources a step. Neither that nor the ranks gather the sources in one task, however many there are.

A document takes floor(rate) copies and one more with probability rate - floor(rate), decided by a hash of its id (of its
text, if the id is null), so reruns agree on any cluster.

Edge cases: a null text has size 0; a source without words has rate 0; documents with equal texts and null ids share one
draw; repeated rows take equal copies; an empty table gives an empty table; extra columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_of, whole


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeats: int = 3
    seed: str = "mix-1"
    #: Up to so many sources, the table of rates is broadcast; beyond, it is joined by source.
    broadcast_sources: int = 100_000


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def sized(docs: DataFrame, keep: list[str], config: MixConfig = MixConfig()) -> DataFrame:
    """`row`, a struct of the columns to keep, source, size (the number of words) and draw."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_of())))
    return docs.select(
        whole(keep).alias("row"),
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        draw(key, config.seed).alias("draw"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with `rank`, from 0, in the order of their names, null last.

    Ranges of names are numbered by themselves and shifted by the counts of the ranges before, one row a range."""
    order = F.col("source").asc_nulls_last()
    parts = staged(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("within", within).join(starts, "part").withColumn("rank", F.col("start") + F.col("within")).drop("part", "start", "within")


def water_level(sources: DataFrame) -> float | None:
    """The level at which all sizes are shared, None where every source is full. sources: source_size, most, weight, ratio."""
    level, full = -1.0, None
    while True:
        is_full = F.col("ratio") <= F.lit(level)
        got = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(is_full, F.col("most")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(is_full).alias("full"),
        ).first()
        if not got["open"]:
            return None
        if got["full"] == full:
            return level
        level, full = (got["total"] - got["taken"]) / got["open"], got["full"]


def source_rates(measured: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per source: of (its name), source_size, target, rate. measured: source, size."""
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(
        ranked(sizes)
        .withColumn("weight", F.get(weights, (F.col("rank") % len(config.weights)).cast("int")))
        .withColumn("most", (config.max_repeats * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight")),
        "mix-ranked",
    )
    level = water_level(sources)
    target = F.col("most") if level is None else F.when(F.col("ratio") <= level, F.col("most")).otherwise(F.col("weight") * F.lit(level))
    return sources.select(F.col("source").alias("of"), "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def mixed(docs: DataFrame, keep: list[str], config: MixConfig = MixConfig()) -> DataFrame:
    """row, size, source_size, target, rate and copies of every document.

    The rates have one row per source and are written and counted first: up to a bound they're broadcast, so that texts
    don't move; beyond it, Spark joins by source and splits hot ones."""
    measured = sized(docs, keep, config)
    rates = staged(source_rates(measured.select("source", "size"), config), "mix-rates")
    if rates.count() <= config.broadcast_sources:
        rates = F.broadcast(rates)
    joined = measured.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    whole_copies = F.floor(F.col("rate"))
    return joined.withColumn("copies", whole_copies + (F.col("draw") < F.col("rate") - whole_copies).cast("long"))


def mix_sources(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    copies = F.array_repeat(F.lit(True), F.col("copies").cast("int"))
    return mixed(docs, docs.columns, config).select("row", F.explode(copies)).select("row.*")


def mix_report(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixed(docs, ["doc_id"], config).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


#: The same rows in SQL: the level is found by trying every source as the first that isn't full.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k FROM w
), u AS (
  SELECT a.k, a.most / a.weight AS ratio,
         ((SELECT sum(source_size) FROM r) - coalesce((SELECT sum(b.most) FROM r b WHERE b.k < a.k), 0))
         / (SELECT sum(b.weight) FROM r b WHERE b.k >= a.k) AS unit
  FROM r a
), l AS (
  SELECT unit, k FROM u WHERE ratio > unit ORDER BY k LIMIT 1
), t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.k >= (SELECT k FROM l) THEN r.weight * (SELECT unit FROM l) ELSE r.most END AS target
  FROM r
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (floor(t.target / t.source_size)
            + CASE WHEN CAST('0x' || substr(sha256('mix-1:' || CAST(d.doc_id AS VARCHAR)), 1, 12) AS UBIGINT)::DOUBLE
                        / 281474976710656.0::DOUBLE
                        < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
