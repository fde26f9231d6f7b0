"""Queries on report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import reports as T

from .fixtures import PREDICTIONS, predictions, table
from .metrics import rounded
from .registry import query

W = f"WITH {PREDICTIONS}"
PER = "s AS (SELECT lang, split, count(*)::DOUBLE AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM predictions GROUP BY lang, split)"


def per_split(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("lang", "split").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


@query(f"""{W}, {PER} SELECT lang, split, 'n' AS metric, round(n, 6) AS value FROM s UNION ALL SELECT lang, split, 'mean_p', round(mean_p, 6) FROM s UNION ALL SELECT lang, split, 'mean_y', round(mean_y, 6) FROM s""")
def metrics_long_unpivot(spark, sf_dir):
    return rounded(T.long_metrics(per_split(spark, sf_dir), ["lang", "split"], ["n", "mean_p", "mean_y"]))


@query(f"""{W}, {PER}, w AS (SELECT lang, max(CASE WHEN split = 'validation' THEN mean_p END) AS validation, max(CASE WHEN split = 'test' THEN mean_p END) AS test FROM s GROUP BY lang)
SELECT lang, round(validation, 6) AS validation, round(test, 6) AS test, round(test - validation, 6) AS difference, CASE WHEN test - validation IS NULL THEN 'undefined' WHEN test > validation THEN 'higher' WHEN test < validation THEN 'lower' ELSE 'equal' END AS direction FROM w""")
def validation_test_pivot(spark, sf_dir):
    return rounded(T.compared(per_split(spark, sf_dir), ["lang"], "split", "mean_p", "validation", "test"))


@query("""WITH b AS (SELECT CAST(least(greatest(floor(l_discount * 200), 0), 19) AS INTEGER) AS bin FROM lineitem), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN c ON c.bin = r.bin""")
def paired_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 200).alias("v"))
    return T.histogram(rows, "v", 0.0, 20.0, 20)


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 10""")
def top_sources(spark, sf_dir):
    return rounded(T.top_share(table(spark, sf_dir, "documents"), "source", 10))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) SELECT lang, doc_id FROM r WHERE nth <= 3 ORDER BY lang, nth LIMIT 15""")
def case_sample(spark, sf_dir):
    return T.first_per_category(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 3, 15)


@query("""SELECT n_name AS nation, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(o_orderkey) AS BIGINT) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def star_join_summary(spark, sf_dir):
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return (
        nation.select("n_nationkey", F.col("n_name").alias("nation"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(orders.select("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy("nation")
        .agg(
            F.countDistinct("c_custkey").alias("customers"),
            F.count("o_orderkey").alias("orders"),
            F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"),
        )
    )
