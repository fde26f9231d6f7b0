"""Queries on selective answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import policy as P
from ragstone.operators.metrics import grid

from .fixtures import PREDICTIONS, TRAJECTORIES, predictions, trajectories
from .metrics import rounded
from .registry import query

W = f"WITH {PREDICTIONS}"
CURVE = f"""{W}, c AS (SELECT p, count(*) AS n, sum(1 - y) AS u FROM predictions GROUP BY p), t AS (SELECT count(*) AS total, min(p) AS least, sum(1 - y) AS u FROM predictions),
pts AS (SELECT p AS threshold, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS answered, sum(u) OVER (ORDER BY p DESC) AS unsafe FROM c),
al AS (SELECT NULL::DOUBLE AS threshold, 0::BIGINT AS answered, 0 AS unsafe UNION ALL SELECT * FROM pts UNION ALL SELECT 0.0, total, u FROM t WHERE least > 0),
curve AS (SELECT threshold, answered, answered::DOUBLE / total AS coverage, CASE WHEN answered > 0 THEN unsafe::DOUBLE / answered END AS risk FROM al, t)"""
RISKS = [0.05, 0.1, 0.14, 0.2]
TWENTIETHS = [i / 20 for i in range(21)]
POLICY = f"""{W}, {TRAJECTORIES}, v AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS v), pairs AS (SELECT a.v AS low, b.v AS high FROM v a, v b WHERE a.v < b.v),
a AS (SELECT low, high, y5, y10, CASE WHEN p5 >= high THEN 'answer_k5' WHEN p5 < low THEN 'abstain_k5' WHEN p10 >= high THEN 'answer_k10' ELSE 'abstain_k10' END AS action FROM trajectories, pairs),
m AS (SELECT low, high, CAST(count(*) FILTER (WHERE action LIKE 'answer%') AS BIGINT) AS answered, count(*)::DOUBLE AS total,
  count(*) FILTER (WHERE (action = 'answer_k5' AND y5 = 0) OR (action = 'answer_k10' AND y10 = 0)) AS unsafe, count(*) FILTER (WHERE action LIKE '%k10') AS expanded,
  count(*) FILTER (WHERE action LIKE 'abstain%' AND y10 = 1) AS missed, count(*) FILTER (WHERE y10 = 1) AS could FROM a GROUP BY low, high),
grid AS (SELECT low, high, answered, answered / total AS coverage, CASE WHEN answered > 0 THEN unsafe::DOUBLE / answered END AS risk, expanded / total AS expansion,
  CASE WHEN could > 0 THEN missed::DOUBLE / could END AS false_abstention, 5 + 5 * (expanded / total) AS mean_k FROM m)"""


def curve(spark, sf_dir):
    return P.risk_coverage(predictions(spark, sf_dir), "y", "p")


def policies(spark, sf_dir):
    return P.policy_grid(trajectories(spark, sf_dir), P.threshold_pairs(spark, TWENTIETHS))


@query(CURVE + " SELECT threshold, answered, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def risk_coverage_curve(spark, sf_dir):
    return rounded(curve(spark, sf_dir).drop("step"))


@query(CURVE + ", l AS (SELECT *, coverage - lag(coverage, 1, 0) OVER (ORDER BY coverage, threshold DESC) AS width FROM curve) SELECT round(sum(width * risk), 6) AS aurc FROM l WHERE risk IS NOT NULL")
def aurc(spark, sf_dir):
    return rounded(P.aurc(curve(spark, sf_dir)))


@query(CURVE + """, k AS (SELECT unnest([0.05, 0.1, 0.14, 0.2])::DOUBLE AS "constraint"), f AS (SELECT k."constraint", c.*, row_number() OVER (PARTITION BY k."constraint" ORDER BY c.coverage DESC, c.threshold DESC) AS n
  FROM k JOIN curve c ON c.risk <= k."constraint" AND c.threshold IS NOT NULL)
SELECT k."constraint", f.coverage IS NOT NULL AS feasible, f.threshold, round(f.coverage, 6) AS coverage, round(f.risk, 6) AS risk FROM k LEFT JOIN f ON f."constraint" = k."constraint" AND f.n = 1""")
def risk_operating_points(spark, sf_dir):
    return rounded(P.operating_points(curve(spark, sf_dir), grid(spark, RISKS, "constraint")))


@query(POLICY + " SELECT low, high, answered, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(expansion, 6) AS expansion, round(false_abstention, 6) AS false_abstention, round(mean_k, 6) AS mean_k FROM grid")
def policy_grid(spark, sf_dir):
    return rounded(policies(spark, sf_dir))


@query(POLICY + """, k AS (SELECT unnest([0.05, 0.1, 0.14, 0.2])::DOUBLE AS "constraint"), f AS (SELECT k."constraint", g.*, row_number() OVER (PARTITION BY k."constraint" ORDER BY g.coverage DESC, g.expansion, g.high DESC, g.low DESC) AS n FROM k JOIN grid g ON g.risk <= k."constraint")
SELECT k."constraint", f.low, f.high, round(f.coverage, 6) AS coverage, round(f.risk, 6) AS risk, round(f.expansion, 6) AS expansion FROM k LEFT JOIN f ON f."constraint" = k."constraint" AND f.n = 1""")
def policy_select(spark, sf_dir):
    return rounded(P.select_policy(policies(spark, sf_dir), grid(spark, RISKS, "constraint")))


@query(f"""{W}, {TRAJECTORIES}, g AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS threshold),
x AS (SELECT threshold, count(*)::DOUBLE AS total, count(*) FILTER (WHERE p5 >= threshold) AS a, count(*) FILTER (WHERE p5 >= threshold AND y5 = 0) AS u, count(*) FILTER (WHERE p5 < threshold AND y5 = 1) AS m, count(*) FILTER (WHERE y5 = 1) AS c FROM trajectories, g GROUP BY threshold)
SELECT threshold, round(a / total, 6) AS coverage, CASE WHEN a > 0 THEN round(u::DOUBLE / a, 6) END AS risk, CASE WHEN c > 0 THEN round(m::DOUBLE / c, 6) END AS false_abstention FROM x""")
def two_way_baseline(spark, sf_dir):
    return rounded(P.two_way(trajectories(spark, sf_dir), grid(spark, TWENTIETHS), 5))


ACTIONS = f"""{W}, {TRAJECTORIES}, a AS (SELECT question_id, CASE WHEN p5 >= 0.7 THEN 'answer_k5' WHEN p5 < 0.3 THEN 'abstain_k5' WHEN p10 >= 0.7 THEN 'answer_k10' ELSE 'abstain_k10' END AS action FROM trajectories),
st AS (SELECT question_id, 5 AS k, p5 AS quality FROM trajectories UNION ALL SELECT question_id, 10, p10 FROM trajectories),
view_ AS (SELECT c.question_id, c.action, c.k, st.quality FROM (SELECT *, CAST(CASE action WHEN 'answer_k5' THEN 5 WHEN 'answer_k10' THEN 10 END AS INTEGER) AS k FROM a) c LEFT JOIN st ON st.question_id = c.question_id AND st.k = c.k)"""


def views(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    acted = t.select("question_id", P.action(F.col("p5"), F.col("p10"), F.lit(0.3), F.lit(0.7)).alias("action"))
    states = t.select("question_id", F.lit(5).alias("k"), F.col("p5").alias("quality")).unionByName(
        t.select("question_id", F.lit(10).alias("k"), F.col("p10").alias("quality"))
    )
    return P.policy_view(acted, states)


@query(ACTIONS + " SELECT * FROM view_")
def policy_trajectory_views(spark, sf_dir):
    return views(spark, sf_dir).select("question_id", "action", "k", "quality")


@query(ACTIONS + " SELECT CAST(count(*) AS BIGINT) AS questions, CAST(count(k) AS BIGINT) AS answered, CAST(count(quality) AS BIGINT) AS defined, round(avg(quality), 6) AS mean_defined, round(sum(coalesce(quality, 0)) / count(*), 6) AS utility, round(count(k)::DOUBLE / count(*), 6) AS coverage FROM view_")
def policy_generation_summary(spark, sf_dir):
    return rounded(P.policy_summary(views(spark, sf_dir), "quality"))


@query(f"""{W}, {TRAJECTORIES}, x AS (SELECT 5 AS k, y5 AS y, p5 AS q FROM trajectories UNION ALL SELECT 10, y10, p10 FROM trajectories)
SELECT CAST(k AS INTEGER) AS k, CAST(y AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n, round(avg(q), 6) AS mean_quality, round(median(q), 6) AS median_quality FROM x GROUP BY k, y""")
def sufficiency_k_summary(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    both = t.select(F.lit(5).alias("k"), F.col("y5").alias("y"), F.col("p5").alias("q")).unionByName(
        t.select(F.lit(10).alias("k"), F.col("y10").alias("y"), F.col("p10").alias("q"))
    )
    return rounded(both.groupBy("k", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_quality"), F.median("q").alias("median_quality")))


@query(f"""{W}, b AS (SELECT CASE WHEN p >= 0.7 THEN 'answer' WHEN p >= 0.4 THEN 'expand' ELSE 'abstain' END AS region, y FROM predictions)
SELECT region, CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS label_0, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS label_1 FROM b GROUP BY region""")
def decision_regions(spark, sf_dir):
    region = F.when(F.col("p") >= 0.7, "answer").when(F.col("p") >= 0.4, "expand").otherwise("abstain")
    crossed = predictions(spark, sf_dir).groupBy(region.alias("region")).pivot("y", [0, 1]).agg(F.count(F.lit(1)))
    return crossed.select("region", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"label_{y}") for y in (0, 1)])
