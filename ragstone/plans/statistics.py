"""Queries on inferential statistics: documents grouped by source, events paired by user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.functions.vectors import normal_tail
from ragstone.operators import policy as P
from ragstone.operators import statistics as S

from .fixtures import PREDICTIONS, TRAJECTORIES, predictions, table, trajectories
from .metrics import rounded
from .registry import query

W = f"WITH {PREDICTIONS}"
REPLICATES = 200
DRAWS = """cl AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS place FROM (SELECT DISTINCT {c} FROM {t})), nn AS (SELECT count(*) AS n FROM cl),
tr AS (SELECT r.replicate, CAST(CAST('0x' || substr(sha256('42|' || r.replicate || '|' || i.i), 1, 12) AS UBIGINT) % (SELECT n FROM nn) AS BIGINT) AS place FROM (SELECT unnest(range({r})) AS replicate) r, (SELECT unnest(range((SELECT n FROM nn))) AS i) i),
dr AS (SELECT tr.replicate, cl.{c}, count(*) AS times FROM tr JOIN cl ON cl.place = tr.place GROUP BY ALL)"""
TAIL = "CASE WHEN {z} >= 0 THEN {u} ELSE 1 - {u} END"


def upper(z: str) -> str:
    """The same expansion of the normal tail in SQL."""
    t = f"(1/(1+0.2316419::DOUBLE*abs({z})))"
    poly = f"{t}*(0.319381530::DOUBLE+{t}*(-0.356563782::DOUBLE+{t}*(1.781477937::DOUBLE+{t}*(-1.821255978::DOUBLE+{t}*1.330274429::DOUBLE))))"
    return TAIL.format(z=z, u=f"(exp(-({z})*({z})/2)/2.5066282746310002::DOUBLE*({poly}))")


@query(f"""{W}, {DRAWS.format(c='source', t='predictions', r=REPLICATES)}, per AS (SELECT source, sum(p) AS ps, sum(y) AS ys, count(*) AS n FROM predictions GROUP BY source),
m AS (SELECT replicate, sum(times * ps) / sum(times * n) AS p, sum(times * ys)::DOUBLE / sum(times * n) AS y FROM dr JOIN per USING (source) GROUP BY replicate)
SELECT 'p' AS statistic, round(quantile_cont(p, 0.025), 6) AS lower, round(quantile_cont(p, 0.975), 6) AS upper, CAST(count(p) AS BIGINT) AS replicates, CAST(count(*) - count(p) AS BIGINT) AS dropped FROM m
UNION ALL SELECT 'y', round(quantile_cont(y, 0.025), 6), round(quantile_cont(y, 0.975), 6), count(y), count(*) - count(y) FROM m""")
def bootstrap_cluster_ci(spark, sf_dir):
    means = S.bootstrap_means(predictions(spark, sf_dir), "source", ["p", "y"], REPLICATES, "42")
    return rounded(S.interval(means, "p").unionByName(S.interval(means, "y")))


@query(f"""{W}, {DRAWS.format(c='source', t='predictions', r=REPLICATES)}, per AS (SELECT source, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM predictions GROUP BY source),
m AS (SELECT replicate, sum(times * tp)::DOUBLE AS tp, sum(times * fp)::DOUBLE AS fp, sum(times * fn)::DOUBLE AS fn FROM dr JOIN per USING (source) GROUP BY replicate), f AS (SELECT CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM m)
SELECT 'f1' AS statistic, round(quantile_cont(f1, 0.025), 6) AS lower, round(quantile_cont(f1, 0.975), 6) AS upper, CAST(count(f1) AS BIGINT) AS replicates, CAST(count(*) - count(f1) AS BIGINT) AS dropped FROM f""")
def bootstrap_classifier_f1(spark, sf_dir):
    said, y = F.col("p") >= 0.5, F.col("y")
    rows = predictions(spark, sf_dir)
    per = rows.groupBy("source").agg(F.count_if(said & (y == 1)).alias("tp"), F.count_if(said & (y == 0)).alias("fp"), F.count_if(~said & (y == 1)).alias("fn"))
    drawn = S.draws(rows, "source", REPLICATES, "42").join(per, "source")
    n = lambda c: F.sum(F.col("times") * F.col(c)).cast("double").alias(c)
    cells = drawn.groupBy("replicate").agg(n("tp"), n("fp"), n("fn"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return rounded(S.interval(cells.withColumn("f1", f1), "f1"))


@query(f"""{W}, {TRAJECTORIES}, {DRAWS.format(c='source', t='trajectories', r=REPLICATES)}, a AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE p5 >= 0.7 OR (p5 >= 0.3 AND p10 >= 0.7)) AS answered, count(*) FILTER (WHERE (p5 >= 0.7 AND y5 = 0) OR (p5 < 0.7 AND p5 >= 0.3 AND p10 >= 0.7 AND y10 = 0)) AS unsafe FROM trajectories GROUP BY source),
m AS (SELECT replicate, sum(times * answered)::DOUBLE / sum(times * n) AS coverage, CASE WHEN sum(times * answered) > 0 THEN sum(times * unsafe)::DOUBLE / sum(times * answered) END AS risk FROM dr JOIN a USING (source) GROUP BY replicate)
SELECT 'coverage' AS statistic, round(quantile_cont(coverage, 0.025), 6) AS lower, round(quantile_cont(coverage, 0.975), 6) AS upper, CAST(count(coverage) AS BIGINT) AS replicates, CAST(count(*) - count(coverage) AS BIGINT) AS dropped FROM m
UNION ALL SELECT 'risk', round(quantile_cont(risk, 0.025), 6), round(quantile_cont(risk, 0.975), 6), count(risk), count(*) - count(risk) FROM m""")
def bootstrap_policy(spark, sf_dir):
    rows = trajectories(spark, sf_dir).withColumn("action", P.action(F.col("p5"), F.col("p10"), F.lit(0.3), F.lit(0.7)))
    answered = F.col("action").startswith("answer")
    y = F.when(F.col("action").endswith("k10"), F.col("y10")).otherwise(F.col("y5"))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(answered).alias("answered"), F.count_if(answered & (y == 0)).alias("unsafe"))
    drawn = S.draws(rows, "source", REPLICATES, "42").join(per, "source")
    n = lambda c: F.sum(F.col("times") * F.col(c)).cast("double")
    means = drawn.groupBy("replicate").agg((n("answered") / n("n")).alias("coverage"), F.when(n("answered") > 0, n("unsafe") / n("answered")).alias("risk"))
    return rounded(S.interval(means, "coverage").unionByName(S.interval(means, "risk")))


@query("""WITH t AS (SELECT event_type AS family, user_id AS comparison_id, 1.0::DOUBLE / (1 + count(*)) AS p FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, comparison_id) AS rank, count(*) OVER (PARTITION BY family) AS m FROM t)
SELECT family, comparison_id, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank, round(least(1, max((m - rank + 1) * p) OVER (PARTITION BY family ORDER BY rank)), 6) AS p_holm FROM r""")
def holm_by_family(spark, sf_dir):
    tests = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family"), F.col("user_id").alias("comparison_id")).agg((1.0 / (1 + F.count(F.lit(1)))).alias("p"))
    return rounded(S.holm(tests, "family", "p", "comparison_id"))


MW = f"""{W}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS r FROM predictions),
ti AS (SELECT lang, sum(t * t * t - t) AS ties FROM (SELECT lang, count(*)::DOUBLE AS t FROM predictions GROUP BY lang, p) GROUP BY lang),
g AS (SELECT lang, sum(y)::DOUBLE AS n1, (count(*) - sum(y))::DOUBLE AS n0, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs FROM r GROUP BY lang),
u AS (SELECT g.*, rs - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM g JOIN ti USING (lang)),
z AS (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sd AS z FROM u)"""


@query(MW + f" SELECT lang, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(u, 6) AS u, CASE WHEN sd > 0 THEN round(least(1, 2 * ({upper('z')})), 6) END AS p, CASE WHEN n1 * n0 > 0 THEN round((2 * u - n1 * n0) / (n1 * n0), 6) END AS cliffs_delta FROM z")
def mann_whitney_u(spark, sf_dir):
    return rounded(S.mann_whitney(predictions(spark, sf_dir), F.col("y") == 1, "p", ["lang"]))


@query(f"""{W}, a AS (SELECT lang, p FROM predictions WHERE y = 1), b AS (SELECT lang, p FROM predictions WHERE y = 0)
SELECT a.lang, round(avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p < b.p THEN -1 ELSE 0 END), 6) AS cliffs_delta FROM a JOIN b ON a.lang = b.lang GROUP BY a.lang""")
def cliffs_delta(spark, sf_dir):
    return rounded(S.mann_whitney(predictions(spark, sf_dir), F.col("y") == 1, "p", ["lang"]).select("lang", "cliffs_delta").filter("cliffs_delta is not null"))


PAIRED = "d AS (SELECT lang, round(p2 - p, 2) AS d FROM predictions), k AS (SELECT lang, d, rank() OVER (PARTITION BY lang ORDER BY abs(d)) + (count(*) OVER (PARTITION BY lang, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d)"


@query(f"""{W}, {PAIRED}, s AS (SELECT lang, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus, count(*)::DOUBLE AS n, count(*) FILTER (WHERE d = 0)::DOUBLE AS z0 FROM k GROUP BY lang),
ti AS (SELECT lang, sum(t * t * t - t) AS ties FROM (SELECT lang, count(*)::DOUBLE AS t FROM d WHERE d <> 0 GROUP BY lang, abs(d)) GROUP BY lang),
w AS (SELECT lang, plus, minus, least(plus, minus) AS w, (n * (n + 1) - z0 * (z0 + 1)) / 4 AS m, (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - coalesce(ties, 0) / 48 AS v FROM s LEFT JOIN ti USING (lang)),
z AS (SELECT *, abs(w - m) / sqrt(v) AS z FROM w)
SELECT lang, round(w, 6) AS w, round(least(1, 2 * ({upper('z')})), 6) AS p, round((plus - minus) / (plus + minus), 6) AS rank_biserial FROM z""")
def wilcoxon_pratt_w(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("lang", F.round(F.col("p2") - F.col("p"), 2).alias("d"))
    return rounded(S.wilcoxon_pratt(rows, "d", ["lang"]))


@query(f"""{W}, {TRAJECTORIES} SELECT lang, CAST(count(*) FILTER (WHERE y5 = 0 AND y10 = 0) AS BIGINT) AS n00, CAST(count(*) FILTER (WHERE y5 = 0 AND y10 = 1) AS BIGINT) AS n01,
CAST(count(*) FILTER (WHERE y5 = 1 AND y10 = 0) AS BIGINT) AS n10, CAST(count(*) FILTER (WHERE y5 = 1 AND y10 = 1) AS BIGINT) AS n11, CAST(count(*) FILTER (WHERE y5 IS NULL OR y10 IS NULL) AS BIGINT) AS excluded FROM trajectories GROUP BY lang""")
def mcnemar_counts(spark, sf_dir):
    return S.transitions(trajectories(spark, sf_dir), "y5", "y10", ["lang"])


@query()
def exact_tests(spark, sf_dir):
    """Exact McNemar and Fisher p-values by language; hypergeometric sums are beyond plain SQL."""
    cells = S.transitions(predictions(spark, sf_dir).withColumn("said", (F.col("p") >= 0.5).cast("int")), "y", "said", ["lang"])
    a, b, c, d = (F.col(x) for x in ("n00", "n01", "n10", "n11"))
    return cells.select("lang", S.mcnemar_p(b, c).alias("mcnemar_p"), S.fisher_p(a, b, c, d).alias("fisher_p"), S.odds_ratio(a, b, c, d).alias("odds_ratio"))


@query(f"""{W}, s AS (SELECT lang, count(*)::DOUBLE AS n, avg(y) AS m, stddev_samp(y) / sqrt(count(*)) AS e FROM predictions GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round(m, 6) AS point, CASE WHEN n >= 60 THEN round(m - 1.96::DOUBLE * e, 6) END AS lower, CASE WHEN n >= 60 THEN round(m + 1.96::DOUBLE * e, 6) END AS upper FROM s""")
def guarded_intervals(spark, sf_dir):
    per = predictions(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("e"))
    m, e = F.col("m"), F.col("e")
    return rounded(per.select("lang", "n", *S.guarded(m, m - 1.96 * e, m + 1.96 * e, F.col("n"), 60)))


@query(f"WITH z AS (SELECT unnest(range(81)) / 10.0::DOUBLE - 4 AS z) SELECT round(z, 6) AS z, round({upper('z')}, 6) AS tail FROM z")
def normal_tails(spark, sf_dir):
    z = spark.range(81).select((F.col("id") / 10.0 - 4).alias("z"))
    return rounded(z.withColumn("tail", normal_tail(F.col("z"))))


