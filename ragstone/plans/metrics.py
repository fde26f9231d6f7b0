"""Queries on classification metrics over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import metrics as M

from .fixtures import PREDICTIONS, predictions, table
from .registry import query

W = f"WITH {PREDICTIONS}"
RATES = """CASE WHEN tn+fp+fn+tp > 0 THEN round((tn+tp)::DOUBLE/(tn+fp+fn+tp), 6) END AS accuracy, CASE WHEN tp+fp > 0 THEN round(tp::DOUBLE/(tp+fp), 6) END AS "precision",
CASE WHEN tp+fn > 0 THEN round(tp::DOUBLE/(tp+fn), 6) END AS recall,
CASE WHEN tp+fp > 0 AND tp+fn > 0 THEN CASE WHEN tp = 0 THEN 0 ELSE round(2.0::DOUBLE*tp/(2*tp+fp+fn), 6) END END AS f1"""
CELLS = """CAST(count(*) FILTER (WHERE {y}=0 AND {p}=0) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE {y}=0 AND {p}=1) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE {y}=1 AND {p}=0) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE {y}=1 AND {p}=1) AS BIGINT) AS tp"""
AT = "CASE WHEN p >= {t} THEN 1 ELSE 0 END"


def rounded(df, *but):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def preds(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("said", (F.col("p") >= 0.5).cast("int"))


@query(f"{W}, c AS (SELECT lang, {CELLS.format(y='y', p='(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)')} FROM predictions GROUP BY lang) SELECT *, {RATES} FROM c")
def confusion_by_language(spark, sf_dir):
    return rounded(M.confusion_rates(preds(spark, sf_dir), "y", "said", ["lang"]))


@query(f"""{W}, pop AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
c AS (SELECT lang, count(*) AS n, {CELLS.format(y='y', p='(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)')} FROM predictions GROUP BY lang),
w AS (SELECT sum(p.size::DOUBLE / (SELECT sum(size) FROM pop) * c.tn / c.n) AS tn, sum(p.size::DOUBLE / (SELECT sum(size) FROM pop) * c.fp / c.n) AS fp,
 sum(p.size::DOUBLE / (SELECT sum(size) FROM pop) * c.fn / c.n) AS fn, sum(p.size::DOUBLE / (SELECT sum(size) FROM pop) * c.tp / c.n) AS tp FROM pop p LEFT JOIN c ON c.lang = p.lang)
SELECT round(tn, 6) AS tn, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tp, 6) AS tp, {RATES} FROM w""")
def confusion_weighted(spark, sf_dir):
    population = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    return rounded(M.weighted_confusion(preds(spark, sf_dir), "y", "said", "lang", population))


WILSON = """CASE WHEN trials > 0 THEN round(greatest(0, ((successes::DOUBLE/trials) + 1.959963984540054*1.959963984540054/(2*trials) - 1.959963984540054*sqrt((successes::DOUBLE/trials)*(1-successes::DOUBLE/trials)/trials + 1.959963984540054*1.959963984540054/(4.0*trials*trials))) / (1 + 1.959963984540054*1.959963984540054/trials)), 6) END AS lower,
CASE WHEN trials > 0 THEN round(least(1, ((successes::DOUBLE/trials) + 1.959963984540054*1.959963984540054/(2*trials) + 1.959963984540054*sqrt((successes::DOUBLE/trials)*(1-successes::DOUBLE/trials)/trials + 1.959963984540054*1.959963984540054/(4.0*trials*trials))) / (1 + 1.959963984540054*1.959963984540054/trials)), 6) END AS upper"""


@query(f"{W}, c AS (SELECT source, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS successes, CAST(count(*) AS BIGINT) AS trials FROM predictions GROUP BY source) SELECT *, {WILSON} FROM c")
def wilson_by_source(spark, sf_dir):
    return rounded(M.wilson_rows(preds(spark, sf_dir), F.col("y") == 1, ["source"]))


@query(f"""{W}, x AS (SELECT lang, y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS said FROM predictions),
g AS (SELECT lang, count(*)::DOUBLE AS n, sum(CASE WHEN y = said THEN 1 ELSE 0 END)::DOUBLE AS met, (sum(y)::DOUBLE * sum(said) + (count(*) - sum(y))::DOUBLE * (count(*) - sum(said))) / (count(*)::DOUBLE * count(*)) AS chance FROM x GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round(met / n, 6) AS agreement, CASE WHEN chance < 1 THEN round((met / n - chance) / (1 - chance), 6) END AS kappa FROM g""")
def cohens_kappa(spark, sf_dir):
    return rounded(M.cohens_kappa(preds(spark, sf_dir), "y", "said", ["lang"]))


@query(f"""{W}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS r FROM predictions),
s AS (SELECT lang, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs, sum(y)::DOUBLE AS np, (count(*) - sum(y))::DOUBLE AS nn FROM r GROUP BY lang)
SELECT lang, CASE WHEN np * nn > 0 THEN round((rs - np * (np + 1) / 2) / (np * nn), 6) END AS auroc FROM s""")
def auroc_average_rank(spark, sf_dir):
    return rounded(M.auroc(preds(spark, sf_dir), "y", "p", ["lang"]))


@query(f"""{W}, c AS (SELECT lang, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM predictions GROUP BY lang, p),
w AS (SELECT lang, pos, sum(pos) OVER (PARTITION BY lang) AS total, sum(pos) OVER (PARTITION BY lang ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY p DESC) AS said FROM c)
SELECT lang, round(sum(pos / total * tp / said), 6) AS average_precision FROM w GROUP BY lang""")
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(preds(spark, sf_dir), "y", "p", ["lang"]))


@query(f"{W} SELECT source, round(avg((p - y) * (p - y)), 6) AS brier FROM predictions GROUP BY source")
def brier_by_source(spark, sf_dir):
    return rounded(M.brier(preds(spark, sf_dir), "y", "p", ["source"]))


BINS = f"""{W}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS accuracy, avg(p) AS confidence FROM predictions GROUP BY 1),
e AS (SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(b.n, 0) AS n, b.accuracy, b.confidence, abs(b.accuracy - b.confidence) AS gap FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.bin = r.bin)"""


@query(BINS + " SELECT bin, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence, round(gap, 6) AS gap FROM e")
def reliability_bins(spark, sf_dir):
    return rounded(M.reliability_bins(preds(spark, sf_dir), "y", "p"))


@query(BINS + " SELECT round(sum(n * coalesce(gap, 0)) / sum(n), 6) AS ece FROM e")
def brier_ece_bins(spark, sf_dir):
    return rounded(M.calibration_error(M.reliability_bins(preds(spark, sf_dir), "y", "p")))


@query(BINS + " SELECT bin, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM e WHERE n > 0")
def calibration_table(spark, sf_dir):
    return rounded(M.reliability_bins(preds(spark, sf_dir), "y", "p").filter("n > 0").drop("gap"))


GRID51 = """g AS (SELECT unnest(range(51)) / 50.0::DOUBLE AS threshold), x AS (SELECT {by} threshold, sum(CASE WHEN p < threshold THEN 1 - y ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN p >= threshold THEN 1 - y ELSE 0 END)::BIGINT AS fp,
 sum(CASE WHEN p < threshold THEN y ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN p >= threshold THEN y ELSE 0 END)::BIGINT AS tp FROM predictions, g {where} GROUP BY {by} threshold),
z AS (SELECT *, CASE WHEN tp+fp > 0 THEN tp::DOUBLE/(tp+fp) ELSE 0 END AS pr, CASE WHEN tp+fn > 0 THEN tp::DOUBLE/(tp+fn) ELSE 0 END AS re FROM x),
s AS (SELECT *, CASE WHEN pr + re > 0 THEN 2*pr*re/(pr+re) ELSE 0 END AS f1 FROM z)"""
FIFTIETHS = [i / 50 for i in range(51)]


@query(f"{W}, {GRID51.format(by='', where='')} SELECT threshold, tn, fp, fn, tp, round((tn+tp)::DOUBLE/(tn+fp+fn+tp), 6) AS accuracy, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(f1, 6) AS f1 FROM s")
def classifier_metrics_grid(spark, sf_dir):
    cells = M.at_thresholds(preds(spark, sf_dir), "y", "p", M.grid(spark, FIFTIETHS))
    return rounded(M.scored_thresholds(cells))


@query(f"""{W}, {GRID51.format(by='', where="WHERE split = 'train'")} SELECT threshold, round(f1, 6) AS f1, round(pr, 6) AS "precision" FROM s ORDER BY round(s.f1, 9) DESC, round(pr, 9) DESC, threshold DESC LIMIT 1""")
def threshold_search_f1(spark, sf_dir):
    train = preds(spark, sf_dir).filter("split = 'train'")
    best = M.best_threshold(M.scored_thresholds(M.at_thresholds(train, "y", "p", M.grid(spark, FIFTIETHS))))
    return rounded(best.select("threshold", "f1", "precision"))


@query(f"""{W}, {GRID51.format(by='strategy,', where='')} SELECT threshold, round(avg(f1), 6) AS mean_f1, round(avg(pr), 6) AS mean_precision FROM s GROUP BY threshold""")
def threshold_search_folds(spark, sf_dir):
    return rounded(M.best_over_folds(preds(spark, sf_dir), "y", "p", "strategy", M.grid(spark, FIFTIETHS)))


@query(f"""{W}, {GRID51.format(by='', where='')}, o AS (SELECT *, CASE WHEN tn+fp > 0 THEN fp::DOUBLE/(tn+fp) ELSE 0 END AS unsafe, CASE WHEN fn+tp > 0 THEN fn::DOUBLE/(fn+tp) ELSE 0 END AS fa FROM s),
v AS (SELECT threshold, unsafe, f1 - 0.3::DOUBLE*fa - 0.7::DOUBLE*unsafe AS objective, unsafe <= 0.2 AS allowed FROM o)
SELECT threshold, round(unsafe, 6) AS unsafe, round(objective, 6) AS objective FROM v ORDER BY allowed DESC, CASE WHEN allowed THEN -objective ELSE unsafe END, threshold LIMIT 1""")
def tuned_answer_threshold(spark, sf_dir):
    best = M.penalised_tuning(preds(spark, sf_dir), "y", "p", M.grid(spark, FIFTIETHS))
    return rounded(best.select("threshold", "unsafe", "objective"))


@query(f"""{W}, c AS (SELECT {CELLS.format(y='y', p='(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)')} FROM predictions), r AS (SELECT {RATES} FROM c)
SELECT 'accuracy' AS gate, accuracy AS observed, 0.5::DOUBLE AS minimum, CASE WHEN accuracy IS NULL THEN 'pending' WHEN accuracy >= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM r
UNION ALL SELECT 'precision', "precision", 0.9, CASE WHEN "precision" IS NULL THEN 'pending' WHEN "precision" >= 0.9 THEN 'pass' ELSE 'fail' END FROM r
UNION ALL SELECT 'f1', f1, 0.85, CASE WHEN f1 IS NULL THEN 'pending' WHEN f1 >= 0.85 THEN 'pass' ELSE 'fail' END FROM r""")
def evaluation_gates(spark, sf_dir):
    return rounded(M.gates(M.confusion_rates(preds(spark, sf_dir), "y", "said"), {"accuracy": 0.5, "precision": 0.9, "f1": 0.85}))


RESCUE = f"""{W}, rows_ AS (SELECT CASE WHEN p2 >= 0.9 THEN 1 ELSE 0 END AS strict, y AS truth, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE p END AS coverage,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE p2 END AS mean_score, p2 * 0.5::DOUBLE AS min_score, 1 - p2 AS contradiction FROM predictions),
cov AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t_cov), me AS (SELECT unnest([0.45, 0.55, 0.65])::DOUBLE AS t_mean), mi AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS t_min),
cand AS (SELECT 'coverage_only' AS family, 0 AS fo, t_cov, NULL::DOUBLE AS t_mean, NULL::DOUBLE AS t_min, NULL::DOUBLE AS t_con FROM cov UNION ALL SELECT 'nli_only', 1, NULL, t_mean, t_min, 0.5 FROM me, mi UNION ALL SELECT 'combined', 2, t_cov, t_mean, t_min, 0.5 FROM cov, me, mi),
num AS (SELECT CAST(row_number() OVER (ORDER BY fo, t_cov, t_mean, t_min) AS INTEGER) AS candidate_order, * FROM cand),
sig AS (SELECT n.candidate_order, n.family, r.strict, r.truth, coalesce(r.coverage >= n.t_cov, false) AS bc, coalesce(r.mean_score >= n.t_mean AND r.min_score >= n.t_min AND r.contradiction < n.t_con, false) AS bs FROM rows_ r, num n),
pr AS (SELECT *, CASE WHEN strict = 1 THEN 1 WHEN CASE family WHEN 'coverage_only' THEN bc WHEN 'nli_only' THEN bs ELSE bc OR bs END THEN 1 ELSE 0 END AS pred FROM sig),
ev AS (SELECT candidate_order, family, {CELLS.format(y='truth', p='pred')}, CAST(count(*) FILTER (WHERE strict = 0 AND pred = 1 AND bc) AS BIGINT) AS rescued_by_coverage,
  CAST(count(*) FILTER (WHERE strict = 0 AND pred = 1 AND bs) AS BIGINT) AS rescued_by_nli, CAST(count(*) FILTER (WHERE strict = 0 AND pred = 1 AND bc AND bs) AS BIGINT) AS overlap FROM pr GROUP BY 1, 2),
rt AS (SELECT *, {RATES} FROM ev)"""


def _rescue(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(
        (F.col("p2") >= 0.9).cast("int").alias("strict"),
        F.col("y").alias("truth"),
        F.when(F.col("doc_id") % 11 != 0, F.col("p")).alias("coverage"),
        F.when(F.col("doc_id") % 7 != 0, F.col("p2")).alias("mean_score"),
        (F.col("p2") * 0.5).alias("min_score"),
        (1 - F.col("p2")).alias("contradiction"),
    )
    candidates = M.rescue_grid(spark, [0.5, 0.6, 0.7, 0.8, 0.9], [0.45, 0.55, 0.65], [0.1, 0.2, 0.3], 0.5)
    return M.evaluated_candidates(rows, candidates)


@query(RESCUE + " SELECT * FROM rt")
def rescue_grid_evaluation(spark, sf_dir):
    return rounded(_rescue(spark, sf_dir))


@query(RESCUE + """, k AS (SELECT * FROM rt WHERE "precision" >= 0.8), f AS (SELECT * FROM k WHERE f1 = (SELECT max(f1) FROM k)), r AS (SELECT * FROM f WHERE recall = (SELECT max(recall) FROM f))
SELECT candidate_order, family, f1, recall FROM r ORDER BY CASE family WHEN 'coverage_only' THEN 0 WHEN 'nli_only' THEN 1 ELSE 2 END, candidate_order LIMIT 1""")
def rescue_grid_selection(spark, sf_dir):
    chosen = M.select_candidate(_rescue(spark, sf_dir), 0.8)
    return rounded(chosen.select("candidate_order", "family", "f1", "recall"))


@query(f"""{W}, g AS (SELECT a.t AS t_min, b.t AS t_mean, c.t AS t_con FROM (SELECT unnest(range(14)) * 0.05::DOUBLE + 0.3::DOUBLE AS t) a, (SELECT unnest(range(14)) * 0.05::DOUBLE + 0.3::DOUBLE AS t) b, (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS t) c WHERE b.t >= a.t),
x AS (SELECT g.*, y, CASE WHEN p * 0.9::DOUBLE >= t_min AND p >= t_mean AND 1 - p2 < t_con THEN 1 ELSE 0 END AS pred FROM predictions, g),
c AS (SELECT t_min, t_mean, t_con, {CELLS.format(y='y', p='pred')} FROM x GROUP BY ALL)
SELECT round(t_min, 6) AS t_min, round(t_mean, 6) AS t_mean, t_con, tn, fp, fn, tp FROM c""")
def semantic_threshold_grid(spark, sf_dir):
    steps = spark.range(14).select((F.col("id") * 0.05 + 0.3).alias("t"))
    cons = M.grid(spark, [0.2, 0.3, 0.4, 0.5], "t_con")
    pairs = steps.select(F.col("t").alias("t_min")).join(steps.select(F.col("t").alias("t_mean")), F.col("t_mean") >= F.col("t_min")).crossJoin(cons)
    counted = predictions(spark, sf_dir).groupBy("p", "p2", "y").agg(F.count(F.lit(1)).alias("n"))
    said = (F.col("p") * 0.9 >= F.col("t_min")) & (F.col("p") >= F.col("t_mean")) & (1 - F.col("p2") < F.col("t_con"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    cells = counted.crossJoin(F.broadcast(pairs)).groupBy("t_min", "t_mean", "t_con").agg(
        n(~said & (F.col("y") == 0)).alias("tn"), n(said & (F.col("y") == 0)).alias("fp"),
        n(~said & (F.col("y") == 1)).alias("fn"), n(said & (F.col("y") == 1)).alias("tp"),
    )
    return rounded(cells)
