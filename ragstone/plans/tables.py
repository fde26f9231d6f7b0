"""Report tables put together from the other queries: censuses, model and risk tables, associations, sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import learning as L
from ragstone.operators import policy as P
from ragstone.operators import reports as T
from ragstone.operators.metrics import grid
from ragstone.operators.statistics import bootstrap_means, interval

from .evaluation import TARGET, W, conditions, target
from .fixtures import PREDICTIONS, TRAJECTORIES, predictions, table, trajectories
from .learning import NUMERIC, frame
from .metrics import CELLS, RATES, rounded
from .policy import RISKS
from .registry import query

CENSUS = f"""{TARGET}, r AS (SELECT 'benchmark census' AS section, split, CAST(count(*) AS BIGINT) AS questions, CAST(count(*) AS BIGINT) AS observations, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative FROM predictions GROUP BY split
UNION ALL SELECT 'context sufficiency', split, CAST(count(DISTINCT question_id) AS BIGINT), CAST(count(*) AS BIGINT), CAST(sum(final) AS BIGINT), CAST(count(*) - sum(final) AS BIGINT) FROM target WHERE evaluable AND split <> 'test' GROUP BY split
UNION ALL SELECT 'responses', 'all', CAST(count(DISTINCT conv_id) AS BIGINT), CAST(count(*) AS BIGINT), NULL, NULL FROM conversations WHERE role = 'assistant')"""


@query(CENSUS + " SELECT * FROM r")
def population_census_table(spark, sf_dir):
    """T01: populations by split; the test split shows its census alone, no outcomes of targets."""
    n = F.count(F.lit(1))
    benchmark = predictions(spark, sf_dir).groupBy("split").agg(n.alias("questions"), n.alias("observations"), F.sum("y").cast("long").alias("positive"), (n - F.sum("y")).alias("negative"))
    known = target(spark, sf_dir).filter("evaluable and split <> 'test'")
    sufficiency = known.groupBy("split").agg(F.countDistinct("question_id").alias("questions"), n.alias("observations"), F.sum("final").cast("long").alias("positive"), (n - F.sum("final")).alias("negative"))
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").agg(F.countDistinct("conv_id").alias("questions"), n.alias("observations")).withColumn("split", F.lit("all"))
    return T.sections({"benchmark census": benchmark, "context sufficiency": sufficiency, "responses": said})


def model_table(spark, sf_dir):
    return T.model_metrics(predictions(spark, sf_dir).filter("split <> 'train'"), "y", "p", ["split"])


AUC = """SELECT split, CASE WHEN count(DISTINCT y) = 2 THEN (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) END AS auroc FROM (
  SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0::DOUBLE AS r FROM t) GROUP BY split"""
MODELS = f"""WITH {PREDICTIONS}, t AS (SELECT * FROM predictions WHERE split <> 'train'), c AS (SELECT split, {CELLS.format(y='y', p='(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)')} FROM t GROUP BY split), m AS (SELECT *, {RATES} FROM c),
au AS ({AUC}), cs AS (SELECT split, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM t GROUP BY split, p),
w AS (SELECT split, pos, sum(pos) OVER (PARTITION BY split) AS total, sum(pos) OVER (PARTITION BY split ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY p DESC) AS said FROM cs), ap AS (SELECT split, sum(pos / total * tp / said) AS v FROM w GROUP BY split),
br AS (SELECT split, avg((p - y) * (p - y)) AS v FROM t GROUP BY split), bi AS (SELECT split, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM t GROUP BY 1, 2), ec AS (SELECT split, sum(n * gap) / sum(n) AS v FROM bi GROUP BY split),
row_ AS (SELECT m.*, round(auroc, 6) AS auroc, round(ap.v, 6) AS average_precision, round(br.v, 6) AS brier, round(ec.v, 6) AS ece FROM m JOIN au USING (split) JOIN ap USING (split) JOIN br USING (split) JOIN ec USING (split))"""


@query(MODELS + " SELECT * FROM row_")
def model_metric_rows(spark, sf_dir):
    return rounded(model_table(spark, sf_dir))


METRICS = ("auroc", "average_precision", "accuracy", "precision", "recall", "f1", "brier", "ece")


@query()
def classifier_table(spark, sf_dir):
    """T01 of the final test: metrics by split, with bootstrap intervals by source where they are means."""
    points = T.long_metrics(rounded(model_table(spark, sf_dir)), ["split"], list(METRICS))
    out = None
    for split in ("validation", "test"):
        rows = predictions(spark, sf_dir).filter(F.col("split") == split)
        scored = rows.select("source", F.pow(F.col("p") - F.col("y"), 2).alias("brier"), ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double").alias("accuracy"))
        means = bootstrap_means(scored, "source", ["brier", "accuracy"], 200, "7")
        for name in ("brier", "accuracy"):
            part = interval(means, name).select(F.lit(split).alias("split"), F.lit(name).alias("metric"), "lower", "upper")
            out = part if out is None else out.unionByName(part)
    return rounded(T.with_intervals(points, out, ["split"]))


@query()
def risk_table(spark, sf_dir):
    """T02 of the final test: area under risk over coverage and operating points of both splits."""
    out = {}
    for split in ("validation", "test"):
        curve = P.risk_coverage(predictions(spark, sf_dir).filter(F.col("split") == split), "y", "p")
        area = P.aurc(curve).select(F.lit(split).alias("split"), F.lit("AURC").alias("point"), F.col("aurc").alias("risk"))
        points = P.operating_points(curve, grid(spark, RISKS, "constraint")).select(
            F.lit(split).alias("split"), F.format_string("%.0f%%", F.col("constraint") * 100).alias("point"), "threshold", "coverage", "risk"
        )
        out[split] = area.unionByName(points, allowMissingColumns=True)
    return rounded(out["validation"].unionByName(out["test"]))




@query()
def association_table(spark, sf_dir):
    """Outcomes of documents labelled good against the others, at each depth."""
    rows = conditions(spark, sf_dir).filter("y_suff is not null and split <> 'test'").withColumn("supported", (F.col("mean_score") >= 0.5).cast("int"))
    return rounded(T.associations(rows, "truth", ["k"], ["coverage", "contradiction"], ["supported", "y_suff"]))


@query(f"""WITH {PREDICTIONS}, {TRAJECTORIES}, g AS (SELECT unnest(['g1', 'g2', 'g3']) AS policy, unnest([0.3, 0.5, 0.56])::DOUBLE AS low, unnest([0.7, 0.9, 0.72])::DOUBLE AS high),
a AS (SELECT p.split, policy, y5, y10, CASE WHEN p5 >= high THEN 'answer_k5' WHEN p5 < low THEN 'abstain_k5' WHEN p10 >= high THEN 'answer_k10' ELSE 'abstain_k10' END AS action FROM trajectories t JOIN predictions p ON p.doc_id = t.question_id, g WHERE p.split <> 'train'),
b AS (SELECT *, CASE WHEN action LIKE '%k10' THEN y10 ELSE y5 END AS y FROM a)
SELECT split, policy, CAST(count(*) FILTER (WHERE action LIKE 'answer%' AND y = 1) AS BIGINT) AS safe, CAST(count(*) FILTER (WHERE action LIKE 'answer%' AND y = 0) AS BIGINT) AS unsafe, CAST(count(*) FILTER (WHERE action LIKE 'abstain%') AS BIGINT) AS abstained,
round(count(*) FILTER (WHERE action LIKE 'answer%')::DOUBLE / count(*), 6) AS coverage, round(count(*) FILTER (WHERE action LIKE '%k10')::DOUBLE / count(*), 6) AS expansion FROM b GROUP BY split, policy""")
def policy_table(spark, sf_dir):
    """T03 of the final test: frozen policies on both splits."""
    frozen = spark.createDataFrame([("g1", 0.3, 0.7), ("g2", 0.5, 0.9), ("g3", 0.56, 0.72)], "policy string, low double, high double")
    splits = predictions(spark, sf_dir).select(F.col("doc_id").alias("question_id"), "split")
    rows = trajectories(spark, sf_dir).join(splits, "question_id").filter("split <> 'train'")
    counted = rows.groupBy("split", "p5", "p10", "y5", "y10").agg(F.count(F.lit(1)).alias("n"))
    acted = counted.crossJoin(F.broadcast(frozen)).withColumn("action", P.action(F.col("p5"), F.col("p10"), F.col("low"), F.col("high")))
    said, deep = F.col("action").startswith("answer"), F.col("action").endswith("k10")
    y = F.when(deep, F.col("y10")).otherwise(F.col("y5"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return rounded(
        acted.groupBy("split", "policy").agg(
            n(said & (y == 1)).alias("safe"), n(said & (y == 0)).alias("unsafe"), n(~said).alias("abstained"),
            (n(said) / F.sum("n")).alias("coverage"), (n(deep) / F.sum("n")).alias("expansion"),
        )
    )


@query()
def impossible_sensitivity(spark, sf_dir):
    """The model refitted on training rows with the impossible ones added as negatives, scored on the test's impossible
    rows; nothing of the primary model changes."""
    rows = frame(spark, sf_dir).withColumn("impossible", F.col("doc_id") % 9 == 0)
    rows = rows.withColumn("y", F.when(F.col("impossible"), 0).otherwise(F.col("y")))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test' and impossible")
    prepared = L.prepare(train, NUMERIC)
    scored = L.predict(L.fit(train, prepared, "logistic"), prepared, test)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") >= 0.5).alias("predicted_sufficient"), F.avg("p").alias("mean_probability"),
        F.avg((F.col("p") < 0.5).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("p"), 2)).alias("brier"),
    )


@query(f"{W} SELECT question_id, strategy, k, 0 AS y_final FROM labelled WHERE impossible AND split <> 'test'")
def impossible_targets(spark, sf_dir):
    rows = conditions(spark, sf_dir).filter("impossible and split <> 'test'")
    return rows.select("question_id", "strategy", "k", F.lit(0).alias("y_final"))
