"""Queries on sufficiency targets, completed annotations and frozen rules.

Conditions are labelled documents at four depths and three strategies; coverage and scores follow from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import evaluation as E
from ragstone.operators import metrics as M
from ragstone.operators.alignment import stratum
from ragstone.operators.policy import action, policy_metrics

from .fixtures import PREDICTIONS, TRAJECTORIES, predictions, trajectories
from .metrics import CELLS, RATES, rounded
from .registry import query

STRATEGIES = ("bm25", "dense", "hybrid")
RULE = {"family": "combined", "t_cov": 0.2, "t_mean": 0.35, "t_min": 0.05, "t_con": 0.5}
CONDITIONS = """conditions AS (
  SELECT p.doc_id AS question_id, CASE p.strategy WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS strategy, CAST(k.k AS INTEGER) AS k, p.split, p.y AS truth,
    p.doc_id % 9 = 0 AS impossible, p.doc_id % 13 = 0 AS unresolved, p.doc_id % 7 <> 0 AS evaluable,
    CASE WHEN p.doc_id % 9 = 0 OR p.doc_id % 13 = 0 THEN NULL ELSE least(1.0::DOUBLE, CAST((p.doc_id * 31 + 7 * k.k) % 131 AS DOUBLE) / 100.0::DOUBLE) END AS coverage,
    CASE WHEN p.doc_id % 7 <> 0 THEN p.p END AS mean_score, CASE WHEN p.doc_id % 7 <> 0 THEN p.p * 0.5::DOUBLE END AS min_score, CASE WHEN p.doc_id % 7 <> 0 THEN p.p2 END AS contradiction
  FROM predictions p, (SELECT unnest([1, 3, 5, 10]) AS k) k),
labelled AS (
  SELECT *, CASE WHEN unresolved AND NOT impossible THEN NULL WHEN coalesce(coverage, 0) >= 1 THEN 1 ELSE 0 END AS y_suff,
    CASE WHEN impossible THEN 'benchmark_impossible' WHEN coverage >= 1 THEN 'automatic_positive' WHEN coverage > 0 AND question_id % 2 = 0 THEN 'partial_overlap' WHEN question_id % 3 = 0 THEN 'correct_document_insufficient' ELSE 'wrong_document_retrieval' END AS stratum
  FROM conditions)"""
W = f"WITH {PREDICTIONS}, {CONDITIONS}"


def conditions(spark, sf_dir):
    """question_id, strategy, k, split, truth, impossible, unresolved, evaluable, coverage, scores, y_suff, stratum."""
    ks = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k"))
    q = F.col("doc_id")
    impossible, unresolved, evaluable = q % 9 == 0, q % 13 == 0, q % 7 != 0
    coverage = F.when(~(impossible | unresolved), F.least(F.lit(1.0), ((q * 31 + 7 * F.col("k")) % 131) / F.lit(100.0)))
    rows = predictions(spark, sf_dir).crossJoin(F.broadcast(ks)).select(
        q.alias("question_id"),
        F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (F.col("strategy") + 1).cast("int")).alias("strategy"),
        "k", "split", F.col("y").alias("truth"), impossible.alias("impossible"), unresolved.alias("unresolved"), evaluable.alias("evaluable"),
        coverage.alias("coverage"), F.when(evaluable, F.col("p")).alias("mean_score"), F.when(evaluable, F.col("p") * 0.5).alias("min_score"),
        F.when(evaluable, F.col("p2")).alias("contradiction"),
    )
    full = F.coalesce("coverage", F.lit(0.0)) >= 1
    partial = F.when((F.col("coverage") > 0) & (F.col("question_id") % 2 == 0), F.col("coverage"))
    return rows.withColumns(
        {
            "y_suff": F.when(~F.col("unresolved") | F.col("impossible"), F.when(full, 1).otherwise(0)),
            "stratum": stratum(F.col("impossible"), full, F.coalesce(partial, F.lit(0.0)), F.col("question_id") % 3 == 0),
        }
    )


@query(f"{W} SELECT stratum, CAST(count(*) AS BIGINT) AS size FROM labelled WHERE split IN ('train', 'validation') AND y_suff IS NOT NULL GROUP BY stratum")
def development_strata(spark, sf_dir):
    return E.stratum_frequencies(conditions(spark, sf_dir))


@query(f"""{W}, s AS (SELECT CASE WHEN y_suff = 1 THEN 'strict_positive_' ELSE 'strict_negative_' END || CASE WHEN mean_score >= 0.5 THEN 'semantic_positive' ELSE 'semantic_negative' END AS stratum
  FROM labelled WHERE y_suff IS NOT NULL AND evaluable AND split <> 'test') SELECT stratum, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY stratum""")
def confirmation_strata(spark, sf_dir):
    rows = conditions(spark, sf_dir).filter("y_suff is not null and evaluable and split <> 'test'")
    semantic = (F.col("mean_score") >= 0.5).cast("int")
    return rows.groupBy(E.confirmation_stratum(F.col("y_suff"), semantic).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


TARGET = f"""{W}, t AS (SELECT *, y_suff AS strict, coalesce(coverage >= 0.2, false) AS bc, coalesce(mean_score >= 0.35 AND min_score >= 0.05 AND contradiction < 0.5, false) AS bs FROM labelled WHERE y_suff IS NOT NULL),
f AS (SELECT *, CASE WHEN evaluable THEN CASE WHEN strict = 1 OR bc OR bs THEN 1 ELSE 0 END END AS final FROM t),
target AS (SELECT question_id, strategy, k, split, evaluable, CAST(strict AS INTEGER) AS strict, CAST(final AS INTEGER) AS final, CASE WHEN evaluable THEN bc AND strict = 0 END AS coverage_rescue, CASE WHEN evaluable THEN bs AND strict = 0 END AS nli_rescue,
  CASE WHEN evaluable THEN strict = 0 AND final = 1 END AS rescued, CASE WHEN evaluable THEN CASE WHEN strict = 1 THEN 'strict_positive_retained' WHEN final = 1 THEN 'strict_negative_rescued' ELSE 'strict_negative_not_rescued' END END AS status FROM f)"""


def target(spark, sf_dir):
    rows = conditions(spark, sf_dir).filter("y_suff is not null").withColumn("strict", F.col("y_suff"))
    return E.final_target(rows, RULE).select(
        "question_id", "strategy", "k", "split", "evaluable", "strict", "final", "coverage_rescue", "nli_rescue", "rescued", "status"
    )


@query(TARGET + " SELECT * FROM target")
def final_target_rows(spark, sf_dir):
    return target(spark, sf_dir)


@query(TARGET + """ SELECT CAST(count(DISTINCT question_id) FILTER (WHERE evaluable) AS BIGINT) AS eligible_questions, CAST(count(*) FILTER (WHERE evaluable) AS BIGINT) AS eligible_conditions, CAST(count(*) FILTER (WHERE evaluable AND strict = 1) AS BIGINT) AS strict_positive,
CAST(count(*) FILTER (WHERE rescued) AS BIGINT) AS rescued_positive, CAST(count(*) FILTER (WHERE final = 1) AS BIGINT) AS final_positive, CAST(count(*) FILTER (WHERE final = 0) AS BIGINT) AS final_negative,
CAST(count(*) FILTER (WHERE rescued AND coverage_rescue) AS BIGINT) AS rescued_by_coverage, CAST(count(*) FILTER (WHERE rescued AND nli_rescue) AS BIGINT) AS rescued_by_nli, CAST(count(*) FILTER (WHERE rescued AND coverage_rescue AND nli_rescue) AS BIGINT) AS rescued_by_both,
CAST(count(*) FILTER (WHERE NOT evaluable) AS BIGINT) AS unevaluable_conditions FROM target""")
def final_target_census(spark, sf_dir):
    return E.target_census(target(spark, sf_dir), "question_id")


@query(TARGET + " SELECT split, strategy, k, CAST(count(*) AS BIGINT) AS n, CAST(sum(final) AS BIGINT) AS positive, round(avg(final), 6) AS share FROM target WHERE evaluable GROUP BY split, strategy, k")
def target_condition_census(spark, sf_dir):
    return rounded(E.census(target(spark, sf_dir).filter("evaluable"), ["split", "strategy", "k"], "final"))


@query(TARGET + f""", c AS (SELECT question_id, strategy, k, coverage, mean_score FROM labelled) SELECT t.question_id, t.strategy, t.k, t.final, round(c.coverage, 6) AS coverage, round(c.mean_score, 6) AS mean_score
FROM target t JOIN c USING (question_id, strategy, k) WHERE t.split = 'test' AND t.evaluable""")
def final_test_inputs(spark, sf_dir):
    """Targets of the test split with the signals of their condition; a target without exactly one is an error."""
    keys = ["question_id", "strategy", "k"]
    wanted = target(spark, sf_dir).filter("split = 'test' and evaluable").select(*keys, "final")
    return rounded(E.with_condition(wanted, conditions(spark, sf_dir).select(*keys, "coverage", "mean_score"), keys))


@query(f"{W}, a AS (SELECT question_id, coverage AS coverage_5 FROM labelled WHERE k = 5), b AS (SELECT question_id, coverage AS coverage_10 FROM labelled WHERE k = 10) SELECT a.question_id, round(coverage_5, 6) AS coverage_5, round(coverage_10, 6) AS coverage_10, round(coverage_10 - coverage_5, 6) AS gain FROM a JOIN b USING (question_id)")
def paired_depths(spark, sf_dir):
    rows = conditions(spark, sf_dir)
    at = lambda k: rows.filter(F.col("k") == k).select("question_id", F.col("coverage").alias(f"coverage_{k}"))
    both = E.one_to_one(at(5), at(10), ["question_id"])
    return rounded(both.withColumn("gain", F.col("coverage_10") - F.col("coverage_5")))


@query(f"{W} SELECT question_id, strategy, k FROM labelled WHERE split = 'validation' AND question_id NOT IN (SELECT question_id FROM labelled WHERE y_suff = 1)")
def unused_questions(spark, sf_dir):
    rows = conditions(spark, sf_dir)
    return E.unused(rows.filter("split = 'validation'"), rows.filter("y_suff = 1"), "question_id").select("question_id", "strategy", "k")


ERRORS = f"""{W}, e AS (SELECT *, y_suff AS strict, coalesce(coverage >= 0.2, false) AS bc, coalesce(mean_score >= 0.35 AND min_score >= 0.05 AND contradiction < 0.5, false) AS bs FROM labelled WHERE y_suff IS NOT NULL AND evaluable AND split <> 'test'),
w AS (SELECT CASE WHEN truth = 1 AND NOT (strict = 1 OR bc OR bs) THEN 'false_negative' WHEN truth = 0 AND (strict = 1 OR bc OR bs) THEN 'false_positive' END AS error, strategy, CAST(k AS VARCHAR) AS k, stratum,
  CASE WHEN coverage IS NULL THEN 'missing' WHEN coverage < 0.2 THEN 'below_selected_threshold' ELSE 'at_or_above_selected_threshold' END AS coverage_band,
  CASE WHEN concat_ws('+', CASE WHEN mean_score < 0.35 THEN 'mean_below_threshold' END, CASE WHEN min_score < 0.05 THEN 'minimum_below_threshold' END, CASE WHEN contradiction >= 0.5 THEN 'contradiction_veto' END) = '' THEN 'nli_passed'
    ELSE concat_ws('+', CASE WHEN mean_score < 0.35 THEN 'mean_below_threshold' END, CASE WHEN min_score < 0.05 THEN 'minimum_below_threshold' END, CASE WHEN contradiction >= 0.5 THEN 'contradiction_veto' END) END AS score_failure FROM e),
u AS (SELECT error, 'strategy' AS dimension, strategy AS value FROM w UNION ALL SELECT error, 'k', k FROM w UNION ALL SELECT error, 'stratum', stratum FROM w UNION ALL SELECT error, 'coverage_band', coverage_band FROM w UNION ALL SELECT error, 'score_failure', score_failure FROM w)"""


def development(spark, sf_dir):
    return conditions(spark, sf_dir).filter("y_suff is not null and evaluable and split <> 'test'").withColumn("strict", F.col("y_suff"))


@query(ERRORS + " SELECT error, dimension, value, CAST(count(*) AS BIGINT) AS n FROM u WHERE error IS NOT NULL GROUP BY error, dimension, value")
def rescue_error_patterns(spark, sf_dir):
    return E.error_patterns(development(spark, sf_dir), RULE, ["strategy", "k", "stratum"])


@query(ERRORS + f""", p AS (SELECT truth, strict, CASE WHEN strict = 1 OR bc OR bs THEN 1 ELSE 0 END AS pred FROM e), c AS (SELECT {CELLS.format(y='truth', p='pred')}, CAST(count(*) FILTER (WHERE truth = 1 AND strict = 0) AS BIGINT) AS strict_false_negatives, CAST(count(*) FILTER (WHERE truth = 1 AND strict = 0 AND pred = 1) AS BIGINT) AS recovered FROM p) SELECT *, {RATES} FROM c""")
def selected_rule_report(spark, sf_dir):
    return rounded(E.recovered(development(spark, sf_dir), RULE))


EXPANDED = ([0.2, 0.3, 0.4, 0.45, 0.5], [0.3, 0.35, 0.4, 0.45], [0.0, 0.05, 0.1], 0.5)
EXPANDED_SQL = f"""{W}, cov AS (SELECT unnest([0.2, 0.3, 0.4, 0.45, 0.5])::DOUBLE AS t_cov), me AS (SELECT unnest([0.3, 0.35, 0.4, 0.45])::DOUBLE AS t_mean), mi AS (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS t_min),
cand AS (SELECT 'coverage_only' AS family, 0 AS fo, t_cov, NULL::DOUBLE AS t_mean, NULL::DOUBLE AS t_min FROM cov UNION ALL SELECT 'nli_only', 1, NULL, t_mean, t_min FROM me, mi UNION ALL SELECT 'combined', 2, t_cov, t_mean, t_min FROM cov, me, mi),
num AS (SELECT CAST(row_number() OVER (ORDER BY fo, t_cov, t_mean, t_min) AS INTEGER) AS candidate_order, * FROM cand),
sig AS (SELECT n.candidate_order, n.family, n.fo, r.y_suff AS strict, r.truth, coalesce(r.coverage >= n.t_cov, false) AS bc, coalesce(r.mean_score >= n.t_mean AND r.min_score >= n.t_min AND r.contradiction < 0.5, false) AS bs
  FROM labelled r, num n WHERE r.y_suff IS NOT NULL AND r.evaluable AND r.split <> 'test'),
pr AS (SELECT *, CASE WHEN strict = 1 THEN 1 WHEN CASE family WHEN 'coverage_only' THEN bc WHEN 'nli_only' THEN bs ELSE bc OR bs END THEN 1 ELSE 0 END AS pred FROM sig),
ev AS (SELECT candidate_order, family, {CELLS.format(y='truth', p='pred')}, CAST(count(*) FILTER (WHERE strict = 0 AND pred = 1 AND bc) AS BIGINT) AS rescued_by_coverage,
  CAST(count(*) FILTER (WHERE strict = 0 AND pred = 1 AND bs) AS BIGINT) AS rescued_by_nli, CAST(count(*) FILTER (WHERE strict = 0 AND pred = 1 AND bc AND bs) AS BIGINT) AS overlap FROM pr GROUP BY 1, 2),
rt AS (SELECT *, {RATES} FROM ev)"""


def expanded(spark, sf_dir):
    return M.evaluated_candidates(development(spark, sf_dir), M.rescue_grid(spark, *EXPANDED))


@query(EXPANDED_SQL + " SELECT * FROM rt")
def expanded_rescue_grid(spark, sf_dir):
    """The 77 candidates."""
    return rounded(expanded(spark, sf_dir))


@query("""SELECT 'coverage_only' AS family, 5::BIGINT AS candidates, 1::BIGINT AS before UNION ALL SELECT 'nli_only', 12, 1 UNION ALL SELECT 'combined', 60, 1""")
def expanded_rescue_overlap(spark, sf_dir):
    """Candidates of each family, and how many of them the earlier grid of 59 had."""
    earlier = M.rescue_grid(spark, [0.5, 0.6, 0.7, 0.8, 0.9], [0.45, 0.55, 0.65], [0.1, 0.2, 0.3], 0.5)
    marked = E.marked_grid(M.rescue_grid(spark, *EXPANDED), earlier)
    return marked.groupBy("family").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("before").alias("before"))


@query(EXPANDED_SQL + """, g AS (SELECT *, "precision" >= 0.9 AS passes FROM rt), a AS (SELECT *, max(CASE WHEN passes THEN 1 ELSE 0 END) OVER (PARTITION BY family) AS any_ FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN any_ = 1 AND passes THEN 0 ELSE 1 END, CASE WHEN any_ = 0 THEN "precision" END DESC, f1 DESC, recall DESC, candidate_order) AS n FROM a)
SELECT family, candidate_order, passes, "precision", f1, recall FROM o WHERE n = 1""")
def best_rescue_by_family(spark, sf_dir):
    return rounded(E.best_by_family(rounded(expanded(spark, sf_dir)), 0.9))


@query(f"{W} SELECT strategy, CAST(count(coverage) AS BIGINT) AS n, min(coverage) AS minimum, round(quantile_cont(coverage, 0.25), 6) AS p25, round(quantile_cont(coverage, 0.5), 6) AS median, round(avg(coverage), 6) AS mean, round(quantile_cont(coverage, 0.75), 6) AS p75, max(coverage) AS maximum FROM labelled GROUP BY strategy")
def coverage_distribution(spark, sf_dir):
    return rounded(E.distribution(conditions(spark, sf_dir), "coverage", ["strategy"]))


@query(f"{W} SELECT k, round(avg(coverage), 6) AS mean_coverage, round(median(coverage), 6) AS median_coverage, round(avg(mean_score), 6) AS mean_mean_score, round(median(mean_score), 6) AS median_mean_score FROM labelled GROUP BY k")
def signal_summary(spark, sf_dir):
    return rounded(E.mean_median(conditions(spark, sf_dir), ["k"], ["coverage", "mean_score"]))


@query(f"""WITH {PREDICTIONS}, t AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS "constraint", unnest([0.9, 0.72, 0.56])::DOUBLE AS threshold),
x AS (SELECT "constraint", threshold, CAST(count(*) FILTER (WHERE p >= threshold) AS BIGINT) AS answered, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE p >= threshold AND y = 0) AS BIGINT) AS unsafe FROM predictions, t WHERE split = 'test' GROUP BY 1, 2)
SELECT *, round(answered::DOUBLE / total, 6) AS coverage, CASE WHEN answered > 0 THEN round(unsafe::DOUBLE / answered, 6) END AS risk FROM x""")
def frozen_threshold_rows(spark, sf_dir):
    test = predictions(spark, sf_dir).filter("split = 'test'")
    return rounded(E.frozen_thresholds(test, "y", "p", {0.05: 0.9, 0.1: 0.72, 0.2: 0.56}))


@query(f"""WITH {PREDICTIONS}, {TRAJECTORIES}, g AS (SELECT unnest(['g1', 'g2', 'g3']) AS policy, unnest([0.3, 0.5, 0.56])::DOUBLE AS low, unnest([0.7, 0.9, 0.72])::DOUBLE AS high),
a AS (SELECT policy, low, high, y5, y10, CASE WHEN p5 >= high THEN 'answer_k5' WHEN p5 < low THEN 'abstain_k5' WHEN p10 >= high THEN 'answer_k10' ELSE 'abstain_k10' END AS action FROM trajectories, g),
b AS (SELECT *, CASE WHEN action LIKE '%k10' THEN y10 ELSE y5 END AS y FROM a),
m AS (SELECT policy, count(*)::DOUBLE AS total, CAST(count(*) FILTER (WHERE action LIKE 'answer%') AS BIGINT) AS answered, count(*) FILTER (WHERE action LIKE 'answer%' AND y = 0) AS unsafe, count(*) FILTER (WHERE action LIKE '%k10') AS expanded,
  count(*) FILTER (WHERE action LIKE 'abstain%' AND y = 1) AS missed, count(*) FILTER (WHERE y = 1) AS could FROM b GROUP BY policy)
SELECT policy, answered, round(answered / total, 6) AS coverage, CASE WHEN answered > 0 THEN round(unsafe::DOUBLE / answered, 6) END AS risk, round(expanded / total, 6) AS expansion, CASE WHEN could > 0 THEN round(missed::DOUBLE / could, 6) END AS false_abstention, round(5 + 5 * (expanded / total), 6) AS mean_k FROM m""")
def final_test_policies(spark, sf_dir):
    """Frozen policies; false abstentions are counted over questions that the final context answers."""
    frozen = spark.createDataFrame([("g1", 0.3, 0.7), ("g2", 0.5, 0.9), ("g3", 0.56, 0.72)], "policy string, low double, high double")
    counted = trajectories(spark, sf_dir).groupBy("p5", "p10", "y5", "y10").agg(F.count(F.lit(1)).alias("n"))
    acted = counted.crossJoin(F.broadcast(frozen)).withColumn("action", action(F.col("p5"), F.col("p10"), F.col("low"), F.col("high")))
    return rounded(policy_metrics(acted, ["policy"], "final"))


ANNOTATED = f"""{W}, sample AS (SELECT 's' || question_id AS sample_id, question_id, CAST(y_suff AS INTEGER) AS automatic, stratum FROM labelled WHERE k = 5 AND y_suff IS NOT NULL AND split <> 'test'),
ann AS (SELECT sample_id, 'a1' AS who, CASE WHEN question_id % 17 = 0 THEN 'ambiguous' WHEN (question_id % 5 = 0) <> (automatic = 1) THEN 'sufficient' ELSE 'insufficient' END AS label FROM sample
  UNION ALL SELECT sample_id, 'a2', CASE WHEN question_id % 19 = 0 THEN 'ambiguous' WHEN (question_id % 6 = 0) <> (automatic = 1) THEN 'sufficient' ELSE 'insufficient' END FROM sample WHERE question_id % 2 = 0)"""


def annotations(spark, sf_dir):
    """(annotation rows as people leave them, answer key, population) for the questions at depth 5."""
    rows = conditions(spark, sf_dir).filter("k = 5 and y_suff is not null and split <> 'test'")
    key = rows.select(F.concat(F.lit("s"), "question_id").alias("sample_id"), "question_id", F.col("y_suff").alias("automatic_y_suff"), F.col("stratum").alias("sampling_stratum"))
    q, positive = F.col("question_id"), F.col("automatic_y_suff") == 1

    def by(name: str, unclear: int, wrong: int):
        label = F.when(q % unclear == 0, " Ambiguous").when((q % wrong == 0) != positive, "SUFFICIENT ").otherwise("insufficient")
        return key.select("sample_id", "question_id", F.lit(f" {name}").alias("annotator_id"), F.lit("2026-01-02T03:04:05Z").alias("annotation_timestamp"), label.alias("manual_label"))

    done = by("a1", 17, 5).unionByName(by("a2", 19, 6).filter("question_id % 2 = 0"))
    open_ = by("a3", 17, 5).withColumn("manual_label", F.lit(" "))
    population = E.stratum_frequencies(conditions(spark, sf_dir))
    return done.unionByName(open_).drop("question_id"), key.drop("question_id"), population


def human(spark, sf_dir):
    return E.human_evaluation(*annotations(spark, sf_dir), "a1", {"accuracy": 0.85, "precision": 0.9, "kappa": 0.7})


@query(ANNOTATED + f""", j AS (SELECT a.who AS annotator_id, a.label, s.automatic, s.stratum, CASE a.label WHEN 'sufficient' THEN 1 WHEN 'insufficient' THEN 0 END AS truth FROM ann a JOIN sample s USING (sample_id)),
n AS (SELECT annotator_id, CAST(count(*) AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE label = 'sufficient') AS BIGINT) AS sufficient, CAST(count(*) FILTER (WHERE label = 'insufficient') AS BIGINT) AS insufficient, CAST(count(*) FILTER (WHERE label = 'ambiguous') AS BIGINT) AS ambiguous FROM j GROUP BY annotator_id),
c AS (SELECT annotator_id, {CELLS.format(y='truth', p='automatic')} FROM j WHERE truth IS NOT NULL GROUP BY annotator_id), r AS (SELECT *, {RATES} FROM c),
pop AS (SELECT stratum, count(*) AS size FROM labelled WHERE split IN ('train', 'validation') AND y_suff IS NOT NULL GROUP BY stratum), who AS (SELECT DISTINCT annotator_id FROM j),
sc AS (SELECT annotator_id, stratum, count(*)::DOUBLE AS n, {CELLS.format(y='truth', p='automatic')} FROM j WHERE truth IS NOT NULL GROUP BY annotator_id, stratum),
wx AS (SELECT who.annotator_id, count(*) FILTER (WHERE sc.n IS NULL) AS gone, {", ".join(f"sum(pop.size::DOUBLE / (SELECT sum(size) FROM pop) * sc.{c} / sc.n) AS {c}" for c in ("tn", "fp", "fn", "tp"))} FROM who CROSS JOIN pop LEFT JOIN sc ON sc.annotator_id = who.annotator_id AND sc.stratum = pop.stratum GROUP BY who.annotator_id),
wr AS (SELECT annotator_id, tn + tp AS a, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS c FROM wx WHERE gone = 0)
SELECT n.*, tn, fp, fn, tp, accuracy, "precision", recall, f1, round(wr.a, 6) AS weighted_accuracy, round(wr.p, 6) AS weighted_precision, round(wr.c, 6) AS weighted_recall, CASE WHEN wr.p + wr.c > 0 THEN round(2 * wr.p * wr.c / (wr.p + wr.c), 6) WHEN wr.p IS NOT NULL AND wr.c IS NOT NULL THEN 0 END AS weighted_f1
FROM n LEFT JOIN r ON r.annotator_id = n.annotator_id LEFT JOIN wr ON wr.annotator_id = n.annotator_id""")
def human_annotator_results(spark, sf_dir):
    return rounded(human(spark, sf_dir)["annotators"])


PAIRED = ANNOTATED + """, pairs AS (SELECT a.sample_id, a.label AS x, b.label AS y FROM ann a JOIN ann b ON a.sample_id = b.sample_id AND a.who = 'a1' AND b.who = 'a2'),
t AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN x = y THEN 1 ELSE 0 END)::DOUBLE AS met FROM pairs), mx AS (SELECT x AS l, count(*)::DOUBLE AS c FROM pairs GROUP BY x), my AS (SELECT y AS l, count(*)::DOUBLE AS c FROM pairs GROUP BY y),
ch AS (SELECT coalesce(sum(mx.c * my.c), 0) AS s FROM mx JOIN my USING (l)), ag AS (SELECT CAST(n AS BIGINT) AS n, met / n AS agreement, (met / n - s / (n * n)) / (1 - s / (n * n)) AS kappa FROM t, ch)"""


@query(PAIRED + " SELECT n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM ag")
def human_agreement(spark, sf_dir):
    return rounded(human(spark, sf_dir)["agreement"])


@query(PAIRED + """, d AS (SELECT 'automatic_human' AS scope, CASE WHEN a.label = 'ambiguous' THEN 'automatic_vs_human_ambiguous' WHEN s.automatic = 1 THEN 'automatic_sufficient_human_insufficient' ELSE 'automatic_insufficient_human_sufficient' END AS category, s.stratum
  FROM ann a JOIN sample s USING (sample_id) WHERE a.who = 'a1' AND (a.label = 'ambiguous' OR (a.label = 'sufficient') <> (s.automatic = 1))
  UNION ALL SELECT 'human_human', 'human_label_disagreement', s.stratum FROM pairs p JOIN sample s USING (sample_id) WHERE p.x <> p.y)
SELECT scope, category, stratum, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY ALL""")
def human_disagreements(spark, sf_dir):
    rows = human(spark, sf_dir)["disagreements"]
    return rows.groupBy("scope", "category", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query()
def human_gates(spark, sf_dir):
    return rounded(human(spark, sf_dir)["gates"])
