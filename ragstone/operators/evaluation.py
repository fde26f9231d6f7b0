"""Sufficiency evaluation: strata, completed annotations, agreement with people, rescue targets, and joins that refuse.

Rules that a broken table must not pass are part of the plan: they raise when rows are computed, in one pass, and cost no
job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.vectors import ratio

from .metrics import cohens_kappa, confusion, confusion_rates, gates, rates, rescue_signals, rescued_prediction, weighted_confusion

# Names of strata and labels that results depend on.
SAMPLING_STRATA = (
    "automatic_positive", "partial_overlap", "correct_document_insufficient", "wrong_document_retrieval", "benchmark_impossible",
)
MANUAL_LABELS = ("sufficient", "insufficient", "ambiguous")
FORBIDDEN_BLINDED = (
    "automatic_y_suff", "y_suff", "label_method", "label_status", "gold_document_hit", "maximum_span_coverage_fraction",
    "partial_overlap", "sampling_stratum",
)


def refused(condition: Column, value: Column, message: str) -> Column:
    """value, or an error where the condition holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def confirmation_stratum(strict: Column, semantic: Column) -> Column:
    """Four strata of a strict and a semantic label."""
    return F.concat(
        F.when(strict == 1, "strict_positive_").otherwise("strict_negative_"),
        F.when(semantic == 1, "semantic_positive").otherwise("semantic_negative"),
    )


def retention_stratum(strict: Column, final: Column) -> Column:
    """What a strict-preserving rule did to a row."""
    return F.when(strict == 1, "strict_positive_retained").when(final == 1, "strict_negative_rescued").otherwise("strict_negative_not_rescued")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of tables whose keys must match one to one; a key that is missing on a side or repeated is an error."""
    counted = lambda df, n: df.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    both = counted(left, "__left").join(counted(right, "__right"), keys, "full_outer")
    wrong = F.coalesce(F.col("__left"), F.lit(0)) + F.coalesce(F.col("__right"), F.lit(0)) != 2
    checked = both.withColumn(keys[0], refused(wrong, F.col(keys[0]), f"keys {keys} don't match one to one"))
    return checked.drop("__left", "__right")


def with_condition(targets: DataFrame, conditions: DataFrame, keys: list[str]) -> DataFrame:
    """targets with the columns of their condition; a target without one, or with several, is an error."""
    known = conditions.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    joined = targets.join(known, keys, "left")
    wrong = F.coalesce(F.col("__n"), F.lit(0)) != 1
    return joined.withColumn(keys[0], refused(wrong, F.col(keys[0]), f"a target needs one condition by {keys}")).drop("__n")


def same_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables joined by a key that all of them must have exactly once."""
    out = tables[0]
    for df in tables[1:]:
        out = one_to_one(out, df, [key])
    return out


def unused(rows: DataFrame, used: DataFrame, question: str) -> DataFrame:
    """rows of questions that weren't used before; null questions stay."""
    return rows.join(used.select(question).distinct(), question, "left_anti")


def distribution(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, minimum, p25, median, mean, p75, maximum (linear percentiles); nulls don't count, without values all are null.

    The percentiles are exact: Spark counts the distinct values of a group in one reducer, so this is for lengths, ranks
    and other values of few kinds."""
    at = lambda q: F.percentile(F.col(value).cast("double"), q)
    named = [F.count(value).alias("n"), F.min(value).alias("minimum"), at(0.25).alias("p25"), at(0.5).alias("median")]
    return df.groupBy(*by).agg(*named, F.avg(value).alias("mean"), at(0.75).alias("p75"), F.max(value).alias("maximum"))


def mean_median(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and median of each column over its known values; null without any."""
    parts = [f(c).alias(f"{name}_{c}") for c in values for name, f in (("mean", F.avg), ("median", F.median))]
    return df.groupBy(*by).agg(*parts)


def stratum_frequencies(labels: DataFrame, stratum: str = "stratum", split: str = "split", y: str = "y_suff") -> DataFrame:
    """stratum, size: resolved development rows in each of the five sampling strata; an empty or unknown one is an error."""
    rows = labels.filter(F.col(split).isin("train", "validation") & F.col(y).isNotNull())
    counted = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    every = labels.sparkSession.createDataFrame([(s,) for s in SAMPLING_STRATA], "stratum string")
    joined = every.withColumn("known", F.lit(True)).join(counted, "stratum", "full_outer")
    wrong = F.col("known").isNull() | F.col("size").isNull()
    return joined.select(refused(wrong, F.col("stratum"), "a sampling stratum is empty or unknown").alias("stratum"), "size")


def completed_annotations(rows: DataFrame, key: DataFrame) -> DataFrame:
    """sample_id, annotator_id, annotation_timestamp, manual_label of the rows with a label, trimmed and in lower case.

    Errors: a column that blinding forbids; a label that isn't one; no annotator or time; a sample that the key lacks; two
    rows of one sample and annotator."""
    exposed = sorted(set(FORBIDDEN_BLINDED) & set(rows.columns))
    if exposed:
        raise ValueError(f"annotations show what they must not: {exposed}")
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    done = rows.select(
        clean("sample_id").alias("sample_id"),
        clean("annotator_id").alias("annotator_id"),
        clean("annotation_timestamp").alias("annotation_timestamp"),
        F.lower(clean("manual_label")).alias("manual_label"),
    ).filter("manual_label <> ''")
    n = F.count(F.lit(1)).over(Window.partitionBy("sample_id", "annotator_id"))
    known = key.select("sample_id", F.lit(True).alias("known"))
    checked = done.withColumn("n", n).join(known, "sample_id", "left")
    label = F.col("manual_label")
    for condition, message in (
        (~label.isin(*MANUAL_LABELS), "unknown manual label"),
        (F.col("annotator_id") == "", "a completed annotation lacks its annotator"),
        (F.col("annotation_timestamp") == "", "a completed annotation lacks its time"),
        (F.col("known").isNull(), "an annotated sample isn't in the answer key"),
        (F.col("n") > 1, "two annotations of one sample and annotator"),
    ):
        label = refused(condition, label, message)
    return checked.select("sample_id", "annotator_id", "annotation_timestamp", label.alias("manual_label"))


def _against_key(completed: DataFrame, key: DataFrame) -> DataFrame:
    hidden = key.select("sample_id", F.col("automatic_y_suff").alias("prediction"), F.col("sampling_stratum").alias("stratum"))
    truth = F.when(F.col("manual_label") == "sufficient", 1).when(F.col("manual_label") == "insufficient", 0)
    return completed.join(hidden, "sample_id").withColumn("truth", truth)


def annotator_results(completed: DataFrame, key: DataFrame, population: DataFrame) -> DataFrame:
    """One row per annotator: counts of labels, confusion and rates of the automatic label against the unambiguous ones,
    and the same rates weighted by stratum to the population (stratum, size)."""
    rows = _against_key(completed, key)
    labels = [F.count_if(F.col("manual_label") == x).alias(x) for x in MANUAL_LABELS]
    counts = rows.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("completed"), *labels)
    clear = rows.filter("truth is not null")
    plain = confusion_rates(clear, "truth", "prediction", ["annotator_id"])
    cells = clear.groupBy("annotator_id", "stratum").agg(F.count(F.lit(1)).alias("n"), *confusion(F.col("truth"), F.col("prediction")))
    total = population.agg(F.sum("size").cast("double").alias("total"))
    every = counts.select("annotator_id").crossJoin(F.broadcast(population.crossJoin(total)))
    joined = every.join(cells, ["annotator_id", "stratum"], "left")
    names = ("tn", "fp", "fn", "tp")
    full = F.count_if(F.col("n").isNull()) == 0
    share = lambda c: F.when(full, F.sum(F.col("size") / F.col("total") * F.col(c) / F.col("n")))
    summed = joined.groupBy("annotator_id").agg(*[share(c).alias(c) for c in names])
    weighted = summed.select("annotator_id", *[v.alias(f"weighted_{k}") for k, v in rates(*(F.col(c) for c in names)).items()])
    return counts.join(plain, "annotator_id", "left").join(weighted, "annotator_id", "left")


def paired_annotations(completed: DataFrame, primary: str) -> DataFrame:
    """Samples that the primary annotator and another one labelled: sample_id, second, first_label, second_label."""
    mine = completed.filter(F.col("annotator_id") == primary).select("sample_id", F.col("manual_label").alias("first_label"))
    other = completed.filter(F.col("annotator_id") != primary).select(
        "sample_id", F.col("annotator_id").alias("second"), F.col("manual_label").alias("second_label")
    )
    return mine.join(other, "sample_id")


def disagreements(completed: DataFrame, key: DataFrame, primary: str) -> DataFrame:
    """scope, sample_id, annotator_id, second_annotator_id, automatic_label, human_label, second_human_label, stratum,
    category: where the automatic label and the primary annotator differ, and where two annotators do."""
    mine = _against_key(completed.filter(F.col("annotator_id") == primary), key)
    automatic = F.when(F.col("prediction") == 1, "sufficient").otherwise("insufficient")
    category = (
        F.when(F.col("truth").isNull(), "automatic_vs_human_ambiguous")
        .when((F.col("prediction") == 1) & (F.col("truth") == 0), "automatic_sufficient_human_insufficient")
        .when((F.col("prediction") == 0) & (F.col("truth") == 1), "automatic_insufficient_human_sufficient")
    )
    by_machine = mine.withColumn("category", category).filter("category is not null").select(
        F.lit("automatic_human").alias("scope"), "sample_id", "annotator_id", F.lit("").alias("second_annotator_id"),
        automatic.alias("automatic_label"), F.col("manual_label").alias("human_label"), F.lit("").alias("second_human_label"), "stratum", "category",
    )
    pairs = paired_annotations(completed, primary).filter("first_label <> second_label")
    hidden = key.select("sample_id", "automatic_y_suff", F.col("sampling_stratum").alias("stratum"))
    by_people = pairs.join(hidden, "sample_id").select(
        F.lit("human_human").alias("scope"), "sample_id", F.lit(primary).alias("annotator_id"), F.col("second").alias("second_annotator_id"),
        F.when(F.col("automatic_y_suff") == 1, "sufficient").otherwise("insufficient").alias("automatic_label"),
        F.col("first_label").alias("human_label"), F.col("second_label").alias("second_human_label"), "stratum",
        F.lit("human_label_disagreement").alias("category"),
    )
    return by_machine.unionByName(by_people)


def human_evaluation(rows: DataFrame, key: DataFrame, population: DataFrame, primary: str, cutoffs: dict[str, float]) -> dict[str, DataFrame]:
    """annotators, agreement (one row: n, agreement, kappa), disagreements and gates of a completed annotation."""
    completed = completed_annotations(rows, key)
    results = annotator_results(completed, key, population)
    agreement = cohens_kappa(paired_annotations(completed, primary), "first_label", "second_label")
    observed = results.filter(F.col("annotator_id") == primary).select("accuracy", "precision", "recall", "weighted_f1")
    one = observed.crossJoin(F.broadcast(agreement.select("kappa")))  # one row each
    return {
        "annotators": results,
        "agreement": agreement,
        "disagreements": disagreements(completed, key, primary),
        "gates": gates(one.select(*[F.col(c).cast("double").alias(c) for c in cutoffs]), cutoffs),
    }


def marked_grid(grid: DataFrame, earlier: DataFrame) -> DataFrame:
    """A rescue grid with `before`: whether an earlier grid had the same rule."""
    rule = ["family", "t_cov", "t_mean", "t_min", "t_con"]
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"e.{c}")) for c in rule]
    known = earlier.select(*rule, F.lit(True).alias("before"))
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return grid.alias("g").join(known.alias("e"), condition, "left").select("g.*", F.coalesce("before", F.lit(False)).alias("before"))


def best_by_family(evaluated: DataFrame, least_precision: float, tolerance: float = 1e-9) -> DataFrame:
    """The candidate of each family: within the gate by f1 and recall (ties within the tolerance go to the earlier one);
    where none passes, the one of the largest (precision, f1, recall), the earlier of equals."""
    family = Window.partitionBy("family")
    passes = F.coalesce(F.col("precision") >= least_precision, F.lit(False))
    best = evaluated.withColumn("passes", passes).withColumn("any_passes", F.max(passes.cast("int")).over(family))
    best = best.withColumn("top_f1", F.max(F.when(passes, F.col("f1"))).over(family))
    best = best.withColumn("near", F.coalesce(passes & (F.abs(F.col("f1") - F.col("top_f1")) <= tolerance), F.lit(False)))
    best = best.withColumn("top_recall", F.max(F.when(F.col("near"), F.col("recall"))).over(family))
    chosen = F.coalesce(F.col("near") & (F.abs(F.col("recall") - F.col("top_recall")) <= tolerance), F.lit(False))
    known = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    order = family.orderBy(F.desc(chosen), *[F.desc(F.when(F.col("any_passes") == 0, known(c))) for c in ("precision", "f1", "recall")], "candidate_order")
    return best.withColumn("place", F.row_number().over(order)).filter("place = 1").select("family", "candidate_order", "passes", "precision", "f1", "recall")


def final_target(rows: DataFrame, candidate: dict) -> DataFrame:
    """rows (strict, coverage, scores, evaluable) with final, coverage_rescue, nli_rescue, rescued and status by one frozen
    rule; what can't be evaluated has nulls. candidate: family, t_cov, t_mean, t_min, t_con."""
    kinds = {"family": "string"}
    ruled = rows.withColumns({k: F.lit(v).cast(kinds.get(k, "double")) for k, v in candidate.items()})
    by_coverage, by_scores = rescue_signals()
    usable, negative = F.col("evaluable"), F.col("strict") == 0
    out = ruled.withColumn("final", F.when(usable, rescued_prediction()))
    rescued = negative & (F.col("final") == 1)
    return out.withColumns(
        {
            "coverage_rescue": F.when(usable, by_coverage & negative),
            "nli_rescue": F.when(usable, by_scores & negative),
            "rescued": F.when(usable, rescued),
            "status": F.when(usable, retention_stratum(F.col("strict"), F.col("final"))),
        }
    ).drop(*candidate)


def target_census(target: DataFrame, question: str) -> DataFrame:
    """One row of counters of a final target."""
    usable = F.col("evaluable")
    return target.agg(
        F.countDistinct(F.when(usable, F.col(question))).alias("eligible_questions"),
        F.count_if(usable).alias("eligible_conditions"),
        F.count_if(usable & (F.col("strict") == 1)).alias("strict_positive"),
        F.count_if(F.col("rescued")).alias("rescued_positive"),
        F.count_if(F.col("final") == 1).alias("final_positive"),
        F.count_if(F.col("final") == 0).alias("final_negative"),
        F.count_if(F.col("rescued") & F.col("coverage_rescue")).alias("rescued_by_coverage"),
        F.count_if(F.col("rescued") & F.col("nli_rescue")).alias("rescued_by_nli"),
        F.count_if(F.col("rescued") & F.col("coverage_rescue") & F.col("nli_rescue")).alias("rescued_by_both"),
        F.count_if(~usable).alias("unevaluable_conditions"),
    )


def coverage_band(coverage: Column, threshold: Column) -> Column:
    return (
        F.when(coverage.isNull(), "missing")
        .when(threshold.isNotNull() & (coverage < threshold), "below_selected_threshold")
        .otherwise("at_or_above_selected_threshold")
    )


def score_failure(mean: Column, least: Column, contradiction: Column, t_mean: Column, t_min: Column, t_con: Column) -> Column:
    """Why the scores didn't rescue a row, reasons joined by +."""
    reasons = F.concat_ws(
        "+",
        F.when(mean < t_mean, "mean_below_threshold"),
        F.when(least < t_min, "minimum_below_threshold"),
        F.when(contradiction >= t_con, "contradiction_veto"),
    )
    return F.when(t_mean.isNull(), "not_used_by_selected_family").when(reasons != "", reasons).otherwise("nli_passed")


def error_patterns(rows: DataFrame, candidate: dict, dimensions: list[str]) -> DataFrame:
    """error (false_positive, false_negative), dimension, value, n: the errors of one rule counted by each dimension, by
    coverage band and by why the scores failed. rows: strict, truth, coverage, scores and the dimensions."""
    kinds = {"family": "string"}
    ruled = rows.withColumns({k: F.lit(v).cast(kinds.get(k, "double")) for k, v in candidate.items()}).withColumn("prediction", rescued_prediction())
    error = F.when((F.col("truth") == 1) & (F.col("prediction") == 0), "false_negative").when((F.col("truth") == 0) & (F.col("prediction") == 1), "false_positive")
    named = {d: F.col(d).cast("string") for d in dimensions}
    named["coverage_band"] = coverage_band(F.col("coverage"), F.col("t_cov"))
    named["score_failure"] = score_failure(F.col("mean_score"), F.col("min_score"), F.col("contradiction"), F.col("t_mean"), F.col("t_min"), F.col("t_con"))
    wrong = ruled.withColumn("error", error).filter("error is not null").select("error", *[c.alias(k) for k, c in named.items()])
    return wrong.unpivot(["error"], list(named), "dimension", "value").groupBy("error", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def census(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """Rows, positives and their share by condition."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("positive"), F.avg(y).alias("share"))


def frozen_thresholds(df: DataFrame, y: str, p: str, thresholds: dict[float, float]) -> DataFrame:
    """constraint, threshold, answered, total, coverage, unsafe, risk at thresholds that were fixed elsewhere. Rows are
    counted by score and label before they meet the few thresholds."""
    fixed = df.sparkSession.createDataFrame(list(thresholds.items()), "constraint double, threshold double")
    counted = df.groupBy(F.col(p).alias("p"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    said = F.col("p") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    summed = counted.crossJoin(F.broadcast(fixed)).groupBy("constraint", "threshold").agg(
        n(said).alias("answered"), F.sum("n").alias("total"), n(said & (F.col("y") == 0)).alias("unsafe")
    )
    return summed.withColumns({"coverage": ratio(F.col("answered"), F.col("total")), "risk": ratio(F.col("unsafe"), F.col("answered"))})


def weighted_by_stratum(df: DataFrame, population: DataFrame) -> DataFrame:
    """Rates of truth and prediction weighted to the population's strata, one row."""
    return weighted_confusion(df, "truth", "prediction", "stratum", population)


def recovered(rows: DataFrame, candidate: dict) -> DataFrame:
    """One row for a frozen rule on its development rows: confusion, rates, false negatives of the strict label, and how
    many of them the rule recovers."""
    kinds = {"family": "string"}
    ruled = rows.withColumns({k: F.lit(v).cast(kinds.get(k, "double")) for k, v in candidate.items()}).withColumn("prediction", rescued_prediction())
    missed = (F.col("truth") == 1) & (F.col("strict") == 0)
    cells = ruled.agg(
        *confusion(F.col("truth"), F.col("prediction")),
        F.count_if(missed).alias("strict_false_negatives"),
        F.count_if(missed & (F.col("prediction") == 1)).alias("recovered"),
    )
    return cells.withColumns(rates(*(F.col(c) for c in ("tn", "fp", "fn", "tp"))))
