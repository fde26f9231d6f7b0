"""Classification, agreement, calibration and threshold-search aggregates, each one grouped aggregation or one window."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragstone.functions.vectors import ratio, wilson

from .ordering import running

#: A group column that puts all rows into one group.
ALL = "__all"


def _groups(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn(ALL, F.lit(1)), [ALL])


def confusion(truth: Column, prediction: Column) -> list[Column]:
    return [
        F.count_if((truth == 0) & (prediction == 0)).alias("tn"),
        F.count_if((truth == 0) & (prediction == 1)).alias("fp"),
        F.count_if((truth == 1) & (prediction == 0)).alias("fn"),
        F.count_if((truth == 1) & (prediction == 1)).alias("tp"),
    ]


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """accuracy, precision, recall, f1: null where a denominator is 0; f1 is 0 where precision or recall is 0."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(precision.isNull() | recall.isNull(), F.lit(None).cast("double")).when(
        precision + recall == 0, 0.0
    ).otherwise(2 * precision * recall / (precision + recall))
    return {"accuracy": ratio(tn + tp, tn + fp + fn + tp), "precision": precision, "recall": recall, "f1": f1}


def zero_division_rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """The same with 0 where a denominator is 0."""
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in rates(tn, fp, fn, tp).items()}


def confusion_rates(df: DataFrame, truth: str, prediction: str, by: list[str] = ()) -> DataFrame:
    df, by = _groups(df, list(by))
    cells = df.groupBy(*by).agg(*confusion(F.col(truth), F.col(prediction)))
    return cells.withColumns(rates(*(F.col(c) for c in ("tn", "fp", "fn", "tp")))).drop(ALL)


def weighted_confusion(df: DataFrame, truth: str, prediction: str, stratum: str, population: DataFrame) -> DataFrame:
    """Cell shares weighted to the population: sum over strata of N_s / N * cell / n_s. population: stratum, size.

    One row; null throughout if a stratum of the population has no row."""
    cells = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *confusion(F.col(truth), F.col(prediction)))
    total = population.agg(F.sum("size").cast("double").alias("total"))
    joined = population.join(cells, stratum, "left").crossJoin(F.broadcast(total))
    names = ("tn", "fp", "fn", "tp")
    share = lambda c: F.sum(F.col("size") / F.col("total") * F.col(c) / F.col("n"))
    full = F.count_if(F.col("n").isNull()) == 0
    return joined.agg(*[F.when(full, share(c)).alias(c) for c in names]).withColumns(rates(*(F.col(c) for c in names)))


def wilson_rows(df: DataFrame, success: Column, by: list[str]) -> DataFrame:
    low, high = wilson(F.col("successes"), F.col("trials"))
    counted = df.groupBy(*by).agg(F.count_if(success).alias("successes"), F.count(F.lit(1)).alias("trials"))
    return counted.withColumns({"lower": low, "upper": high})


def cohens_kappa(df: DataFrame, first: str, second: str, by: list[str] = ()) -> DataFrame:
    """n, agreement, kappa from the two annotators' labels; null where chance agreement is certain."""
    df, by = _groups(df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()), list(by))
    cell = df.groupBy(*by, F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    shares = cell.withColumns(
        {
            "total": F.sum("n").over(w),
            "row": F.sum("n").over(Window.partitionBy(*by, "a")),
            "met": F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0),
        }
    )
    # Chance agreement needs the product of margins per label: a's rows against b's columns.
    a = cell.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    b = cell.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    totals = shares.groupBy(*by).agg(F.max("total").alias("n"), F.sum("met").alias("met"))
    joined = totals.join(chance, by, "left").withColumn("chance", F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n")))
    agreement = F.col("met") / F.col("n")
    kappa = F.when(F.col("chance") < 1, (agreement - F.col("chance")) / (1 - F.col("chance")))
    return joined.select(*by, "n", agreement.alias("agreement"), kappa.alias("kappa")).drop(ALL)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the group, ties sharing their mean."""
    ordered, tied = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def auroc(df: DataFrame, y: str, score: str, by: list[str] = ()) -> DataFrame:
    """auroc per group; null with one class. Rows are first counted by score, and the distinct scores are summed along
    their order by buckets, so no task sees a whole group."""
    df, by = _groups(df, list(by))
    counted = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = running(counted.withColumn("neg", F.col("n") - F.col("pos")), by, score, ["neg"])
    wins = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    summed = before.withColumn("wins", wins).groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    negatives = F.col("n") - F.col("p")
    return summed.select(*by, ratio(F.col("wins"), F.col("p") * negatives).alias("auroc")).drop(ALL)


def average_precision(df: DataFrame, y: str, score: str, by: list[str] = ()) -> DataFrame:
    """Sum of precision times recall step over distinct scores, descending; a step function, no trapezoids."""
    df, by = _groups(df, list(by))
    counted = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = running(counted, by, score, ["pos", "n"], descending=True)
    precision = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    steps = before.withColumn("gain", F.col("pos") * precision)
    return steps.groupBy(*by).agg(ratio(F.sum("gain"), F.sum("pos")).alias("average_precision")).drop(ALL)


def brier(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    df, by = _groups(df, list(by))
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")).drop(ALL)


def reliability_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, accuracy, confidence, gap for every bin, empty ones with 0 rows and nulls."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("accuracy"), F.avg(p).alias("confidence"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(found, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """ece: the mean gap weighted by rows."""
    return bins.agg((F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n")).alias("ece"))


def grid(spark: SparkSession, values: Iterable[float], name: str = "threshold") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))


def at_thresholds(df: DataFrame, y: str, score: str, thresholds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Confusion cells at each threshold (prediction: score >= threshold).

    Rows are counted by score before they meet the grid, which has a bounded number of rows and is broadcast."""
    by = list(by)
    counted = df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    said, neg = F.col(score) >= F.col("threshold"), F.col("n") - F.col("pos")
    zero = F.lit(0)
    return (
        counted.crossJoin(F.broadcast(thresholds))
        .groupBy(*by, "threshold")
        .agg(
            F.sum(F.when(~said, neg).otherwise(zero)).alias("tn"),
            F.sum(F.when(said, neg).otherwise(zero)).alias("fp"),
            F.sum(F.when(~said, F.col("pos")).otherwise(zero)).alias("fn"),
            F.sum(F.when(said, F.col("pos")).otherwise(zero)).alias("tp"),
        )
    )


def scored_thresholds(cells: DataFrame) -> DataFrame:
    return cells.withColumns(zero_division_rates(*(F.col(c) for c in ("tn", "fp", "fn", "tp"))))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The row of the largest (f1, precision, threshold)."""
    return scored.orderBy(F.desc("f1"), F.desc("precision"), F.desc("threshold")).limit(1)


def best_over_folds(df: DataFrame, y: str, score: str, fold: str, thresholds: DataFrame) -> DataFrame:
    """threshold, mean f1 and precision over folds, best first by (f1, precision, -threshold)."""
    per = scored_thresholds(at_thresholds(df, y, score, thresholds, [fold]))
    return per.groupBy("threshold").agg(F.avg("f1").alias("mean_f1"), F.avg("precision").alias("mean_precision"))


def penalised_tuning(df: DataFrame, y: str, score: str, thresholds: DataFrame, most_unsafe: float = 0.2) -> DataFrame:
    """The threshold of the largest f1 - .3 false abstention - .7 unsafe among those unsafe at most `most_unsafe`; if
    there is none, the least unsafe one. unsafe: wrong answers among all; false abstention: missed among answerable."""
    cells = scored_thresholds(at_thresholds(df, y, score, thresholds))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    scored = cells.withColumns(
        {"unsafe": F.coalesce(ratio(fp, tn + fp), F.lit(0.0)), "false_abstention": F.coalesce(ratio(fn, fn + tp), F.lit(0.0))}
    ).withColumn("objective", F.col("f1") - 0.3 * F.col("false_abstention") - 0.7 * F.col("unsafe"))
    allowed = F.col("unsafe") <= most_unsafe
    return scored.withColumn("allowed", allowed).orderBy(
        F.desc("allowed"), F.when(allowed, -F.col("objective")).otherwise(F.col("unsafe")), "threshold"
    ).limit(1)


def gates(metrics: DataFrame, cutoffs: dict[str, float]) -> DataFrame:
    """gate, observed, minimum, status for one row of metrics: pass, fail, or pending where nothing was observed."""
    rows = metrics.unpivot([], list(cutoffs), "gate", "observed")
    least = F.create_map(*[F.lit(x) for pair in cutoffs.items() for x in pair])
    status = F.when(F.col("observed").isNull(), "pending").when(F.col("observed") >= F.col("minimum"), "pass").otherwise("fail")
    return rows.withColumn("minimum", least[F.col("gate")]).withColumn("status", status)


def rescue_grid(spark: SparkSession, coverages: list[float], means: list[float], minima: list[float], contradiction: float) -> DataFrame:
    """candidate_order, family, t_cov, t_mean, t_min, t_con: coverage rules, score rules, and both joined by or."""
    rows = [("coverage_only", c, None, None, None) for c in coverages]
    rows += [("nli_only", None, m, x, contradiction) for m in means for x in minima]
    rows += [("combined", c, m, x, contradiction) for c in coverages for m in means for x in minima]
    schema = "candidate_order int, family string, t_cov double, t_mean double, t_min double, t_con double"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], schema)


def rescue_signals() -> tuple[Column, Column]:
    """(by coverage, by scores) for a row next to a candidate; a null input says no."""
    by_coverage = F.coalesce(F.col("coverage") >= F.col("t_cov"), F.lit(False))
    by_scores = F.coalesce(
        (F.col("mean_score") >= F.col("t_mean")) & (F.col("min_score") >= F.col("t_min")) & (F.col("contradiction") < F.col("t_con")),
        F.lit(False),
    )
    return by_coverage, by_scores


def rescued_prediction() -> Column:
    """A strict positive stays positive; a negative is rescued by the candidate's family of signals."""
    by_coverage, by_scores = rescue_signals()
    rescued = (
        F.when(F.col("family") == "coverage_only", by_coverage)
        .when(F.col("family") == "nli_only", by_scores)
        .otherwise(by_coverage | by_scores)
    )
    return F.when(F.col("strict") == 1, 1).otherwise(rescued.cast("int"))


def evaluated_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confusion, rates and rescue counts of each candidate. rows: strict, truth, coverage and scores.

    Rows are counted by what the rules compare, the place of each signal among the thresholds, before they meet the grid:
    what is multiplied is bounded by the thresholds, not by the rows."""
    bounds = candidates.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("t_cov", "t_mean", "t_min", "t_con")])
    reached = lambda value, cuts: F.size(F.filter(cuts, lambda t: F.col(value) >= t))
    pairs = {"coverage": "t_cov", "mean_score": "t_mean", "min_score": "t_min", "contradiction": "t_con"}
    placed = rows.crossJoin(F.broadcast(bounds)).select(
        "strict", "truth", *[F.when(F.col(v).isNotNull(), reached(v, F.col(t))).alias(v) for v, t in pairs.items()]
    )
    counted = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("n"))
    ranked = candidates.crossJoin(F.broadcast(bounds.select(*[F.col(t).alias(f"all_{t}") for t in pairs.values()]))).withColumns(
        {t: F.when(F.col(t).isNotNull(), F.array_position(F.col(f"all_{t}"), F.col(t)).cast("double")) for t in pairs.values()}
    )
    by_coverage, by_scores = rescue_signals()
    fresh = (F.col("strict") == 0) & (F.col("prediction") == 1)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    cell = lambda t, p: total((F.col("truth") == t) & (F.col("prediction") == p))
    cells = (
        counted.crossJoin(F.broadcast(ranked))
        .withColumn("prediction", rescued_prediction())
        .groupBy("candidate_order", "family")
        .agg(
            cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
            total(fresh & by_coverage).alias("rescued_by_coverage"),
            total(fresh & by_scores).alias("rescued_by_nli"),
            total(fresh & by_coverage & by_scores).alias("overlap"),
        )
    )
    return cells.withColumns(rates(*(F.col(c) for c in ("tn", "fp", "fn", "tp"))))


def select_candidate(evaluated: DataFrame, least_precision: float, tolerance: float = 1e-9) -> DataFrame:
    """Gate on precision, then f1 and recall within the tolerance, then the simpler family and the earlier candidate."""
    family = F.element_at(F.create_map(*[F.lit(x) for p in (("coverage_only", 0), ("nli_only", 1), ("combined", 2)) for x in p]), F.col("family"))
    everything = Window.partitionBy(F.lit(1))
    kept = evaluated.filter(F.col("precision") >= least_precision)
    tied = kept.withColumn("best", F.max("f1").over(everything)).filter(F.abs(F.col("f1") - F.col("best")) <= tolerance)
    again = tied.withColumn("best", F.max("recall").over(everything)).filter(F.abs(F.col("recall") - F.col("best")) <= tolerance)
    return again.orderBy(family, "candidate_order").limit(1).drop("best")
