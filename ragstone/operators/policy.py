"""Selective answering: risk-coverage curves, operating points, two-threshold policies and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.functions.vectors import ratio

from .ordering import running


def risk_coverage(df: DataFrame, y: str, p: str) -> DataFrame:
    """threshold, answered, coverage, risk, step: a row that answers nothing (null risk, null threshold), one for each
    distinct probability, and threshold 0 if it isn't among them. step is the share of rows that a threshold adds."""
    counted = df.groupBy(F.col(p).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(y)).alias("unsafe"))
    before = running(counted, [], "threshold", ["n", "unsafe"], descending=True)
    points = before.select(
        "threshold", (F.col("n") + F.col("before_n")).alias("answered"), (F.col("unsafe") + F.col("before_unsafe")).alias("unsafe"), "n"
    )
    total = df.agg(F.count(F.lit(1)).alias("total"), F.min(p).alias("least"), F.sum(1 - F.col(y)).alias("all_unsafe"))
    zero = F.lit(0).cast("long")
    none = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), zero.alias("answered"), zero.alias("unsafe"), zero.alias("n"))
    least = total.filter("least > 0").select(F.lit(0.0).alias("threshold"), F.col("total").alias("answered"), F.col("all_unsafe").alias("unsafe"), zero.alias("n"))
    share = lambda c: F.col(c) / F.col("total")
    return (
        none.unionByName(points)
        .unionByName(least)
        .crossJoin(F.broadcast(total.select("total")))
        .select("threshold", "answered", share("answered").alias("coverage"), ratio(F.col("unsafe"), F.col("answered")).alias("risk"), share("n").alias("step"))
    )


def aurc(curve: DataFrame) -> DataFrame:
    """Area under risk over coverage by right-endpoint rectangles, each as wide as the share its threshold adds."""
    return curve.filter("risk is not null").agg(F.sum(F.col("step") * F.col("risk")).alias("aurc"))


def operating_points(curve: DataFrame, constraints: DataFrame) -> DataFrame:
    """constraint, feasible, threshold, coverage, risk: the widest coverage (then the highest threshold) within the risk."""
    best = (
        curve.crossJoin(F.broadcast(constraints))
        .filter((F.col("risk") <= F.col("constraint")) & F.col("threshold").isNotNull())
        .groupBy("constraint")
        .agg(F.max(F.struct("coverage", "threshold", "risk")).alias("b"))
        .select("constraint", "b.*")
    )
    return constraints.join(best, "constraint", "left").select(
        "constraint", F.col("coverage").isNotNull().alias("feasible"), "threshold", "coverage", "risk"
    )


def action(p5: Column, p10: Column, low: Column, high: Column) -> Column:
    """answer at once, answer after one expansion, or abstain; at a bound: high answers, low expands."""
    return F.when(p5 >= high, "answer_k5").when(p5 < low, "abstain_k5").when(p10 >= high, "answer_k10").otherwise("abstain_k10")


def threshold_pairs(spark: SparkSession, values: list[float]) -> DataFrame:
    """All low < high: a grid of bounded size."""
    v = spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in values])).alias("v"))
    return v.select(F.col("v").alias("low")).join(v.select(F.col("v").alias("high")), F.col("low") < F.col("high"))


def policy_metrics(df: DataFrame, by: list[str], denominator: str = "deep") -> DataFrame:
    """answered, coverage, risk, expansion, false_abstention, mean_k per group of rows with `action`, y5, y10 and `n`.

    False abstention is over rows that the deep context answers (`deep`) or that the final context does (`final`)."""
    answered, at10 = F.col("action").startswith("answer"), F.col("action").endswith("k10")
    y = F.when(at10, F.col("y10")).otherwise(F.col("y5"))
    could = (F.col("y10") if denominator == "deep" else y) == 1
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    summed = df.groupBy(*by).agg(
        F.sum("n").alias("total"),
        n(answered).alias("answered"),
        n(answered & (y == 0)).alias("unsafe"),
        n(at10).alias("expanded"),
        n(~answered & could).alias("missed"),
        n(could).alias("could"),
    )
    total = F.col("total")
    return summed.select(
        *by,
        "answered",
        ratio(F.col("answered"), total).alias("coverage"),
        ratio(F.col("unsafe"), F.col("answered")).alias("risk"),
        ratio(F.col("expanded"), total).alias("expansion"),
        ratio(F.col("missed"), F.col("could")).alias("false_abstention"),
        (5 + 5 * ratio(F.col("expanded"), total)).alias("mean_k"),
    )


def policy_grid(trajectories: DataFrame, pairs: DataFrame) -> DataFrame:
    """policy_metrics() for each pair of thresholds. Trajectories are counted by their four values before they meet the
    grid: what is multiplied by the grid is bounded by the distinct values, not by the rows."""
    counted = trajectories.groupBy("p5", "p10", "y5", "y10").agg(F.count(F.lit(1)).alias("n"))
    acted = counted.crossJoin(F.broadcast(pairs)).withColumn(
        "action", action(F.col("p5"), F.col("p10"), F.col("low"), F.col("high"))
    )
    return policy_metrics(acted, ["low", "high"])


def select_policy(grid: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per constraint the largest (coverage, -expansion, high, low) whose risk is within it."""
    key = F.struct("coverage", (-F.col("expansion")).alias("less"), "high", "low", "risk", "expansion")
    best = (
        grid.crossJoin(F.broadcast(constraints))
        .filter(F.col("risk") <= F.col("constraint"))
        .groupBy("constraint")
        .agg(F.max(key).alias("b"))
        .select("constraint", "b.low", "b.high", "b.coverage", "b.risk", "b.expansion")
    )
    return constraints.join(best, "constraint", "left")


def two_way(trajectories: DataFrame, thresholds: DataFrame, at_k: int) -> DataFrame:
    """Answer or abstain at one depth: threshold, coverage, risk, false_abstention."""
    p, y = F.col(f"p{at_k}"), F.col(f"y{at_k}")
    counted = trajectories.groupBy(p.alias("p"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    said = F.col("p") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return (
        counted.crossJoin(F.broadcast(thresholds))
        .groupBy("threshold")
        .agg(
            n(said).alias("answered"),
            F.sum("n").alias("total"),
            n(said & (F.col("y") == 0)).alias("unsafe"),
            n(~said & (F.col("y") == 1)).alias("missed"),
            n(F.col("y") == 1).alias("could"),
        )
        .select(
            "threshold",
            ratio(F.col("answered"), F.col("total")).alias("coverage"),
            ratio(F.col("unsafe"), F.col("answered")).alias("risk"),
            ratio(F.col("missed"), F.col("could")).alias("false_abstention"),
        )
    )


def policy_view(actions: DataFrame, states: DataFrame) -> DataFrame:
    """question_id, action, k, and the state's columns at the chosen depth; an abstention has nulls, never zeros.

    actions: question_id, action; states: question_id, k, ..."""
    chosen = actions.withColumn(
        "k", F.when(F.col("action") == "answer_k5", 5).when(F.col("action") == "answer_k10", 10)
    )
    return chosen.join(states, ["question_id", "k"], "left")


def policy_summary(view: DataFrame, value: str) -> DataFrame:
    """questions, answered, defined, coverage, mean over defined, mean over all with abstentions as 0."""
    return view.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count("k").alias("answered"),
        F.count(value).alias("defined"),
        F.avg(value).alias("mean_defined"),
        (F.sum(F.coalesce(F.col(value), F.lit(0.0))) / F.count(F.lit(1))).alias("utility"),
    ).withColumn("coverage", ratio(F.col("answered"), F.col("questions")))
