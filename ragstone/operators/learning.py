"""Learning operators on Spark ML: preparation, families of classifiers, grouped search, calibration, importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import auroc, average_precision, brier
from .ordering import numbered


@dataclass(frozen=True)
class Prepared:
    """What preparation learned from the training rows: medians and the levels of the category."""

    medians: dict[str, float]
    category: str | None
    levels: tuple[str, ...] = ()
    columns: tuple[str, ...] = field(default=())

    def apply(self, df: DataFrame) -> DataFrame:
        """Numeric columns with nulls at the median and a flag for each, and the category as 0/1 columns; an unknown
        level is an error, raised where the row is read."""
        out = df
        for c, m in self.medians.items():
            known = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
            out = out.withColumns({f"{c}__f": F.when(known, F.col(c).cast("double")).otherwise(m), f"{c}__missing": (~known).cast("double")})
        if self.category:
            value = F.col(self.category).cast("string")
            checked = F.when(value.isin(*self.levels), value).otherwise(F.raise_error(F.concat(F.lit("unknown level "), F.coalesce(value, F.lit("null")))))
            out = out.withColumns({f"{self.category}__{v}": (checked == v).cast("double") for v in self.levels})
        return out


def prepare(df: DataFrame, numeric: Sequence[str], category: str | None = None, levels: Sequence[str] = ()) -> Prepared:
    """Medians over known values, exact, in one aggregation; a column without any is 0 throughout."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    got = df.agg(*[F.percentile(value(c), F.lit(0.5)).alias(c) for c in numeric]).first()
    medians = {c: float(got[c]) if got[c] is not None else 0.0 for c in numeric}
    columns = [f"{c}__{s}" for c in numeric for s in ("f", "missing")] + [f"{category}__{v}" for v in levels if category]
    return Prepared(medians, category, tuple(levels), tuple(columns))


def family(name: str, n_rows: int, seed: int = 42, **params):
    """A classifier of a family: `logistic` with the strength C of a summed loss, or `forest`."""
    if name == "logistic":
        return LogisticRegression(
            featuresCol="features", labelCol="y", regParam=1.0 / (params.get("C", 1.0) * max(1, n_rows)), standardization=False, maxIter=200
        )
    return RandomForestClassifier(
        featuresCol="features", labelCol="y", numTrees=params.get("trees", 500), maxDepth=params.get("depth", 8),
        minInstancesPerNode=params.get("leaf", 1), seed=seed,
    )


def fit(df: DataFrame, prepared: Prepared, name: str, seed: int = 42, **params) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(prepared.columns), outputCol="raw")]
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    rows = prepared.apply(df).withColumn("y", F.col("y").cast("double"))
    return Pipeline(stages=[*stages, family(name, df.count(), seed, **params)]).fit(rows)


def predict(model: PipelineModel, prepared: Prepared, df: DataFrame) -> DataFrame:
    """df with p, the probability of class 1."""
    clean = df.drop("p", "raw", "features")
    return model.transform(prepared.apply(clean)).withColumn("p", vector_to_array("probability")[1]).select(*clean.columns, "p")


def out_of_fold(df: DataFrame, numeric: Sequence[str], fold: str, n: int, name: str, category: str | None = None, levels: Sequence[str] = (), **params) -> DataFrame:
    """df with p from models that didn't see the row's fold; preparation is learned without it too."""
    parts = []
    for i in range(n):
        train, rest = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
        prepared = prepare(train, numeric, category, levels)
        parts.append(predict(fit(train, prepared, name, **params), prepared, rest))
    return reduce(DataFrame.unionByName, parts)


def search(df: DataFrame, numeric: Sequence[str], fold: str, n: int, candidates: Sequence[tuple[str, dict]]) -> tuple[int, list[dict]]:
    """(index of the best candidate, its and all others' figures): average precision, then AUROC, then the Brier score;
    ties go to the earliest."""
    rows = []
    for name, params in candidates:
        scored = out_of_fold(df, numeric, fold, n, name, **params).select("y", "p").cache()
        rows.append({
            "family": name, **params,
            "ap": average_precision(scored, "y", "p").first()[0], "auroc": auroc(scored, "y", "p").first()[0], "brier": brier(scored, "y", "p").first()[0],
        })
        scored.unpersist()
    best = max(range(len(rows)), key=lambda i: (round(rows[i]["ap"], 9), round(rows[i]["auroc"], 9), -round(rows[i]["brier"], 9), -i))
    return best, rows


def calibrate(scored: DataFrame, method: str) -> Callable[[DataFrame], DataFrame]:
    """A function that replaces p by a calibrated one: `none`, `sigmoid` (logistic on p) or `isotonic`."""
    if method == "none":
        return lambda df: df
    assemble = VectorAssembler(inputCols=["p"], outputCol="features")
    rows = assemble.transform(scored.select("p", F.col("y").cast("double").alias("y")))
    if method == "sigmoid":
        model = LogisticRegression(labelCol="y", regParam=0.0, maxIter=100).fit(rows)
        slope, shift = float(model.coefficients[0]), float(model.intercept)
        return lambda df: df.withColumn("p", 1 / (1 + F.exp(-(F.col("p") * slope + shift))))
    model = IsotonicRegression(labelCol="y").fit(rows)
    keep = lambda df: model.transform(assemble.transform(df)).withColumn("p", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
    return lambda df: keep(df).select(*df.columns)


def permuted(df: DataFrame, column: str, seed: str, key: str) -> DataFrame:
    """df with the column's values dealt anew: the i-th row by one hash of its key gets the value of the i-th by another."""
    digest = lambda name: F.sha2(F.concat_ws("|", F.lit(name), F.lit(seed), F.col(key).cast("string")), 256)
    rows = numbered(df.withColumn("__h", digest("to")), "__i", "__h", ties=[key]).drop("__h", column)
    values = numbered(df.select(column, key, digest("from").alias("__h")), "__i", "__h", ties=[key]).select(column, "__i")
    return rows.join(values, "__i").select(*df.columns)


def importance(df: DataFrame, model: PipelineModel, prepared: Prepared, columns: Sequence[str], key: str, repeats: int = 3) -> list[dict]:
    """feature, drop: the mean loss of AUROC over permutations of each column, largest first."""
    base = auroc(predict(model, prepared, df), "y", "p").first()[0]
    out = []
    for c in columns:
        drops = [base - auroc(predict(model, prepared, permuted(df, c, f"{c}|{r}", key)), "y", "p").first()[0] for r in range(repeats)]
        out.append({"feature": c, "drop": sum(drops) / len(drops)})
    return sorted(out, key=lambda r: (-r["drop"], r["feature"]))
