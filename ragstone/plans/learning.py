"""Queries on learned models; numbers depend on the optimizer, so there is no SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import graph as N
from ragstone.operators import learning as L
from ragstone.operators.metrics import auroc, average_precision, brier

from .fixtures import predictions, table
from .registry import query

NUMERIC = ["n_chars", "lines", "stops", "symbols"]
LANGS = ("de", "en", "es", "fr")


def frame(spark, sf_dir):
    """Labelled documents with four text features and a fold by source."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.length(text) - F.length(F.translate(text, "\n", ""))).alias("lines"),
        (F.length(text) - F.length(F.translate(text, ".!?", ""))).alias("stops"),
        F.when(F.col("doc_id") % 9 != 0, F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("symbols"),
    )
    rows = predictions(spark, sf_dir).drop("p", "p2").join(docs, "doc_id")
    # Every fit and fold reads these few columns again.
    return rows.join(N.group_folds(rows, "source", 3).select("source", "fold"), "source").cache()


def summary(spark, scored, name):
    return (
        auroc(scored, "y", "p").crossJoin(average_precision(scored, "y", "p")).crossJoin(brier(scored, "y", "p"))
        .select(F.lit(name).alias("model"), "auroc", "average_precision", "brier")
    )


@query()
def logistic_out_of_fold(spark, sf_dir):
    scored = L.out_of_fold(frame(spark, sf_dir), NUMERIC, "fold", 3, "logistic", category="lang", levels=LANGS, C=1.0)
    return summary(spark, scored, "logistic")


@query()
def forest_out_of_fold(spark, sf_dir):
    return summary(spark, L.out_of_fold(frame(spark, sf_dir), NUMERIC, "fold", 3, "forest"), "forest")


@query()
def candidate_search(spark, sf_dir):
    best, rows = L.search(frame(spark, sf_dir), NUMERIC, "fold", 3, [("logistic", {"C": 0.1}), ("logistic", {"C": 1.0})])
    return spark.createDataFrame([(i, r["family"], r["C"], r["ap"], r["auroc"], r["brier"], i == best) for i, r in enumerate(rows)],
                                 "candidate int, family string, c double, average_precision double, auroc double, brier double, chosen boolean")


@query()
def calibrated_models(spark, sf_dir):
    scored = L.out_of_fold(frame(spark, sf_dir), NUMERIC, "fold", 3, "logistic").select("doc_id", "y", "p")
    out = [summary(spark, L.calibrate(scored, m)(scored), m) for m in ("none", "sigmoid", "isotonic")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def feature_ablation(spark, sf_dir):
    rows = frame(spark, sf_dir)
    groups = {"all": NUMERIC, "length_only": ["n_chars", "lines"], "no_symbols": NUMERIC[:3]}
    out = [summary(spark, L.out_of_fold(rows, c, "fold", 3, "logistic"), k) for k, c in groups.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def permutation_importance(spark, sf_dir):
    rows = frame(spark, sf_dir)
    prepared = L.prepare(rows, NUMERIC)
    got = L.importance(rows, L.fit(rows, prepared, "logistic"), prepared, NUMERIC, "doc_id", repeats=2)
    return spark.createDataFrame([(i, r["feature"], r["drop"]) for i, r in enumerate(got, 1)], "rank int, feature string, drop double")
