"""What the queries read: the supplied tables in the roles of corpus, questions, predictions and responses.

Every fixture has a Spark form and a SQL form (a common table expression) that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two probabilities, a split, a stratum, a cluster and a strategy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "validation").otherwise("test")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            "lang",
            "source",
            F.col("quality").alias("y"),
            F.col("toxic").alias("y2"),
            ((F.col("n_chars") % 101) / F.lit(100.0)).alias("p"),
            ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p2"),
            split.alias("split"),
            (F.col("doc_id") % 3).alias("strategy"),
            F.col("n_chars").alias("n_chars"),
        )
    )


PREDICTIONS = """predictions AS (
  SELECT l.doc_id, d.lang, d.source, l.quality AS y, l.toxic AS y2,
         CAST(d.n_chars % 101 AS DOUBLE) / 100.0::DOUBLE AS p, CAST(l.doc_id * 37 % 101 AS DOUBLE) / 100.0::DOUBLE AS p2,
         CASE WHEN l.doc_id % 10 < 7 THEN 'train' WHEN l.doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split,
         l.doc_id % 3 AS strategy, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question: probabilities and labels at the shallow and the deep context."""
    return predictions(spark, sf_dir).select(
        F.col("doc_id").alias("question_id"), F.col("p").alias("p5"), F.greatest("p", "p2").alias("p10"),
        F.col("y").alias("y5"), F.greatest("y", "y2").alias("y10"), "source", "lang",
    )


TRAJECTORIES = """trajectories AS (
  SELECT doc_id AS question_id, p AS p5, greatest(p, p2) AS p10, y AS y5, greatest(y, y2) AS y10, source, lang FROM predictions
)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as responses, with the user turn before as the question."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return (
        turns.filter("role = 'assistant'")
        .join(asked, ["conv_id", "turn"], "left")
        .select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), "conv_id", "turn", "question", F.col("text").alias("response"))
    )


RESPONSES = """responses AS (
  SELECT a.conv_id || '-' || a.turn AS response_id, a.conv_id, a.turn, u.text AS question, a.text AS response
  FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant'
)"""
