"""Feature tables of retrieved contexts, one row per condition (question and depth)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.text import identifier_like
from ragstone.functions.vectors import dot, ratio


def score_features(hits: DataFrame, key: list[str]) -> DataFrame:
    """top1, top2, gap, mean, std (population), min, max, range of a ranking's scores; top2 and gap are null with one."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return hits.groupBy(*key).agg(
        at(1).alias("score_top1"),
        at(2).alias("score_top2"),
        (at(1) - at(2)).alias("score_gap"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        (F.max("score") - F.min("score")).alias("score_range"),
    )


def lexical_features(asked: DataFrame, context: DataFrame, idf: DataFrame, key: str, oov: Column) -> DataFrame:
    """unique_coverage, idf_coverage, overlap max, mean and std per question and depth.

    asked: key, terms (distinct); context: key, k, rank, terms (distinct, per chunk); idf: term, idf; unknown terms weigh
    `oov`. A question without terms has zeros."""
    query = asked.select(key, F.size("terms").alias("n"), F.explode_outer("terms").alias("term")).join(idf, "term", "left")
    weighted = query.withColumn("w", F.when(F.col("term").isNotNull(), F.coalesce("idf", oov)).otherwise(0.0))
    seen = context.select(key, "k", F.explode("terms").alias("term")).distinct().withColumn("seen", F.lit(1))
    depths = context.select(key, "k").distinct()
    covered = (
        weighted.join(depths, key)
        .join(seen, [key, "k", "term"], "left")
        .groupBy(key, "k")
        .agg(
            F.coalesce(ratio(F.count("seen"), F.max("n")), F.lit(0.0)).alias("unique_coverage"),
            F.coalesce(ratio(F.sum(F.when(F.col("seen") == 1, F.col("w"))), F.sum("w")), F.lit(0.0)).alias("idf_coverage"),
        )
    )
    share = F.coalesce(ratio(F.size(F.array_intersect("a", "terms")), F.size("a")), F.lit(0.0))
    per_chunk = context.join(asked.select(key, F.col("terms").alias("a")), key).withColumn("share", share)
    overlap = per_chunk.groupBy(key, "k").agg(
        F.max("share").alias("overlap_max"), F.avg("share").alias("overlap_mean"), F.stddev_pop("share").alias("overlap_std")
    )
    return covered.join(overlap, [key, "k"])


def similarity_features(pairs: DataFrame, key: list[str]) -> DataFrame:
    """max, mean, min, std of similarities and the gap between the two best values (by value, not by rank)."""
    best = F.slice(F.sort_array(F.collect_list("similarity"), asc=False), 1, 2)
    return (
        pairs.groupBy(*key)
        .agg(
            F.max("similarity").alias("sim_max"),
            F.avg("similarity").alias("sim_mean"),
            F.min("similarity").alias("sim_min"),
            F.stddev_pop("similarity").alias("sim_std"),
            best.alias("best"),
        )
        .withColumn("sim_gap", F.when(F.size("best") > 1, F.get("best", F.lit(0)) - F.get("best", F.lit(1))))
        .drop("best")
    )


def composition(context: DataFrame, key: list[str]) -> DataFrame:
    """tokens, documents, dominant share, duplicate share of a context's chunks. context: key, chunk_id, doc_id, length."""
    per_doc = context.groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.countDistinct("text_hash").alias("u"))
    return per_doc.groupBy(*key).agg(
        F.sum("length").alias("tokens"),
        F.count(F.lit(1)).alias("documents"),
        (F.max("n") / F.sum("n")).alias("dominant_share"),
        (1 - F.sum("u") / F.sum("n")).alias("duplicate_share"),
    )


def pairwise_similarity(context: DataFrame, key: list[str], vector: str) -> DataFrame:
    """mean and max dot product over the pairs of a context (bounded by its depth); null with one chunk."""
    side = lambda x: context.select(*key, F.col("rank").alias(f"rank_{x}"), F.col(vector).alias(f"v_{x}"))
    pairs = side("a").join(side("b"), key).filter("rank_a < rank_b").withColumn("s", dot(F.col("v_a"), F.col("v_b")))
    found = pairs.groupBy(*key).agg(F.avg("s").alias("pair_mean"), F.max("s").alias("pair_max"))
    return context.select(*key).distinct().join(found, key, "left")


def agreement(first: Column, second: Column) -> list[Column]:
    """Shared hits of two rankings and their Jaccard index."""
    both, either = F.size(F.array_intersect(first, second)), F.size(F.array_union(first, second))
    return [both.alias("shared"), F.coalesce(ratio(both, either), F.lit(0.0)).alias("jaccard")]


def query_features(text: Column, terms: Column) -> list[Column]:
    """Length, terms, distinct terms, terms of digits alone and terms like identifiers, with their shares (0 without terms)."""
    n = F.size(terms)
    like = F.size(F.filter(terms, identifier_like))
    digits = F.size(F.filter(terms, lambda t: t.rlike(r"^\p{Nd}+$")))
    unique = F.size(F.array_distinct(terms))
    share = lambda c: F.coalesce(ratio(c, n), F.lit(0.0))
    return [
        F.length(text).alias("chars"),
        n.alias("terms"),
        unique.alias("unique_terms"),
        share(unique).alias("unique_share"),
        digits.alias("digit_terms"),
        share(digits).alias("digit_share"),
        like.alias("identifier_terms"),
        share(like).alias("identifier_share"),
    ]


def zscore(df: DataFrame, group: str, value: str, fitted_on: Column) -> DataFrame:
    """value_z: standardized by the group's mean and population deviation over the fitted rows; 0 where the deviation is
    0, null where the value is null. Groups are few, so the fit is joined by broadcast when Spark sees its size."""
    fit = df.filter(fitted_on).groupBy(group).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    mean, std = F.col("__mean"), F.col("__std")
    unknown = F.col(value).isNull() | mean.isNull()
    z = F.when(unknown, F.lit(None).cast("double")).when(std == 0, 0.0).otherwise((F.col(value) - mean) / std)
    return df.join(fit, group, "left").withColumn(f"{value}_z", z).drop("__mean", "__std")


def hallucination_features(context: Column, response: Column) -> list[Column]:
    """Word overlap, lengths, sentence and digit counts of a response against its context."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+"), F.lit(0)))
    a, b = words(context), words(response)
    return [
        F.coalesce(ratio(F.size(F.array_intersect(a, b)), F.size(b)), F.lit(0.0)).alias("overlap"),
        F.length(context).alias("context_chars"),
        F.length(response).alias("response_chars"),
        F.coalesce(ratio(F.length(response), F.length(context)), F.lit(0.0)).alias("length_ratio"),
        F.regexp_count(response, F.lit(r"[.!?]")).alias("sentence_marks"),
        F.regexp_count(response, F.lit(r"[0-9]")).alias("digits"),
    ]


def dominant(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    order = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    counted = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
