"""Feature rows put together: everything about one condition in one projection over its bounded context.

A condition's context has at most a few dozen chunks, so it is gathered once into arrays and all features are expressions
over them; no feature costs a join or a shuffle of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.vectors import dot, let, ratio

from .features import query_features

#: The 39 names in the order of a model's input.
CONDITION_FEATURES = (
    "chars", "terms", "unique_terms", "unique_share", "digit_terms", "digit_share", "identifier_terms", "identifier_share",
    "score_top1", "score_top2", "score_gap", "score_mean", "score_std", "score_min", "score_max", "score_range",
    "unique_coverage", "idf_coverage", "overlap_max", "overlap_mean", "overlap_std",
    "sim_max", "sim_mean", "sim_min", "sim_std", "sim_gap",
    "chunks", "tokens", "tokens_mean", "tokens_std", "documents", "dominant_share", "duplicate_share", "pair_mean", "pair_max",
    "shared", "jaccard", "strategy", "k",
)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(values: Column) -> Column:
    return ratio(total(values), F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return let(mean(values), lambda m: F.sqrt(mean(F.transform(values, lambda x: F.pow(x.cast("double") - m, 2)))))


def gathered(hits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and `context`, the hits' columns in order of rank."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    return hits.groupBy(*keys).agg(ordered.alias("context"))


def weighted_terms(asked: DataFrame, idf: DataFrame, key: str, oov: Column) -> DataFrame:
    """key, weights: the distinct terms of each question with their idf. asked: key, terms; idf: term, idf."""
    each = asked.select(key, F.explode(F.array_distinct("words")).alias("term")).join(idf, "term", "left")
    weighed = F.collect_list(F.struct("term", F.coalesce("idf", oov).alias("w")))
    return each.groupBy(key).agg(F.sort_array(weighed).alias("weights"))


def condition_features(asked: DataFrame, conditions: DataFrame, agreement: DataFrame, key: str) -> DataFrame:
    """key and the 39 features of each condition.

    asked: key, text, words (terms), weights (or null), vector; conditions: key, strategy, k, context (array of structs of
    score, doc_id, words (distinct), length, vector, in order of rank); agreement: key, k, first, second (lists of chunk
    ids). A question without terms has shares of 0; what needs two chunks is null with one."""
    c, n, weights = F.col("context"), F.size("context"), F.col("weights")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    nothing = F.array().cast("array<struct<term:string,w:double>>")
    # What several features need stands in columns of its own, so that it is computed once.
    steps = [
        {"weights": F.coalesce("weights", nothing)},
        {
            "known": F.transform(weights, lambda x: x["term"]),
            "seen": F.array_distinct(F.flatten(F.transform(c, lambda x: x["words"]))),
            "scores": F.col("context.score"), "lengths": F.col("context.length"), "docs": F.col("context.doc_id"),
            "similar": F.transform(c, lambda x: dot(F.col("vector"), x["vector"])),
            "pairs": F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: dot(x["vector"], y["vector"])))),
        },
        {
            "covered": F.array_intersect("known", "seen"),
            "overlaps": F.transform(c, lambda x: zero(ratio(F.size(F.array_intersect("known", x["words"])), F.size("known")))),
            "ranked": F.sort_array("similar", asc=False),
            "times": F.transform(F.array_distinct("docs"), lambda d: F.size(F.filter("docs", lambda x: x == d))),
        },
    ]
    joined = conditions.join(asked, key).join(agreement, [key, "k"])
    for step in steps:
        joined = joined.withColumns(step)
    scores, lengths, docs, known, covered, overlaps, similar, ranked, pairs, times = map(
        F.col, ("scores", "lengths", "docs", "known", "covered", "overlaps", "similar", "ranked", "pairs", "times")
    )
    second = F.when(n > 1, F.get(scores, F.lit(1)))
    weight = lambda terms: total(F.transform(F.filter(weights, lambda x: F.array_contains(terms, x["term"])), lambda x: x["w"]))
    both, either = F.size(F.array_intersect("first", "second")), F.size(F.array_union("first", "second"))
    named = {
        "score_top1": F.get(scores, F.lit(0)), "score_top2": second, "score_gap": F.get(scores, F.lit(0)) - second,
        "score_mean": mean(scores), "score_std": deviation(scores), "score_min": F.array_min(scores), "score_max": F.array_max(scores),
        "score_range": F.array_max(scores) - F.array_min(scores),
        "unique_coverage": zero(ratio(F.size(covered), F.size(known))), "idf_coverage": zero(ratio(weight(covered), total(F.transform(weights, lambda x: x["w"])))),
        "overlap_max": F.array_max(overlaps), "overlap_mean": mean(overlaps), "overlap_std": deviation(overlaps),
        "sim_max": F.array_max(similar), "sim_mean": mean(similar), "sim_min": F.array_min(similar), "sim_std": deviation(similar),
        "sim_gap": F.when(n > 1, F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))),
        "chunks": n, "tokens": total(lengths).cast("long"), "tokens_mean": mean(lengths), "tokens_std": deviation(lengths),
        "documents": F.size(F.array_distinct(docs)), "dominant_share": ratio(F.array_max(times), n),
        "duplicate_share": 1 - ratio(F.size(F.array_distinct(docs)), n),
        "pair_mean": F.when(n > 1, mean(pairs)), "pair_max": F.when(n > 1, F.array_max(pairs)),
        "shared": both, "jaccard": zero(ratio(both, either)),
    }
    wide = joined.select(key, "strategy", "k", *query_features(F.col("text"), F.col("words")), *[v.alias(k) for k, v in named.items()])
    return wide.select(key, *CONDITION_FEATURES)


def prototype_features(asked: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """key and 13 features of a hybrid ranking; a missing second score counts as 0, an empty context has zeros.

    asked: key, text, words (distinct); contexts: key, context (score, first_score, second_score, text, words)."""
    joined = asked.join(contexts, key, "left")
    c = F.coalesce("context", F.expr("array()").cast(dict(contexts.dtypes)["context"]))
    n = F.size(c)
    column = lambda name: F.transform(c, lambda x: x[name])
    at = lambda name, i: F.coalesce(F.get(column(name), F.lit(i)), F.lit(0.0))
    average = lambda values: F.coalesce(mean(values), F.lit(0.0))
    size = F.size("words")
    share = lambda words: F.when(size > 0, F.size(F.array_intersect("words", words)) / size).otherwise(0.0)
    overlaps = F.transform(c, lambda x: share(x["words"]))
    gap = at("score", 0) - at("score", 1)
    texts = F.array_join(column("text"), "\n")
    return joined.select(
        key,
        at("score", 0).alias("top_hybrid"), average(column("score")).alias("mean_hybrid"), gap.alias("score_gap"),
        (gap / (F.abs(at("score", 0)) + 1e-6)).alias("score_gap_ratio"),
        at("first_score", 0).alias("top_bm25"), average(column("first_score")).alias("mean_bm25"),
        at("second_score", 0).alias("top_dense"), average(column("second_score")).alias("mean_dense"),
        F.coalesce(F.get(overlaps, F.lit(0)), F.lit(0.0)).alias("top_lexical_overlap"), average(overlaps).alias("mean_lexical_overlap"),
        share(F.array_distinct(F.flatten(column("words")))).alias("lexical_overlap"),
        F.regexp_count("text", F.lit(r"\S+")).alias("question_len"), F.when(n > 0, F.length(texts)).otherwise(0).alias("retrieved_chars"),
    )
