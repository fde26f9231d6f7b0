"""The two-pass answering system: gate, escalation, fallback, evaluation of decisions and error buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grounding import is_refusal, word_set


def gate(p: Column, answer: float, expand: float) -> Column:
    """answer, request_more_evidence or abstain by one probability."""
    return F.when(p >= answer, "answer").when(p >= expand, "request_more_evidence").otherwise("abstain")


def escalated(rows: DataFrame, answer: float, expand: float) -> DataFrame:
    """rows (p_first, p_second) with decision, escalated and p: the middle band is retrieved again, twice as deep, and then
    either answers or abstains; p is the second pass's only where that answers."""
    first = gate(F.col("p_first"), answer, expand)
    again = first == "request_more_evidence"
    passed = again & (F.col("p_second") >= answer)
    return rows.withColumns(
        {
            "decision": F.when(passed, "answer").when(again, "abstain").otherwise(first),
            "escalated": again,
            "p": F.when(passed, F.col("p_second")).otherwise(F.col("p_first")),
        }
    )


def variant(p: Column, kind: str, answer: float, expand: float) -> Column:
    """The decision of an ablation: always (answers), binary (no middle band) or full."""
    if kind == "always":
        return F.lit("answer")
    if kind == "binary":
        return F.when(p >= answer, "answer").otherwise("abstain")
    return gate(p, answer, expand)


def settled_answer(decision: Column, generated: Column, fallback: Column) -> dict[str, Column]:
    """decision, answer and source after generation: a refusal, or fewer than four words, gives way to the extracted
    answer, and to abstention where there is none."""
    said = decision == "answer"
    poor = F.coalesce(is_refusal(generated), F.lit(True)) | (F.regexp_count(F.coalesce(generated, F.lit("")), F.lit(r"\S+")) < 4)
    usable = F.length(F.coalesce(fallback, F.lit(""))) > 0
    none = F.lit(None).cast("string")
    return {
        "decision": F.when(said & poor & ~usable, "abstain").otherwise(decision),
        "answer": F.when(said & ~poor, generated).when(said & usable, fallback).otherwise(none),
        "source": F.when(~said, "policy").when(~poor, "generated").when(usable, "extractive_fallback").otherwise("fallback_no_supported_sentence"),
    }


def cosine_support(claims: DataFrame, chunks: DataFrame, key: list[str], claim: str = "claim", threshold: float = 0.42) -> DataFrame:
    """key, claims, unsupported, unsupported_rate: claims whose best chunk has a cosine below the threshold; without claims
    the rate is 0, without chunks 1. The vectors are word sets: their cosine is shared words by the root of both sizes.

    claims: key, claim (null where a response has none); chunks: key, chunk."""
    a, b = word_set(F.col(claim)), word_set(F.col("chunk"))
    cosine = F.coalesce(F.size(F.array_intersect(a, b)) / F.sqrt(F.nullif(F.size(a) * F.size(b), F.lit(0))), F.lit(0.0))
    numbered = claims.withColumn("claim_id", F.xxhash64(*key, claim))
    best = numbered.join(chunks, key, "left").groupBy(*key, "claim_id", claim).agg(F.coalesce(F.max(cosine), F.lit(0.0)).alias("support"))
    known = F.col(claim).isNotNull()
    return best.groupBy(*key).agg(
        F.count_if(known).alias("claims"),
        F.count_if(known & (F.col("support") < threshold)).alias("unsupported"),
        F.coalesce(F.count_if(known & (F.col("support") < threshold)) / F.nullif(F.count_if(known), F.lit(0)), F.lit(0.0)).alias("unsupported_rate"),
    )


def system_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Decision accuracy, coverage, unsafe answers among the unanswerable, false abstentions among the answerable, and means
    over known values. rows: answerable, decision, rouge_l, unsupported_rate, retrieval_hit."""
    said, could = F.col("decision") == "answer", F.col("answerable")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((said == could).cast("double")).alias("decision_accuracy"),
        F.avg(said.cast("double")).alias("answer_coverage"),
        F.avg(F.when(~could, said.cast("double"))).alias("unsafe_answer_rate"),
        F.avg(F.when(could, (~said).cast("double"))).alias("false_abstention_rate"),
        F.avg(F.when(could, F.col("retrieval_hit").cast("double"))).alias("retrieval_hit_rate"),
        F.avg(F.when(could & said, F.col("rouge_l"))).alias("mean_rouge_l"),
        F.avg(F.when(said, F.col("unsupported_rate"))).alias("mean_unsupported_rate"),
    )


def error_bucket() -> Column:
    """What a person should look at first; the first match holds."""
    said, could = F.col("decision") == "answer", F.col("answerable")
    return (
        F.when(~could & said, "Unsafe answer")
        .when(could & ~said, "False abstention or request")
        .when(F.col("decision") == "request_more_evidence", "Request more evidence")
        .when(said & (F.col("unsupported_rate") > 0.5), "Unsupported generated answer")
        .when(could & said & (F.col("retrieval_hit") == 0), "Wrong retrieval likely")
        .when(could & said, "Good answer candidate")
        .otherwise("Other")
    )


def chunk_key(filename: Column, text: Column) -> Column:
    """What chunks are known by: their file and their first 500 characters."""
    return F.struct(filename.alias("filename"), F.substring(text, 1, 500).alias("start"))
