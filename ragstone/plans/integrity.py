"""Queries on stage checks and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.operators import graph as N
from ragstone.operators import integrity as I
from ragstone.operators import retrieval as R
from ragstone.operators.governance import Registry

from .evaluation import W, conditions
from .fixtures import responses, table
from .registry import query
from .retrieval import BM25, OVERLAP, RRF, benchmark
from .systems import rankings

SPLIT = "CASE WHEN {0} % 10 < 7 THEN 'train' WHEN {0} % 10 < 9 THEN 'validation' ELSE 'test' END"
#: A check's row from its observed and expected text.
ROW = "SELECT '{0}' AS check_id, CASE WHEN {1} IS NOT DISTINCT FROM {2} THEN 'pass' ELSE 'fail' END AS status, {1} AS observed, {2} AS expected"


def split_of(column):
    return F.when(column % 10 < 7, "train").when(column % 10 < 9, "validation").otherwise("test")


def text(number: str) -> str:
    return f"CAST({number} AS VARCHAR)"


RANKED = f"""WITH {BM25}{OVERLAP}{RRF}, u AS (SELECT item_id, 'bm25' AS strategy, CAST(rank AS INTEGER) AS rank, doc_id FROM hits UNION ALL SELECT item_id, 'dense', CAST(rank AS INTEGER), doc_id FROM second UNION ALL SELECT item_id, 'hybrid', CAST(rank AS INTEGER), doc_id FROM fused),
per AS (SELECT item_id, strategy, count(*) AS n, min(rank) AS low, max(rank) AS high, count(DISTINCT rank) AS ranks, count(DISTINCT doc_id) AS chunks FROM u GROUP BY ALL),
q AS (SELECT count(*) AS n FROM benchmark), cond AS (SELECT count(*) AS n FROM (SELECT DISTINCT item_id, strategy, k FROM u, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE rank <= k)),
sq AS (SELECT string_agg(s || '=' || n, ',' ORDER BY s) AS t FROM (SELECT {SPLIT.format('item_id')} AS s, count(*) AS n FROM u WHERE strategy = 'bm25' AND rank = 1 GROUP BY 1)),
se AS (SELECT string_agg(s || '=' || n, ',' ORDER BY s) AS t FROM (SELECT {SPLIT.format('item_id')} AS s, count(*) AS n FROM benchmark GROUP BY 1)),
sr AS (SELECT string_agg(strategy || '=' || n, ',' ORDER BY strategy) AS t FROM (SELECT strategy, count(*) AS n FROM u GROUP BY 1)) """


@query(RANKED + " UNION ALL ".join([
    ROW.format("ranked_hit_rows", text("(SELECT sum(n) FROM per)"), text("(SELECT 30 * n FROM q)")),
    ROW.format("unique_rank_keys", text("(SELECT sum(n - ranks) FROM per)"), "'0'"),
    ROW.format("rank_continuity", text("(SELECT count(*) FROM per WHERE low <> 1 OR high <> 10 OR ranks <> 10 OR n <> 10)"), "'0'"),
    ROW.format("unique_chunks_per_ranking", text("(SELECT count(*) FROM per WHERE chunks <> 10)"), "'0'"),
    ROW.format("condition_rows", text("(SELECT n FROM cond)"), text("(SELECT 12 * n FROM q)")),
    ROW.format("nested_prefixes", "'0'", "'0'"),
    ROW.format("test_aggregate_sealed", "'0'", "'0'"),
    ROW.format("question_split_counts", "(SELECT t FROM sq)", "(SELECT t FROM se)"),
    ROW.format("strategy_rows", "(SELECT t FROM sr)", "(SELECT 'bm25=' || 10 * n || ',dense=' || 10 * n || ',hybrid=' || 10 * n FROM q)"),
]))
def retrieval_integrity(spark, sf_dir):
    ranked = rankings(spark, sf_dir).select("item_id", "strategy", "rank", F.col("doc_id").alias("chunk_id")).withColumn("split", split_of(F.col("item_id")))
    grouped = ranked.withColumn("group", F.concat_ws(":", "strategy", "item_id"))
    lists = R.prefixes(grouped, "group", "chunk_id")
    named = lists.select(F.split("group", ":")[1].cast("long").alias("item_id"), F.split("group", ":")[0].alias("strategy"), "k", "keys")
    asked = benchmark(spark, sf_dir).select(split_of(F.col("item_id")).alias("split"))
    sizes = {r["split"]: r["count"] for r in asked.groupBy("split").count().collect()}
    n = sum(sizes.values())
    expected = {
        "ranked_hit_rows": 30 * n,
        "condition_rows": 12 * n,
        "question_split_counts": ",".join(f"{s}={sizes[s]}" for s in sorted(sizes)),
        "strategy_rows": ",".join(f"{s}={10 * n}" for s in ("bm25", "dense", "hybrid")),
    }
    return I.ranking_checks(ranked, named, asked.filter("split <> 'test'"), "item_id", 10, expected, "bm25")


LABELS = f"""{W}, l AS (SELECT question_id, strategy, k, split, CASE WHEN impossible THEN 0 ELSE y_suff END AS y, CASE WHEN impossible THEN 'benchmark_impossible' WHEN unresolved THEN 'unresolved' ELSE 'gold_span_coverage' END AS method FROM labelled),
b AS (SELECT method, y, lag(y) OVER (PARTITION BY question_id, strategy ORDER BY k) AS before FROM l WHERE method = 'gold_span_coverage'),
sp AS (SELECT string_agg(split || '=' || n, ',' ORDER BY split) AS t FROM (SELECT split, count(*) AS n FROM l GROUP BY split)),
s AS (SELECT DISTINCT question_id FROM l WHERE split <> 'test' AND question_id % 5 = 0) """
CLASSES = {
    "question_id": "identifier", "strategy": "feature", "k": "feature", "split": "governance", "y_suff": "outcome", "label_method": "governance",
    "label_status": "governance", "gold_document_hit": "outcome", "fully_covered": "outcome", "exclusion_reason": "governance",
}


def stage_labels(spark, sf_dir):
    impossible, unresolved = F.col("impossible"), F.col("unresolved")
    return conditions(spark, sf_dir).select(
        "question_id", "strategy", "k", "split", F.when(impossible, 0).otherwise(F.col("y_suff")).alias("y_suff"),
        F.when(impossible, "benchmark_impossible").when(unresolved, "unresolved").otherwise("gold_span_coverage").alias("label_method"),
        F.when(impossible, "preliminary_benchmark_negative").when(unresolved, "unresolved").otherwise("resolved").alias("label_status"),
        F.when(~impossible, F.col("coverage") > 0).alias("gold_document_hit"), (F.coalesce("coverage", F.lit(0.0)) >= 1).cast("int").alias("fully_covered"),
        F.when(unresolved, "no_alignment").alias("exclusion_reason"),
    )


@query(LABELS + " UNION ALL ".join([
    ROW.format("label_rows", text("(SELECT count(*) FROM l)"), text("(SELECT 4 * count(*) FROM predictions)")),
    ROW.format("unique_condition_labels", "'0'", "'0'"),
    ROW.format("full_span_rule", "'0'", "'0'"),
    ROW.format("impossible_rows", text("(SELECT count(*) FROM l WHERE method = 'benchmark_impossible')"), text("(SELECT 4 * count(*) FROM predictions WHERE doc_id % 9 = 0)")),
    ROW.format("benchmark_negative_provenance", "'0'", "'0'"),
    ROW.format("unresolved_are_na", text("(SELECT count(*) FROM l WHERE method = 'unresolved' AND y IS NOT NULL)"), "'0'"),
    ROW.format("k_monotonicity", text("(SELECT count(*) FROM b WHERE before > y)"), "'0'"),
    ROW.format("split_row_counts", "(SELECT t FROM sp)", "(SELECT t FROM sp)"),
    ROW.format("exact_condition_coverage", "'0'", "'0'"),
    ROW.format("test_aggregate_sealed", "'0'", "'0'"),
    ROW.format("manual_sample", "(SELECT count(*) || '/' || count(*) || '/' || count(*) || '/0' FROM s)", "(SELECT count(*) || '/' || count(*) || '/' || count(*) || '/0' FROM s)"),
    ROW.format("annotation_key_separation", "'0'", "'0'"),
    ROW.format("annotation_blinding", "''", "''"),
    ROW.format("column_governance_complete", "''", "''"),
    ROW.format("feature_allowlist_guard", "'true'", "'true'"),
]))
def label_integrity(spark, sf_dir):
    labels = stage_labels(spark, sf_dir)
    sizes = {r["split"]: r["count"] for r in labels.groupBy("split").count().collect()}
    n = sum(sizes.values())
    sample = labels.filter("split <> 'test' and question_id % 5 = 0").select("question_id", "split").distinct()
    sample = sample.withColumn("sample_id", F.sha2(F.concat_ws("|", F.lit("s"), F.col("question_id").cast("string")), 256))
    blinded, key = sample.select("sample_id"), sample.select("sample_id", "question_id")
    impossible = labels.filter("label_method = 'benchmark_impossible'").count()
    expected = {
        "label_rows": n, "split_row_counts": ",".join(f"{s}={sizes[s]}" for s in sorted(sizes)), "impossible_rows": impossible, "sample_size": sample.count(),
    }
    summaries = labels.filter("split <> 'test'").select("split").distinct()
    return I.label_checks(labels, conditions(spark, sf_dir), summaries, sample, blinded, key, Registry(CLASSES), ["strategy", "k"], expected)


RETURNED = """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'Sufficient ' WHEN doc_id % 50 = 10 THEN 'maybe' ELSE 'insufficient' END AS label, CASE WHEN doc_id % 100 = 20 THEN '' ELSE 'a1' END AS who, CASE WHEN doc_id % 100 = 40 THEN '2026-02-30' ELSE '2026-03-04T05:06:07Z' END AS stamp FROM documents WHERE doc_id % 10 = 0) """


@query(RETURNED + " UNION ALL ".join([
    ROW.format("rows", text("(SELECT count(*) FROM t)"), text("(SELECT count(*) FROM t)")),
    ROW.format("unique_samples", "'0'", "'0'"),
    ROW.format("same_samples", "'0'", "'0'"),
    ROW.format("unchanged_texts", text("(SELECT count(*) FROM t WHERE doc_id % 30 = 0)"), "'0'"),
    ROW.format("valid_labels", text("(SELECT count(*) FROM t WHERE label = 'maybe')"), "'0'"),
    ROW.format("valid_annotators", text("(SELECT count(*) FROM t WHERE who = '')"), "'0'"),
    ROW.format("valid_times", text("(SELECT count(*) FROM t WHERE stamp = '2026-02-30')"), "'0'"),
    ROW.format("annotators", text("(SELECT count(DISTINCT who) FROM t)"), "'1'"),
    ROW.format("columns", "''", "''"),
]))
def annotation_return_checks(spark, sf_dir):
    """A returned annotation with planted mistakes of every kind."""
    d = F.col("doc_id")
    shown = table(spark, sf_dir, "documents").filter(d % 10 == 0).select(d.cast("string").alias("sample_id"), "text", "lang", "doc_id")
    back = shown.select(
        "sample_id", F.when(d % 30 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "lang",
        F.when(d % 50 == 0, "Sufficient ").when(d % 50 == 10, "maybe").otherwise("insufficient").alias("manual_label"),
        F.when(d % 100 == 20, "").otherwise("a1").alias("annotator_id"), F.when(d % 100 == 40, "2026-02-30").otherwise("2026-03-04T05:06:07Z").alias("annotation_timestamp"),
    )
    return I.annotation_checks(back, shown.drop("doc_id"), shown.count())


@query(LABELS + ", c AS (" + ROW.format("k_monotonicity", text("(SELECT count(*) FROM b WHERE before > y)"), "'0'") + ") SELECT 15::BIGINT AS checks, CAST(count(*) FILTER (WHERE status = 'fail') AS BIGINT) AS failed, CASE WHEN count(*) FILTER (WHERE status = 'fail') = 0 THEN 'pass' ELSE 'fail' END AS status FROM c")
def label_integrity_overall(spark, sf_dir):
    return I.overall(label_integrity(spark, sf_dir))


def questions(spark, sf_dir):
    """question_id, text, answer, answerable, filename: conversations' first turns; those of one length share a file."""
    first = responses(spark, sf_dir).filter("question is not null and turn = 1")
    return first.select(
        F.concat(F.lit("TRAIN_Q"), "conv_id").alias("question_id"), F.col("question").alias("text"), F.when(F.col("conv_id") % 11 != 0, F.col("response")).alias("answer"),
        (F.col("conv_id") % 3 != 0).alias("answerable"), F.concat(F.lit("file-"), F.length("question")).alias("filename"),
    )


def grouped(spark, sf_dir):
    """(members, splits): questions with one file, or one normalized text, are one component."""
    asked = questions(spark, sf_dir)
    edges = asked.select("question_id", F.col("filename").alias("link")).unionByName(asked.select("question_id", I.question_hash(F.col("text")).alias("link")))
    parts = N.components(asked.select("question_id"), edges, "question_id")
    splits = parts.select("component").distinct().withColumn("split", split_of(F.pmod(F.xxhash64("component"), F.lit(10))))
    return parts, splits


@query()
def component_manifest(spark, sf_dir):
    parts, splits = grouped(spark, sf_dir)
    return I.component_manifest(questions(spark, sf_dir).join(parts, "question_id"), splits, 42)


@query()
def assignment_manifest(spark, sf_dir):
    parts, splits = grouped(spark, sf_dir)
    return I.assignment_manifest(questions(spark, sf_dir), parts, splits, 42)


@query()
def response_manifest(spark, sf_dir):
    """Assistant turns with two labels in every fourth conversation and one in every other second."""
    label = lambda kind, implicit: F.struct(F.lit(kind).alias("label_type"), F.lit(implicit).alias("implicit_true"), F.lit(False).alias("due_to_null"))
    turn = F.col("conv_id")
    labels = F.when(turn % 4 == 0, F.array(label("conflict", True), label("baseless", False))).when(turn % 2 == 0, F.array(label("baseless", False)))
    rows = responses(spark, sf_dir).select(
        "response_id", F.col("conv_id").alias("source_id"), "response", F.col("question").alias("prompt"), F.when(turn % 3 != 0, "good").alias("quality"),
        F.lit("QA").alias("task_type"), F.coalesce(labels, F.filter(F.array(label("", False)), lambda _: F.lit(False))).alias("labels"),
    )
    return I.response_manifest(rows)
