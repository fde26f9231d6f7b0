"""Queries on retrieval: benchmark items ask, documents answer; embeddings ask embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.functions.text import tokens
from ragstone.operators import retrieval as R
from ragstone.operators.alignment import exact_spans

from .fixtures import table
from .registry import query

TOKENS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+(?:[./:-]+[\p{{L}}\p{{N}}_]+)*')"
DOC_TOKENS = "dt AS (SELECT doc_id, {} AS toks FROM documents)".format(TOKENS.format("text"))
BM25 = (
    DOC_TOKENS
    + """, dl AS (SELECT doc_id, toks, CAST(len(toks) AS DOUBLE) AS length FROM dt),
corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS average FROM dl),
terms AS (SELECT doc_id, length, unnest(toks) AS term FROM dl),
tf AS (SELECT doc_id, length, term, CAST(count(*) AS DOUBLE) AS tf FROM terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, corpus),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest("""
    + TOKENS.format("text")
    + """) AS term FROM benchmark) GROUP BY ALL),
bm25 AS (
  SELECT q.item_id, t.doc_id,
         round(sum(q.qtf * (i.idf * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.length / c.average)))), 6) AS score
  FROM qt q JOIN tf t ON t.term = q.term JOIN idf i ON i.term = q.term, corpus c GROUP BY q.item_id, t.doc_id),
padded AS (
  SELECT * FROM bm25 UNION ALL
  SELECT b.item_id, f.doc_id, 0.0::DOUBLE FROM benchmark b, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) f
  WHERE NOT EXISTS (SELECT 1 FROM bm25 x WHERE x.item_id = b.item_id AND x.doc_id = f.doc_id)),
hits AS (
  SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM padded) WHERE rank <= 10)"""
)
OVERLAP = (
    """, dset AS (SELECT doc_id, list_distinct(toks) AS s FROM dt), qset AS (SELECT item_id, list_distinct("""
    + TOKENS.format("text")
    + """) AS s FROM benchmark),
shared AS (SELECT q.item_id, d.doc_id, count(*) AS n FROM (SELECT item_id, unnest(s) AS term FROM qset) q
           JOIN (SELECT doc_id, unnest(s) AS term FROM dset) d USING (term) GROUP BY ALL),
overlap AS (
  SELECT item_id, doc_id, round(CAST(n AS DOUBLE) / (len(q.s) + len(d.s) - n), 6) AS score
  FROM shared JOIN qset q USING (item_id) JOIN dset d USING (doc_id)),
second AS (
  SELECT item_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM overlap) WHERE rank <= 10)"""
)
RRF = """, rrf AS (
  SELECT coalesce(h.item_id, s.item_id) AS item_id, coalesce(h.doc_id, s.doc_id) AS doc_id, h.rank AS first_rank, s.rank AS second_rank,
         round(coalesce(1.0::DOUBLE / (60 + h.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score
  FROM hits h FULL OUTER JOIN second s ON h.item_id = s.item_id AND h.doc_id = s.doc_id),
fused AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM rrf) WHERE rank <= 10)"""
GOLD = """, gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
CONDITIONS = """, ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
conditions AS (SELECT item_id, k, list(doc_id ORDER BY rank) AS keys FROM hits, ks WHERE rank <= k GROUP BY ALL)"""
METRICS = """, place AS (
  SELECT c.item_id, c.k, min(list_position(c.keys, g.doc_id)) FILTER (WHERE list_contains(c.keys, g.doc_id)) AS place
  FROM conditions c JOIN gold g ON g.item_id = c.item_id GROUP BY ALL),
metrics AS (SELECT item_id, k, CASE WHEN place IS NULL THEN 0 ELSE 1 END AS recall, coalesce(1.0::DOUBLE / place, 0) AS rr FROM place)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def index(spark, sf_dir):
    """The BM25 index of the documents, made by the first query that needs it."""
    return R.bm25_index(documents(spark, sf_dir), "doc_id")


def bm25_hits(spark, sf_dir, k: int = 10):
    items, built = benchmark(spark, sf_dir), index(spark, sf_dir)
    scores = R.bm25_candidates(built, items, "item_id", k)
    return R.padded_top_k(scores, built.documents, items, "item_id", "doc_id", k)


def overlap_scores(spark, sf_dir):
    """Jaccard similarity of token sets, for pairs that share a token."""
    docs = index(spark, sf_dir).documents.select("doc_id", F.col("terms").alias("d"))
    items = benchmark(spark, sf_dir).select("item_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    spread = lambda df, key, name: df.select(key, F.size(name).alias(f"n_{name}"), F.explode(name).alias("term"))
    both = spread(items, "item_id", "q").join(spread(docs, "doc_id", "d"), "term")
    shared = both.groupBy("item_id", "doc_id", "n_q", "n_d").agg(F.count(F.lit(1)).alias("both"))
    return shared.select("item_id", "doc_id", (F.col("both") / (F.col("n_q") + F.col("n_d") - F.col("both"))).alias("score"))


def gold_pairs(spark, sf_dir):
    return exact_spans(documents(spark, sf_dir), benchmark(spark, sf_dir)).select("item_id", "doc_id")


@query(f"WITH {DOC_TOKENS}, t AS (SELECT doc_id, unnest(toks) AS term FROM dt) "
       "SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM t GROUP BY term")  # fmt: skip
def tokenize_term_freq(spark, sf_dir):
    tf = R.term_frequencies(R.tokenized(documents(spark, sf_dir), "doc_id"), "doc_id")
    return tf.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"WITH {DOC_TOKENS}" + """, terms AS (SELECT unnest(list_distinct(toks)) AS term FROM dt),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, n), mean AS (SELECT 0.25::DOUBLE * avg(raw) AS least FROM raw)
SELECT term, df, round(CASE WHEN raw < 0 THEN least ELSE raw END, 6) AS idf FROM raw, mean""")  # fmt: skip
def bm25_idf_table(spark, sf_dir):
    return index(spark, sf_dir).vocabulary.withColumn("idf", F.round("idf", 6))


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM hits")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS asked FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(asked AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10""")
def dense_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return R.exact_search(vectors.filter("vec_id % 25 = 0"), vectors, 10)


@query(f"WITH {BM25}{OVERLAP}{RRF} SELECT item_id, doc_id, first_rank, CAST(second_rank AS INTEGER) AS second_rank, score, "
       "CAST(rank AS INTEGER) AS rank FROM fused")  # fmt: skip
def rrf_fusion_topk(spark, sf_dir):
    second = R.ranked(overlap_scores(spark, sf_dir), "item_id", "doc_id", 10)
    return R.fused(bm25_hits(spark, sf_dir), second, "item_id", "doc_id", 10)


@query(f"""WITH {BM25}{OVERLAP}, m AS (
  SELECT coalesce(h.item_id, s.item_id) AS item_id, coalesce(h.doc_id, s.doc_id) AS doc_id, coalesce(h.score, 0) AS a, coalesce(s.score, 0) AS b
  FROM hits h FULL OUTER JOIN second s ON h.item_id = s.item_id AND h.doc_id = s.doc_id),
n AS (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM m WINDOW w AS (PARTITION BY item_id)),
v AS (SELECT item_id, doc_id, round(0.6::DOUBLE * CASE WHEN ha > la THEN (a - la) / (ha - la) ELSE 0 END
      + 0.4::DOUBLE * CASE WHEN hb > lb THEN (b - lb) / (hb - lb) ELSE 0 END, 6) AS score FROM n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM v)
SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def linear_hybrid_topk(spark, sf_dir):
    second = R.ranked(overlap_scores(spark, sf_dir), "item_id", "doc_id", 10)
    return R.blended(bm25_hits(spark, sf_dir), second, "item_id", "doc_id", 10).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {BM25}{CONDITIONS} SELECT item_id, CAST(k AS INTEGER) AS k, array_to_string(keys, ',') AS ordered_ids FROM conditions")
def condition_prefix_lists(spark, sf_dir):
    return R.prefixes(bm25_hits(spark, sf_dir), "item_id", "doc_id").select(
        "item_id", "k", F.array_join("keys", ",").alias("ordered_ids")
    )


@query(f"""WITH {BM25}{GOLD}{CONDITIONS}{METRICS}
SELECT CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS questions, round(avg(recall), 6) AS mean_recall,
       round((SELECT avg(rr) FROM metrics WHERE k = 10), 6) AS mrr_at_10 FROM metrics GROUP BY k""")
def bm25_recall_mrr(spark, sf_dir):
    conditions = R.prefixes(bm25_hits(spark, sf_dir), "item_id", "doc_id")
    summary = R.retrieval_summary(R.ranking_metrics(conditions, gold_pairs(spark, sf_dir), "item_id", "doc_id"))
    return summary.select("k", "questions", F.round("mean_recall", 6).alias("mean_recall"), F.round("mrr_at_10", 6).alias("mrr_at_10"))


@query(f"""WITH {BM25}{OVERLAP},
u AS (SELECT item_id, 'bm25' AS strategy, rank, doc_id, rank AS bm25_rank, score AS bm25_score, NULL::INTEGER AS overlap_rank, NULL::DOUBLE AS overlap_score FROM hits
      UNION ALL SELECT item_id, 'overlap', CAST(rank AS INTEGER), doc_id, NULL, NULL, CAST(rank AS INTEGER), score FROM second)
SELECT * FROM u""")
def ranked_rows_by_strategy(spark, sf_dir):
    first = bm25_hits(spark, sf_dir).select(
        "item_id", F.lit("bm25").alias("strategy"), "rank", "doc_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")
    )
    second = R.ranked(overlap_scores(spark, sf_dir), "item_id", "doc_id", 10).select(
        "item_id", F.lit("overlap").alias("strategy"), "rank", "doc_id", F.col("rank").alias("overlap_rank"), F.col("score").alias("overlap_score")
    )
    return first.unionByName(second, allowMissingColumns=True)


@query(f"""WITH {BM25}, per AS (SELECT item_id, count(*) AS n, min(rank) AS low, max(rank) AS high, count(DISTINCT doc_id) AS d FROM hits GROUP BY item_id)
SELECT 'rank_continuity' AS check_id, CAST(sum(CASE WHEN low <> 1 OR high <> n THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM per
UNION ALL SELECT 'unique_documents', CAST(sum(CASE WHEN d <> n THEN 1 ELSE 0 END) AS BIGINT) FROM per
UNION ALL SELECT 'depth', CAST(sum(CASE WHEN n <> 10 THEN 1 ELSE 0 END) AS BIGINT) FROM per
UNION ALL SELECT 'all_questions', CAST((SELECT count(*) FROM benchmark) - count(*) AS BIGINT) FROM per""")
def retrieval_checks(spark, sf_dir):
    per = (
        bm25_hits(spark, sf_dir)
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("doc_id").alias("d"))
    )
    asked = benchmark(spark, sf_dir).agg(F.count(F.lit(1)).alias("asked"))
    counted = per.agg(
        F.count_if((F.col("low") != 1) | (F.col("high") != F.col("n"))).alias("rank_continuity"),
        F.count_if(F.col("d") != F.col("n")).alias("unique_documents"),
        F.count_if(F.col("n") != 10).alias("depth"),
        F.count(F.lit(1)).alias("answered"),
    ).crossJoin(asked)
    return counted.withColumn("all_questions", F.col("asked") - F.col("answered")).unpivot(
        [], ["rank_continuity", "unique_documents", "depth", "all_questions"], "check_id", "violations"
    )


@query("""WITH t AS (SELECT text, regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w, doc_id FROM documents)
SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_words, round(CAST(len(list_distinct(w)) AS DOUBLE) / len(w), 6) AS ratio FROM t WHERE text <> ''""")
def lexical_variety(spark, sf_dir):
    from ragstone.functions.text import collapsed

    words = documents(spark, sf_dir).filter("text <> ''").select("doc_id", F.split(collapsed(F.col("text")), " ").alias("w"))
    distinct = F.size(F.array_distinct("w"))
    return words.select("doc_id", distinct.cast("long").alias("distinct_words"), F.round(distinct / F.size("w"), 6).alias("ratio"))
