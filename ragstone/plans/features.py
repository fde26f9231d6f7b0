"""Queries on feature tables: benchmark items against their BM25 contexts, embeddings against their neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.functions.text import tokens
from ragstone.operators import features as X
from ragstone.operators import retrieval as R

from .fixtures import PREDICTIONS, RESPONSES, predictions, responses, table
from .metrics import rounded
from .registry import query
from .retrieval import BM25, CONDITIONS, OVERLAP, TOKENS, benchmark, bm25_hits, index, overlap_scores

KS = "ks AS (SELECT unnest([1, 3, 5, 10]) AS k)"


def at_depths(hits):
    ks = hits.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in R.DEPTHS])).alias("k"))
    return hits.crossJoin(F.broadcast(ks)).filter("rank <= k")


@query(f"""WITH {BM25}, {KS} SELECT item_id, CAST(k AS INTEGER) AS k, max(CASE WHEN rank = 1 THEN score END) AS score_top1, max(CASE WHEN rank = 2 THEN score END) AS score_top2,
round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS score_gap, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 5) AS score_std, min(score) AS score_min, max(score) AS score_max, round(max(score) - min(score), 6) AS score_range
FROM hits, ks WHERE rank <= k GROUP BY item_id, k""")
def retrieval_score_features(spark, sf_dir):
    rows = rounded(X.score_features(at_depths(bm25_hits(spark, sf_dir)), ["item_id", "k"]), "score_std")
    return rows.withColumn("score_std", F.round("score_std", 5))


LEX = f"""WITH {BM25}, {KS}, qs AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS s FROM benchmark),
ctx AS (SELECT h.item_id, k, h.rank, list_distinct(d.toks) AS s FROM hits h JOIN dt d ON d.doc_id = h.doc_id, ks WHERE h.rank <= k),
seen AS (SELECT DISTINCT item_id, k, unnest(s) AS term FROM ctx), qterm AS (SELECT item_id, len(s) AS n, unnest(s) AS term FROM qs),
wt AS (SELECT q.*, coalesce(i.idf, ln((c.n + 0.5::DOUBLE) / 0.5::DOUBLE)) AS w FROM qterm q LEFT JOIN idf i ON i.term = q.term, corpus c),
cov AS (SELECT w.item_id, k.k, count(s.term)::DOUBLE / max(w.n) AS unique_coverage, coalesce(sum(CASE WHEN s.term IS NOT NULL THEN w END), 0) / sum(w) AS idf_coverage FROM wt w CROSS JOIN ks k LEFT JOIN seen s ON s.item_id = w.item_id AND s.k = k.k AND s.term = w.term GROUP BY w.item_id, k.k),
ov AS (SELECT c.item_id, c.k, len(list_intersect(q.s, c.s))::DOUBLE / len(q.s) AS share FROM ctx c JOIN qs q ON q.item_id = c.item_id)
SELECT cov.item_id, CAST(cov.k AS INTEGER) AS k, round(unique_coverage, 6) AS unique_coverage, round(idf_coverage, 6) AS idf_coverage, round(max(share), 6) AS overlap_max, round(avg(share), 6) AS overlap_mean, round(stddev_pop(share), 5) AS overlap_std
FROM cov JOIN ov ON ov.item_id = cov.item_id AND ov.k = cov.k GROUP BY ALL"""


@query(LEX)
def lexical_coverage_features(spark, sf_dir):
    built = index(spark, sf_dir)
    asked = benchmark(spark, sf_dir).select("item_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    context = at_depths(bm25_hits(spark, sf_dir)).join(built.documents.select("doc_id", "terms"), "doc_id").select("item_id", "k", "rank", "terms")
    n = built.corpus.first()["n"]
    rows = X.lexical_features(asked, context, built.vocabulary.select("term", "idf"), "item_id", R.oov_idf(F.lit(n)))
    return rounded(rows, "overlap_std").withColumn("overlap_std", F.round("overlap_std", 5))


NEAR = """WITH q AS (SELECT vec_id AS query_id, embedding AS asked FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT query_id, vec_id, label, embedding, round(list_dot_product(CAST(asked AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 5)"""


def neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    hits = R.exact_search(vectors.filter("vec_id % 25 = 0"), vectors, 5)
    return hits.join(vectors.select("vec_id", "label", "embedding"), "vec_id")


@query(NEAR + """, o AS (SELECT query_id, list(score ORDER BY score DESC) AS l FROM t GROUP BY query_id)
SELECT t.query_id, max(score) AS sim_max, round(avg(score), 6) AS sim_mean, min(score) AS sim_min, round(stddev_pop(score), 5) AS sim_std, round(any_value(o.l[1] - o.l[2]), 6) AS sim_gap FROM t JOIN o ON o.query_id = t.query_id GROUP BY t.query_id""")
def semantic_features(spark, sf_dir):
    pairs = neighbours(spark, sf_dir).withColumnRenamed("score", "similarity")
    rows = X.similarity_features(pairs, ["query_id"])
    return rounded(rows, "sim_std").withColumn("sim_std", F.round("sim_std", 5))


@query(NEAR + """, p AS (SELECT a.query_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank)
SELECT query_id, round(avg(s), 6) AS pair_mean, round(max(s), 6) AS pair_max FROM p GROUP BY query_id""")
def context_pairwise_similarity(spark, sf_dir):
    return rounded(X.pairwise_similarity(neighbours(spark, sf_dir), ["query_id"], "embedding"))


@query(f"""WITH {BM25}, {KS}, c AS (SELECT h.item_id, k, d.source, len(t.toks) AS length, d.text FROM hits h JOIN documents d ON d.doc_id = h.doc_id JOIN dt t ON t.doc_id = h.doc_id, ks WHERE h.rank <= k),
p AS (SELECT item_id, k, source, count(*) AS n, sum(length) AS length, count(DISTINCT text) AS u FROM c GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS k, CAST(sum(length) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS documents, round(max(n)::DOUBLE / sum(n), 6) AS dominant_share, round(1 - sum(u)::DOUBLE / sum(n), 6) AS duplicate_share FROM p GROUP BY item_id, k""")
def context_composition_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("origin"), F.xxhash64("text").alias("text_hash"))
    docs = docs.join(index(spark, sf_dir).documents.select("doc_id", "length"), "doc_id")
    context = at_depths(bm25_hits(spark, sf_dir)).join(docs, "doc_id").select("item_id", "k", F.col("origin").alias("doc_id"), "length", "text_hash")
    return rounded(X.composition(context, ["item_id", "k"]))


@query(f"""WITH {BM25}{OVERLAP}{CONDITIONS}, sc AS (SELECT item_id, k, list(doc_id ORDER BY rank) AS keys FROM second, ks WHERE rank <= k GROUP BY ALL)
SELECT c.item_id, CAST(c.k AS INTEGER) AS k, CAST(len(list_intersect(c.keys, s.keys)) AS INTEGER) AS shared, round(len(list_intersect(c.keys, s.keys))::DOUBLE / len(list_distinct(list_concat(c.keys, s.keys))), 6) AS jaccard FROM conditions c JOIN sc s ON s.item_id = c.item_id AND s.k = c.k""")
def retriever_agreement(spark, sf_dir):
    first = R.prefixes(bm25_hits(spark, sf_dir), "item_id", "doc_id")
    second = R.prefixes(R.ranked(overlap_scores(spark, sf_dir), "item_id", "doc_id", 10), "item_id", "doc_id").withColumnRenamed("keys", "others")
    return rounded(first.join(second, ["item_id", "k"]).select("item_id", "k", *X.agreement(F.col("keys"), F.col("others"))))


LIKE = r"""(regexp_matches(x, '[_-]') OR (regexp_full_match(x, '[a-z0-9./:-]+') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))
  OR regexp_full_match(x, '[a-z0-9_/-]+(?:\.[a-z0-9_/-]+)+') OR regexp_full_match(x, 'v?[0-9]+(?:\.[0-9]+)+'))"""
ASKED = f"""t AS (SELECT item_id, text, {TOKENS.format('text')} AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x FROM t),
c AS (SELECT item_id, count(*) FILTER (WHERE regexp_full_match(x, '[0-9]+')) AS d, count(*) FILTER (WHERE {LIKE}) AS i FROM u GROUP BY item_id),
asked AS (SELECT t.item_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(w) AS INTEGER) AS terms, CAST(len(list_distinct(w)) AS INTEGER) AS unique_terms, round(len(list_distinct(w))::DOUBLE / len(w), 6) AS unique_share,
  CAST(coalesce(d, 0) AS INTEGER) AS digit_terms, round(coalesce(d, 0)::DOUBLE / len(w), 6) AS digit_share, CAST(coalesce(i, 0) AS INTEGER) AS identifier_terms, round(coalesce(i, 0)::DOUBLE / len(w), 6) AS identifier_share FROM t LEFT JOIN c ON c.item_id = t.item_id)"""


@query(f"WITH {ASKED} SELECT * FROM asked")
def query_features(spark, sf_dir):
    asked = benchmark(spark, sf_dir).select("item_id", "text", tokens(F.col("text")).alias("w"))
    return rounded(asked.select("item_id", *X.query_features(F.col("text"), F.col("w"))))


@query(f"""WITH {PREDICTIONS}, f AS (SELECT strategy, avg(p) AS m, stddev_pop(p) AS s FROM predictions WHERE split = 'train' GROUP BY strategy)
SELECT doc_id, r.strategy, CASE WHEN s = 0 THEN 0 ELSE round((p - m) / s, 5) END AS p_z FROM predictions r LEFT JOIN f ON f.strategy = r.strategy""")
def strategy_zscore(spark, sf_dir):
    rows = X.zscore(predictions(spark, sf_dir).select("doc_id", "strategy", "p", "split"), "strategy", "p", F.col("split") == "train")
    return rows.select("doc_id", "strategy", F.round("p_z", 5).alias("p_z"))


@query(f"""WITH {RESPONSES}, w AS (SELECT response_id, question, response, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(response), '[a-z0-9]+')) AS b FROM responses WHERE question IS NOT NULL)
SELECT response_id, CASE WHEN len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(b), 6) ELSE 0 END AS overlap, CAST(length(question) AS INTEGER) AS context_chars, CAST(length(response) AS INTEGER) AS response_chars,
CASE WHEN length(question) > 0 THEN round(length(response)::DOUBLE / length(question), 6) ELSE 0 END AS length_ratio, CAST(len(regexp_extract_all(response, '[.!?]')) AS INTEGER) AS sentence_marks, CAST(len(regexp_extract_all(response, '[0-9]')) AS INTEGER) AS digits FROM w""")
def hallucination_features(spark, sf_dir):
    rows = responses(spark, sf_dir).filter("question is not null")
    return rounded(rows.select("response_id", *X.hallucination_features(F.col("question"), F.col("response"))))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type, CAST(n AS BIGINT) AS n FROM r WHERE k = 1""")
def dominant_label(spark, sf_dir):
    return X.dominant(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type")
