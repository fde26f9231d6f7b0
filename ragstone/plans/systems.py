"""Queries on assembled feature rows, model inputs and the two-pass answering system.

Documents are chunks, benchmark items questions; the vector of either is the embedding whose place is its id modulo their
number. Documents are retrieved by BM25 (`bm25`), by shared words (`dense`) and by the fusion of both (`hybrid`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragstone.functions.text import ascii_tokens, collapsed, rouge_l_f1, tokens
from ragstone.operators import assembly as S
from ragstone.operators import governance as V
from ragstone.operators import models as L
from ragstone.operators import prototype as P
from ragstone.operators import retrieval as R

from .alignment import claims
from .features import at_depths
from .fixtures import PREDICTIONS, RESPONSES, predictions, responses, table
from .metrics import rounded
from .registry import query
from .retrieval import benchmark, bm25_hits, documents, gold_pairs, index, overlap_scores


def vectors(spark, sf_dir):
    """place, vector: embeddings in the order of their ids; one row per place, whose number is counted."""
    stored = table(spark, sf_dir, "embeddings")
    return stored.select(F.col("vec_id").alias("place"), F.col("embedding").alias("vector")), stored.count()


def rankings(spark, sf_dir):
    """item_id, strategy, rank, doc_id, score."""
    first = bm25_hits(spark, sf_dir)
    second = R.ranked(overlap_scores(spark, sf_dir), "item_id", "doc_id", 10)
    both = R.fused(first, second, "item_id", "doc_id", 10)
    named = lambda df, name: df.select("item_id", F.lit(name).alias("strategy"), "rank", "doc_id", "score")
    return named(first, "bm25").unionByName(named(second, "dense")).unionByName(named(both, "hybrid"))


@query()
def condition_feature_rows(spark, sf_dir):
    """The 39 features of every question, strategy and depth."""
    built, (stored, n) = index(spark, sf_dir), vectors(spark, sf_dir)
    hits = rankings(spark, sf_dir).cache()  # thirty rows a question, read four times
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("origin"), F.pmod("doc_id", F.lit(n)).alias("place"))
    chunks = chunks.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").join(stored, "place").join(built.documents.select("doc_id", F.col("terms").alias("words"), "length"), "doc_id")
    context = hits.join(chunks, "doc_id").select("item_id", "strategy", "rank", "score", F.col("origin").alias("doc_id"), "words", "length", "vector")
    conditions = S.gathered(at_depths(context), ["item_id", "strategy", "k"], ["score", "doc_id", "words", "length", "vector"])
    lists = R.prefixes(hits.withColumn("group", F.concat_ws(":", "strategy", "item_id")), "group", "doc_id")
    side = lambda name, alias: lists.filter(F.col("group").startswith(f"{name}:")).select(F.split("group", ":")[1].cast("long").alias("item_id"), "k", F.col("keys").alias(alias))
    asked = benchmark(spark, sf_dir).select("item_id", "text", tokens(F.col("text")).alias("words"), F.pmod("item_id", F.lit(n)).alias("place")).join(stored, "place")
    weights = S.weighted_terms(asked, built.vocabulary.select("term", "idf"), "item_id", R.oov_idf(F.lit(built.corpus.first()["n"])))
    rows = S.condition_features(asked.join(weights, "item_id", "left"), conditions, side("bm25", "first").join(side("dense", "second"), ["item_id", "k"], "left"), "item_id")
    return rounded(rows)


@query()
def prototype_feature_rows(spark, sf_dir):
    """Thirteen features of every question's hybrid ranking."""
    first, second = bm25_hits(spark, sf_dir), R.ranked(overlap_scores(spark, sf_dir), "item_id", "doc_id", 10)
    hits = R.blended(first, second, "item_id", "doc_id", 10).select("item_id", "doc_id", "rank", "score", F.col("a").alias("first_score"), F.col("b").alias("second_score"))
    texts = documents(spark, sf_dir).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    words = F.array_distinct(ascii_tokens(F.col("text")))
    contexts = S.gathered(hits.join(texts.withColumn("words", words), "doc_id"), ["item_id"], ["score", "first_score", "second_score", "text", "words"])
    return rounded(S.prototype_features(benchmark(spark, sf_dir).withColumn("words", words), contexts, "item_id"))


@query(f"WITH {RESPONSES}" + r""", c AS (SELECT response_id, unnest(regexp_extract_all(response, '\s*\S+')) AS t FROM responses),
s AS (SELECT response_id, count(*) AS n FROM c GROUP BY response_id) SELECT response_id, 1::BIGINT AS claims, CAST(n AS INTEGER) AS longest, CAST(CASE WHEN n + 3 >= 40 THEN 1 ELSE 0 END AS BIGINT) AS exceeding, n + 3 < 40 AS evaluable FROM s""")
def claim_budget(spark, sf_dir):
    """Whole responses as claims of a model that takes 40 tokens."""
    return L.claim_budget(responses(spark, sf_dir).filter(F.col("response").rlike(r"\S")).select("response_id", F.col("response").alias("text")), ["response_id"], 40)


@query()
def rendered_premises(spark, sf_dir):
    """Every claim with its question as a premise of 48 tokens for both."""
    short = F.regexp_count("text", F.lit(r"\S+")) < 20
    pairs = claims(spark, sf_dir).filter(F.col("question").isNotNull() & short).select(
        "response_id", "claim_index", F.col("text").alias("claim"),
        F.array(F.struct(F.lit(1).alias("rank"), F.col("question").alias("text")), F.struct(F.lit(2).alias("rank"), F.col("response").alias("text"))).alias("units"),
    )
    return L.rendered_premises(pairs, ["response_id", "claim_index"], 48)


@query()
def assembled_prompts(spark, sf_dir):
    """Prompts of at most 600 tokens from each question's ten BM25 documents."""
    hits = bm25_hits(spark, sf_dir).join(documents(spark, sf_dir).filter(F.col("text").rlike(r"\S")), "doc_id")
    chunk = F.struct("rank", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    gathered = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    renumbered = F.transform("chunks", lambda c, i: F.struct((i + 1).alias("rank"), c["chunk_id"].alias("chunk_id"), c["text"].alias("text")))
    asked = benchmark(spark, sf_dir).select("item_id", F.col("text").alias("question")).filter(F.col("question").rlike(r"\S"))
    return L.assembled_prompts(asked.join(gathered.withColumn("chunks", renumbered), "item_id"), ["item_id"], 600).drop("context")


@query("""WITH n AS (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm, len(embedding) AS size FROM embeddings)
SELECT CAST(count(*) AS BIGINT) AS vectors, CAST(count(*) FILTER (WHERE size <> 64) AS BIGINT) AS wrong_dimension, 0::BIGINT AS not_finite, CAST(count(*) FILTER (WHERE abs(norm - 1) > 0.00001) AS BIGINT) AS not_unit, round(min(norm), 6) AS minimum_norm, round(max(norm), 6) AS maximum_norm FROM n""")
def vector_store_checks(spark, sf_dir):
    return rounded(L.vector_checks(table(spark, sf_dir, "embeddings"), 64))


@query(f"""WITH {PREDICTIONS}, e AS (SELECT doc_id, exp(p - greatest(p, p2, 1 - p)) AS a, exp(p2 - greatest(p, p2, 1 - p)) AS b, exp(1 - p - greatest(p, p2, 1 - p)) AS c FROM predictions)
SELECT doc_id, round(a / (a + b + c), 6) AS entailment, round(b / (a + b + c), 6) AS neutral, round(c / (a + b + c), 6) AS contradiction FROM e""")
def softmax_scores(spark, sf_dir):
    p = L.softmax(F.array("p", "p2", 1 - F.col("p")))
    rows = predictions(spark, sf_dir).select("doc_id", p.alias("s"))
    return rounded(rows.select("doc_id", *[F.col("s")[i].alias(n) for i, n in enumerate(("entailment", "neutral", "contradiction"))]))


@query("""WITH k AS (SELECT doc_id, source, substr(text, 1, 500) AS head, row_number() OVER (PARTITION BY source, substr(text, 1, 500) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM k WHERE n = 1""")
def chunks_by_file_and_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", P.chunk_key(F.col("source"), F.col("text")).alias("known"))
    return V.first_per_key(docs, ["known"], ["doc_id"]).select("doc_id", "source")




def supported(spark, sf_dir):
    said = claims(spark, sf_dir).select("response_id", F.col("text").alias("claim")).distinct()
    every = responses(spark, sf_dir).select("response_id").join(said, "response_id", "left")
    asked = responses(spark, sf_dir).filter("question is not null").select("response_id", F.col("question").alias("chunk"))
    return P.cosine_support(every, asked, ["response_id"])


@query()
def cosine_claim_support(spark, sf_dir):
    """Distinct claims of each response against its question, at a cosine of .42."""
    return rounded(supported(spark, sf_dir))


ANSWERS = (0.7, 0.4)
DECIDED = f"""WITH {PREDICTIONS}, f AS (SELECT doc_id, source, lang, y = 1 AS answerable, p AS p_first, greatest(p, p2) AS p_second, n_chars FROM predictions),
d AS (SELECT *, p_first >= 0.4 AND p_first < 0.7 AS escalated, CASE WHEN p_first >= 0.7 OR (p_first >= 0.4 AND p_second >= 0.7) THEN 'answer' ELSE 'abstain' END AS decision,
  CASE WHEN p_first >= 0.4 AND p_first < 0.7 AND p_second >= 0.7 THEN p_second ELSE p_first END AS p FROM f),
o AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 10 AS DOUBLE) / 10.0::DOUBLE END AS rouge_l, CAST(doc_id % 7 AS DOUBLE) / 7.0::DOUBLE AS unsupported_rate, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 2 AS INTEGER) END AS retrieval_hit FROM d)"""
SUMMARY = """CAST(count(*) AS BIGINT) AS "rows", round(avg(CASE WHEN (decision = 'answer') = answerable THEN 1.0::DOUBLE ELSE 0 END), 6) AS decision_accuracy, round(avg(CASE WHEN decision = 'answer' THEN 1.0::DOUBLE ELSE 0 END), 6) AS answer_coverage,
round(avg(CASE WHEN NOT answerable THEN CASE WHEN decision = 'answer' THEN 1.0::DOUBLE ELSE 0 END END), 6) AS unsafe_answer_rate, round(avg(CASE WHEN answerable THEN CASE WHEN decision <> 'answer' THEN 1.0::DOUBLE ELSE 0 END END), 6) AS false_abstention_rate,
round(avg(CASE WHEN answerable THEN retrieval_hit END), 6) AS retrieval_hit_rate, round(avg(CASE WHEN answerable AND decision = 'answer' THEN rouge_l END), 6) AS mean_rouge_l, round(avg(CASE WHEN decision = 'answer' THEN unsupported_rate END), 6) AS mean_unsupported_rate"""


def outcomes(spark, sf_dir):
    q = F.col("doc_id")
    rows = predictions(spark, sf_dir).select(
        "doc_id", "lang", (F.col("y") == 1).alias("answerable"), F.col("p").alias("p_first"), F.greatest("p", "p2").alias("p_second"),
        F.when(q % 4 != 0, (q % 10) / 10.0).alias("rouge_l"), ((q % 7) / 7.0).alias("unsupported_rate"), F.when(q % 5 != 0, (q % 2).cast("int")).alias("retrieval_hit"),
    )
    return P.escalated(rows, *ANSWERS)


@query(DECIDED + " SELECT doc_id, decision, escalated, round(p, 6) AS p FROM o")
def escalation_policy(spark, sf_dir):
    return rounded(outcomes(spark, sf_dir).select("doc_id", "decision", "escalated", "p"))


@query(DECIDED + f" SELECT lang, {SUMMARY} FROM o GROUP BY lang")
def system_evaluation(spark, sf_dir):
    return rounded(P.system_summary(outcomes(spark, sf_dir), ["lang"]))


@query(DECIDED + f""", v AS (SELECT 'always' AS variant, * REPLACE ('answer' AS decision) FROM o UNION ALL SELECT 'binary', * REPLACE (CASE WHEN p_first >= 0.7 THEN 'answer' ELSE 'abstain' END AS decision) FROM o
UNION ALL SELECT 'full', * REPLACE (CASE WHEN p_first >= 0.7 THEN 'answer' WHEN p_first >= 0.4 THEN 'request_more_evidence' ELSE 'abstain' END AS decision) FROM o) SELECT variant, {SUMMARY} FROM v GROUP BY variant""")
def system_variants(spark, sf_dir):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("always", "binary", "full")]))
    rows = outcomes(spark, sf_dir).withColumn("variant", kinds)
    decided = F.when(F.col("variant") == "always", P.variant(F.col("p_first"), "always", *ANSWERS)).when(
        F.col("variant") == "binary", P.variant(F.col("p_first"), "binary", *ANSWERS)
    ).otherwise(P.variant(F.col("p_first"), "full", *ANSWERS))
    return rounded(P.system_summary(rows.withColumn("decision", decided), ["variant"]))


@query(DECIDED + """, b AS (SELECT CASE WHEN NOT answerable AND decision = 'answer' THEN 'Unsafe answer' WHEN answerable AND decision <> 'answer' THEN 'False abstention or request' WHEN decision = 'request_more_evidence' THEN 'Request more evidence'
WHEN decision = 'answer' AND unsupported_rate > 0.5 THEN 'Unsupported generated answer' WHEN answerable AND decision = 'answer' AND retrieval_hit = 0 THEN 'Wrong retrieval likely' WHEN answerable AND decision = 'answer' THEN 'Good answer candidate' ELSE 'Other' END AS bucket FROM o)
SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bucket""")
def error_buckets(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy(P.error_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def answered_questions(spark, sf_dir):
    """The whole system on the benchmark: gate, escalation, generation by the best document's head, fallback, support."""
    hits = bm25_hits(spark, sf_dir).filter("rank = 1").join(documents(spark, sf_dir), "doc_id")
    gold = gold_pairs(spark, sf_dir).select("item_id").distinct().withColumn("answerable", F.lit(True))
    p = F.col("score") / (F.col("score") + 40.0)
    rows = benchmark(spark, sf_dir).select("item_id", F.col("text").alias("question")).join(hits.select("item_id", "score", "text"), "item_id").join(gold, "item_id", "left")
    gated = P.escalated(rows.withColumns({"p_first": p, "p_second": F.least(p * 1.2, F.lit(1.0)), "answerable": F.coalesce("answerable", F.lit(False))}), *ANSWERS)
    generated, head = F.substring(collapsed(F.col("text")), 1, 120), F.substring(collapsed(F.col("text")), 1, 200)
    final = gated.withColumns({f"x_{k}": v for k, v in P.settled_answer(F.col("decision"), generated, head).items()})
    return rounded(final.select("item_id", "answerable", "escalated", F.col("x_decision").alias("decision"), F.col("x_source").alias("source"), "p", F.when(F.col("x_answer").isNotNull(), rouge_l_f1("x_answer", "question")).alias("rouge_l")))
